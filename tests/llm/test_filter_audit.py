"""The audit of filters against plain Python over every order, and odd rows."""

from itertools import permutations

import re

import pytest

from seedloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, words string, part string, n int, salt string"
LONG = " ".join(f"w{k}" for k in range(60))


def rows():
    texts = [LONG, LONG, LONG.upper(), "a b", "", None, " \t\n", "x | y", LONG + " #", "a " * 80, "A\x0bB\x0cc" * 30, LONG + " %", LONG, "é" * 300 + " Z" * 2, LONG * 900]
    found = [(k, t, ["s1", "s2", None, ""][k % 4], "clash", "clash", 7, "clash") for k, t in enumerate(texts)]
    return found + [found[0], (None, LONG, "s1", "", "", 1, ""), (None, LONG, "s2", "", "", 1, ""), (-5, "a b", "s1", "", "", 1, "")]


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(found, good, toxic):
    least = {}
    for i, t, *_ in found:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = [(s or "", fails(t or "") | {"E": i is not None and least[t or ""] < i}, i in good, i in toxic) for i, t, s, *_ in found]
    want = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                early = sum(d[1][f] for d in own) - len(gone)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                shapley[f] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), early, only, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return want


@pytest.fixture(scope="module")
def labels(spark):
    marks = [(0, 1, 0), (0, None, 1), (1, 0, 0), (1, 1, 1), (3, 1, None), (8, 0, 1), (None, 1, 1), (77, 1, 1), (9, 1, 1)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_audit_equals_every_order_applied(spark, labels):
    got = filter_audit.audit(spark.createDataFrame(rows(), SCHEMA).repartition(5), labels).collect()
    want = brute(rows(), {0, 1, 3, 9}, {0, 1, 8, 9})
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want and len(got) == len(want)


def test_audit_of_few_filters_and_of_an_empty_table(spark, labels):
    docs = spark.createDataFrame(rows(), SCHEMA)
    two = filter_audit.audit(docs, labels, {"x": "length(text) = 0", "y": "size(array_remove(words, '')) < 2"}, copies=None)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in two.filter("part = 's1'").collect()}
    assert got == {("xy", 1): (6, 1, 0), ("xy", 2): (6, 0, 1), ("yx", 1): (6, 1, 0), ("yx", 2): (6, 0, 1)}
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
