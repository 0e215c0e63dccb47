"""Nearest seeds against all pairs, and how many candidates their join meets."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from seedloom.functions.sequence import prefix_distance
from seedloom.operators import distances as D


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def anchored(a, b):
    return min(*edit(a, b), *edit(b, a))


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_nearest_of_seeds_of_many_lengths(spark, limit):
    rng = random.Random(limit)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seeds = {word(rng.choice([0, 1, 2, 3, 5, 7, 8, 8, 8, 9])) for _ in range(120)} | {"ACGTACGT", "CGTACGTA", "ACGTNCGT", "A" * 8}
    near = {w[:k] + rng.choice("ACGT") + w[k + 1 :] for w in list(seeds) for k in [rng.randrange(len(w) or 1)] if w}
    seeds = sorted(seeds | near)
    df = D.with_distances(spark.createDataFrame([(w, "x") for w in seeds], "seed string, t string"), ["ACGTACGT", "TTGACCAG"])
    vector = {r.seed: r.distance for r in df.collect()}
    want = {}
    for a in seeds:
        if "N" in a:
            continue
        want[a] = limit
        for b in seeds:
            if a != b and "N" not in b and max(abs(x - y) for x, y in zip(vector[a], vector[b])) <= limit:
                s = anchored(a, b)
                if s < limit and not a.startswith(b[s:]) and not b.startswith(a[s:]):
                    want[a] = min(want[a], s)
    got = D.nearest_nontrivial(df.union(df.limit(0)), df, limit).collect()
    assert {r.seed: r.closest for r in got} == want and len(got) == len(want)
    assert D.nearest_nontrivial(df.limit(0), df, limit).count() == 0


def test_nearest_moves_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 7)
    rng = random.Random(5)
    long = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (20, 40, 70)]
    seeds = sorted({w for x in long for w in (x, x[:9] + "T" + x[10:], x[:5] + x[6:], x[1:], "é" + x)} | {"A" * n for n in range(4)})
    rows = [(w, [1, k % 5]) for k, w in enumerate(seeds)] + [(None, [1, 1]), ("ACGT", None)]
    df = spark.createDataFrame(rows, "seed string, distance array<int>")
    got = D.nearest_nontrivial(df, df, 4)
    want = {w: 4 for w in [*seeds, "ACGT"]}
    for a, b in product(rows[: len(seeds)], repeat=2):
        s = anchored(a[0], b[0])
        if a[0] != b[0] and abs(a[1][1] - b[1][1]) <= 4 and s < 4 and not a[0].startswith(b[0][s:]) and not b[0].startswith(a[0][s:]):
            want[a[0]] = min(want[a[0]], s)
    assert {r.seed: r.closest for r in got.collect()} == want
    assert "cut" not in got._jdf.queryExecution().executedPlan().toString()  # no join on shared strings


def test_candidates_of_a_seed_do_not_grow_with_the_table(spark):
    seeds = spark.range(4000).select(F.substring(F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 12).alias("seed")).distinct()
    for n in (1000, 4000):
        some = seeds.limit(n)
        pairs = D.prefix_candidates(some, some, 2)
        assert pairs.count() <= n * n // 200  # all pairs within one signpost's band were nearly n * n
    near = pairs.filter(prefix_distance("seed", "t") <= 2).count()
    assert near > 0


@pytest.mark.parametrize("most, threshold", [(4, 4), (3, 2), (2, 1), (8, 4)])
def test_pairs_of_a_trie_level_by_level(spark, most, threshold):
    rng = random.Random(most)
    text = "".join(rng.choice("ACGT") for _ in range(40))
    labels = {text[k : k + n] for n in range(1, 11) for k in range(len(text) - n + 1)}
    want = {(v, u, edit(v, u)[-1]) for v in labels | {""} if len(v) <= most for u in labels | {""} if edit(v, u)[-1] < threshold}
    got = D.trie_pairs(spark.createDataFrame([(x, 1) for x in [*labels, None]], "label string, size int"), most, threshold).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
