"""Substrings of contigs by slices of Arrow batches, against plain slicing."""

import random
from collections import Counter

import pyarrow as pa

from seedloom.operators import kmers as K


def test_places_in_slices_equal_plain_slicing(monkeypatch):
    rng = random.Random(3)
    word = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    for letters in ("ACGT", "ACÄ中"):
        texts = [word(n, letters) for n in (5, 5, 6, 40, 7, 5, 90)]
        want = [(r, p, t[p : p + 5]) for r, t in enumerate(texts) for p in range(len(t) - 4)]
        for size in (1, 7, 1000):
            monkeypatch.setattr(K, "SLICE", size)
            array = pa.array(["left out", *texts], pa.large_string()).slice(1)
            got = [x for row, pos, kmers in K._places(array, 5) for x in zip(row.tolist(), pos.tolist(), kmers.to_pylist(), strict=True)]
            assert got == want


def test_counts_are_summed_before_the_shuffle(spark):
    rows = [(0, "ACGTACGTAC"), (1, None), (2, ""), (3, "ACG"), (4, "ÄCGTÄ"), (5, "ACGT" * 50)]
    df = spark.createDataFrame(rows, "seq_no long, seq string")
    want = Counter(s[p : p + 4] for _, s in rows for p in range(len(s or "") - 3))
    counts = K.kmer_counts(df, 4)
    assert {r.kmer: r.n for r in counts.collect()} == want
    assert sorted(map(tuple, K.substrings(df, 4).collect())) == sorted((n, p, s[p : p + 4]) for n, s in rows for p in range(len(s or "") - 3))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # before: a row for each place
    assert K.kmer_counts(df.limit(0), 4).count() == 0


def test_summary_takes_the_first_place_in_the_order_of_numbers(spark):
    rows = [(7, "TTACGTACGT"), (3, "GGACGTGG"), (5, "ACGTACGT"), (2, None), (1, "")]
    want = {}
    for n, s in sorted(rows):
        for p in range(len(s or "") - 3):
            count, *first = want.get(s[p : p + 4], (0, n, p))
            want[s[p : p + 4]] = (count + 1, *first)
    for kind in ("long", "string"):
        df = spark.createDataFrame([(str(n) if kind == "string" else n, s) for n, s in rows], f"seq_no {kind}, seq string").repartition(2)
        found = K.kmer_summary(df, 4, 2)
        assert {r.kmer: (r.n, int(r.seq_no), r.pos) for r in found.collect()} == {k: v for k, v in want.items() if v[0] > 1}
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # before: a row for each place
