"""Greedy seeds by packed numbers against those by sorted places, with odd rows."""

import pytest
from test_read_seeding import CONTIGS, READS

from seedloom.operators import packed_reads as B
from seedloom.operators import read_seeding as R
from seedloom.operators import repeats
from seedloom.operators import suffixes as X


@pytest.mark.parametrize("k", [3, 6])
def test_packed_seeds_and_strands_equal_those_of_sorted_places(spark, k):
    contigs = spark.createDataFrame(list(enumerate(CONTIGS)), "seq_no long, seq string").repartition(3)
    reads = spark.createDataFrame([*enumerate(READS), (99, "ACéGTxACGTACGT")], "read_no long, seq string").repartition(2)
    fails = repeats.first_fail_errors(repeats.repeated_patterns(contigs, 2 * k), contigs, 2, k).cache()
    seeds = R.greedy_seeds(reads, X.suffix_table(contigs, 2 * k).cache(), 2 * k, repeats.position_flags(contigs, 2, k), 2, k).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = B.greedy_seeds(reads, contigs, fails, k)
    assert rows(got) == rows(seeds) and got.columns == seeds.columns
    assert rows(B.greedy_seeds(reads, contigs, fails, k, 3)) == rows(R.strand_choice(reads, seeds, 3))
    assert B.greedy_seeds(reads.limit(0), contigs.limit(0), fails.limit(0), k, 3).count() == 0


def test_ranks_without_sorted_rows(spark, monkeypatch):
    rows = [(1, "ACGTACGT" * 20), (None, "ACGT" * 9 + "é"), (3, None), (4, ""), (5, "A" * 90), (6, "NACGx")]
    df = spark.createDataFrame(rows, "seq_no long, seq string").repartition(2)
    tails = sorted((s[p : p + 42].replace("é", "N").replace("x", "N"), n, p) for n, s in rows if s for p in range(len(s)) for n in [n or -1])
    first = {}
    for i, (t, _, _) in enumerate(tails):
        first.setdefault(t, i)
    monkeypatch.setattr(X, "ranges", None)  # no suffix is a row of a sort
    assert {(r.seq_no or -1, r.pos): r.rank for r in X.suffix_ranks(df, 42).collect()} == {(n, p): first[t] for t, n, p in tails}
    assert X.suffix_ranks(df.limit(0), 42).count() == 0
