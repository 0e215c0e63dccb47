"""Seeds chosen from one look-up of all windows of a place, against brute force and the ways by single lengths."""

from itertools import product

import pytest

import __spark_entry__
from seedloom.operators import read_seeding as R
from seedloom.operators import seeds as P
from seedloom.operators import window_counts as C

CONTIGS = ["ACGTACGGTACCATTA", "ACGTACGGTACGATTACAG", "TTACGTAGGATTACAGACC", "ACGACGACGACGACGACGACG", "NNACG", "AC", "", None]
READS = [(1, "ACGTACGGTACCATTACAG"), (2, "ACGACGACGACGACGACGACG"), (3, "ACGTAC"), (4, "ACGTAXGATTACAG"), (5, "NNACGNACG"), (6, "AC"), (7, ""), (8, None)]


def tables(spark):
    return spark.createDataFrame(READS, "read_no long, seq string"), spark.createDataFrame(list(enumerate(CONTIGS)), "seq_no long, seq string").repartition(3)


@pytest.mark.parametrize("others, least", [(3, 1), (3, 2), (0, 0)])
def test_all_lengths_at_once(spark, others, least):
    reads, contigs = tables(spark)
    count = lambda w: sum(c.startswith(w, k) for c in CONTIGS if c for k in range(len(c)))
    want = {}
    for no, seq in READS:
        if not seq or len(seq) < 3:
            continue
        spans = []
        for b in range(len(seq) - 2):
            for e in range(b + 3, min(len(seq), b + 12, b + max(len(seq) - others, 3)) + 1):
                spans.append((count(seq[b:e]), b, e))
                if spans[-1][0] < least:
                    break
        pairs = [(x[0] + y[0], [*x[1:], *y[1:]]) for x, y in product(spans, spans) if x[2] <= y[1]]
        best = min(pairs, default=(-1, []))
        want[no] = (best[0], ",".join(map(str, best[1])))
    rows = C.chosen_windows(reads, contigs, 2, 3, 12, others, least)
    assert {r.read_no: (r.total_freq, r.chosen) for r in rows.collect()} == want


@pytest.mark.parametrize("cells, rows", [(1, 1), (1 << 22, 3)])
def test_small_pieces_give_the_same(spark, monkeypatch, cells, rows):
    reads, contigs = tables(spark)
    monkeypatch.setattr(C, "CELLS", cells)
    monkeypatch.setattr(C, "ROWS", rows)
    want = P.chosen_seeds(R.growing_cells(reads.filter("read_no < 4"), contigs, 3, 3, 2), 2)
    got = C.chosen_windows(reads.filter("read_no < 4"), contigs, 2, 3, 18, 3, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["read_optimal_seeds", "read_optimal_seeds_full", "read_optimal_seeds_leaf"])
def test_places_are_shuffled_twice(spark, name):
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
