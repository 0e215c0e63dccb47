"""The reference queries against DuckDB, and small expected values."""

import duckdb
import pytest
from pyspark.sql import Row

from seedloom.functions import sequence as S
from seedloom.operators import distances as D
from seedloom.operators import kmers as K
from seedloom.operators import seeds as P
from seedloom.plans import catalogue, seeding
from seedloom.sources import genome as G

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for _, v in sorted(zip(columns, r))) for r in values)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


QUERIES, ORACLE_SQL = catalogue.QUERIES | seeding.QUERIES, catalogue.ORACLE_SQL | seeding.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_trie_of_a_known_contig(spark):
    contigs = spark.createDataFrame([(0, "ACTACTGATAGA")], "seq_no long, seq string")
    got = {r.label: (r.node_id, r.freq) for r in K.trie_nodes(K.trie(contigs, 3)).collect()}
    assert got["A"] == (1, 5) and got["TG"] == (11, 1) and got["ACT"] == (12, 2) and got["TGA"] == (20, 1)
    children = {r.label: (r.child_offset, r.child_size) for r in K.trie_children(K.trie_nodes(K.trie(contigs, 3)), 3).collect()}
    assert [children[x] for x in "ACGT"] == [(5, 3), (8, 1), (9, 1), (10, 2)]


def test_distances(spark):
    df = spark.createDataFrame([("ACGT", "ACGTTT", 0), ("ACGT", "TTTT", 3), ("TGGGTTCAACTA", "TAGGGCAAGCGG", 6)], "a string, b string, d int")
    assert df.filter(S.prefix_distance("a", "b") != df.d).count() == 0
    fit = spark.createDataFrame([("ACTG", "TTACTGAA")], "a string, b string")
    assert fit.select(S.fitting_distance("a", "b").alias("d")).first().d == 0


def test_nearest_seed_depends_on_the_signpost_filter(spark):
    q = spark.createDataFrame([("TGGGTTCAACTA",)], "seed string")
    t = spark.createDataFrame([("TAGGGTTCAAGC",)], "seed string")
    pivot = ["TAGGGCAAGCGG"]
    got = D.nearest_nontrivial(D.with_distances(q, pivot), D.with_distances(t, pivot), 3)
    assert got.collect() == [Row(seed="TGGGTTCAACTA", closest=3)]


def test_next_signpost(spark):
    df = spark.createDataFrame([("a", [2, 4]), ("b", [3, 5]), ("c", [3, 6]), ("d", [4, 4])], "seed string, distance array<int>")
    assert D.next_signpost(df, 2).first().asDict() == {"seed": "a", "distance": [2, 4], "radius": 1}


def test_seed_choice(spark):
    df = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 3, 1), (1, 2, 1, 1)], "read_no int, beg int, freq int, ets int")
    assert tuple(P.select_seeds(df, 3).first())[1:] == (2, 2)
    assert tuple(P.select_seeds(df, 5).first())[1:] == (-1, 0)


@pytest.mark.parametrize(
    "v, u, threshold, flag",
    [
        ("ACT", "CT", 2, 1), ("ACT", "AC", 2, 2), ("CT", "ACT", 2, 4), ("AC", "ACT", 2, 8), ("A", "A", 2, 15), ("", "A", 2, 12), ("A", "", 2, 3),
        ("ACT", "AGT", 2, 0), ("GACTG", "ACT", 3, 16), ("ACT", "GACTG", 3, 32), ("CTA", "ACT", 3, 64), ("ACT", "CTA", 3, 128),
        ("AAA", "AA", 2, 3), ("AAA", "AA", 3, 131),
    ],
)
def test_relation_flags(spark, v, u, threshold, flag):
    df = spark.createDataFrame([(v, u)], "v string, u string")
    assert df.select(S.relation_flags("v", "u", threshold)).first()[0] == flag


def test_optimal_seeds(spark):
    cells = [(1, 0, 10, 5), (1, 0, 12, 2), (1, 10, 20, 1), (1, 12, 22, 6), (1, 20, 30, 1), (1, 20, 25, 0), (2, 0, 10, 1)]
    df = spark.createDataFrame(cells, "read_no long, beg int, end int, freq int")
    assert dict(map(tuple, P.optimal_seeds(df, 1, 10).collect())) == {1: 1, 2: 1}
    assert dict(map(tuple, P.optimal_seeds(df, 2, 10).collect())) == {1: 2, 2: -1}
    assert dict(map(tuple, P.optimal_seeds(df, 3, 10).collect())) == {1: 7, 2: -1}


def test_read_cells(spark):
    reads = spark.createDataFrame([(1, "ACGT"), (2, "AC"), (3, "")], "read_no long, seq string")
    contigs = spark.createDataFrame([(0, "ACGACG")], "seq_no long, seq string")
    got = P.read_cells(reads, contigs, 3, 4)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 2), (1, 0, 4, 0), (1, 1, 4, 0)]


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nACGT\nAC\n>two\nGG")
    got = G.read_fasta(spark, str(tmp_path / "a.fa")).select("seq_no", "name", "seq").collect()
    assert [tuple(r) for r in got] == [(0, "one", "ACGTAC"), (1, "two", "GG")]
    (tmp_path / "r.fq").write_text("@r1\nACG\n+\nIII\n@r2\nTT\n+\nII\n")
    got = G.read_fastq(spark, str(tmp_path / "r.fq")).select("read_no", "name", "seq", "qual").collect()
    assert [tuple(r) for r in got] == [(0, "r1", "ACG", "III"), (1, "r2", "TT", "II")]
    vectors = spark.createDataFrame([("AC", [2, 1]), ("GT", [1, 9])], "seed string, distance array<int>")
    G.write_seed_vectors(vectors, str(tmp_path / "v"))
    assert sorted(map(tuple, G.read_seed_vectors(spark, str(tmp_path / "v")).collect())) == [("AC", [2, 1]), ("GT", [1, 9])]


def test_padding(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ACGT",)], "seq string")
    assert tuple(df.select(S.padded_slice("seq", F.lit(2), 4), S.padded_slice("seq", F.lit(4), 4)).first()) == ("GTNN", "")


def test_long_and_odd_contigs(spark):
    rng = __import__("random").Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(200_000))
    df = spark.createDataFrame([(0, seq), (1, ""), (2, None), (3, "ACG"), (4, seq[:256]), (5, seq[:257])], "seq_no long, seq string")
    assert K.substrings(df, 12).count() == len(seq) - 11 + 245 + 246
    some = {r.pos: r.kmer for r in K.substrings(df, 12).filter("seq_no = 0 and pos % 997 = 0").collect()}
    assert some == {p: seq[p : p + 12] for p in range(0, len(seq) - 11, 997)}
    want = {}
    for s in ("ACG", seq[:256], seq[:257], seq):
        for k in range(len(s)):
            for n in range(1, min(3, len(s) - k) + 1):
                want[s[k : k + n]] = want.get(s[k : k + n], 0) + 1
    assert {r.label: r.freq for r in K.trie(df, 3).collect()} == want


def test_flag_word(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 3, True, 2), (2, 3, False, 2), (3, 3, True, 3), (4, 2, True, 1), (4, 3, True, 1)], "p int, units int, repeated boolean, fail int")
    words = df.groupBy("p").agg(S.flag_word("units", "repeated", "fail").alias("w"))
    assert dict(map(tuple, words.collect())) == {1: 40, 2: 0, 3: 8, 4: 2 + 4 + 8 + 16}
    assert dict(map(tuple, words.select("p", S.flag_errors("w", F.lit(3))).collect())) == {1: 2, 2: 3, 3: 3, 4: 1}


def test_tables_by_depth_and_index(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "ACTACTGATAGA")], "seq_no long, seq string")
    G.write_by_depth(K.trie(contigs, 3), str(tmp_path / "t"))
    got = G.read_by_depth(spark, str(tmp_path / "t"), 2, 2)
    assert got.count() == 7 and "PartitionFilters: [isnotnull(depth" in got._jdf.queryExecution().toString()
    G.write_index(K.substrings(contigs, 3), str(tmp_path / "i"))
    assert sorted(r.pos for r in G.read_index(spark, str(tmp_path / "i"), "ACT").collect()) == [0, 3]
    nearest = spark.createDataFrame([("AC", 3)], "seed string, closest int")
    G.write_nearest(nearest, str(tmp_path / "n"))
    assert [tuple(r) for r in G.read_signposts(spark, str(tmp_path / "n")).collect()] == [("AC", 3)]


def test_merged_runs_measure_distances_once(spark):
    rows = D.with_distances(spark.createDataFrame([("ACGTACGTACGA",), ("TTTTACGTACGT",), ("CCGTACGTACGT",), (None,)], "seed string"), ["ACGTACGTACGT", "TTGACCAGTACA"])
    merged = catalogue.merged_runs(rows)
    assert "levenshtein" not in merged._jdf.queryExecution().toString().lower()  # before: in either run, and again to sort
    assert [r.seed for r in merged.collect()] == [r.seed for r in rows.orderBy("distance", "seed").collect()]
