"""Files read in byte ranges, with records that cross them, and words of places packed by range."""

import random

from pyspark.sql import functions as F

from seedloom.operators import distances as D
from seedloom.operators import kmers as K
from seedloom.sources import genome as G


def test_files_are_read_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    contigs, reads = {}, {}
    for name in ("a", "b"):
        contigs[name] = [(f"c{k} of {name}", [word(rng.randrange(0, 70)) for _ in range(rng.randrange(0, 40))]) for k in range(12)]
        (tmp_path / f"{name}.fa").write_text("; a remark\n" + "".join(f">{n}\n" + "".join(f"{x}\n" for x in lines) for n, lines in contigs[name]))
        reads[name] = [(f"r{k}", s, "+", "I" * len(s)) for k in range(60) for s in [word(rng.randrange(1, 90))]]
        (tmp_path / f"{name}.fq").write_text("".join(f"@{n}\n{s}\n{p}\n{q}\n" for n, s, p, q in reads[name]) + ("@cut\nACG\n" if name == "a" else "\n\n\n\n\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        assert spark.read.text(f"{tmp_path}/a.fa").rdd.getNumPartitions() > 10
        got = {(r.file[-4], r.seq_no): (r.name, r.seq) for r in G.read_fasta(spark, f"{tmp_path}/*.fa").collect()}
        assert got == {(f, k): (n, "".join(lines)) for f in contigs for k, (n, lines) in enumerate(contigs[f])}
        found = {(r.file[-4], r.read_no): (r.name, r.seq, r.qual) for r in G.read_fastq(spark, f"{tmp_path}/*.fq").collect()}
        assert found == {(f, k): (n, s, q) for f in reads for k, (n, s, _, q) in enumerate(reads[f])}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_words_of_places_by_range(spark, tmp_path):
    rows = [(c, p, (c * 31 + p * 7) % 64) for c, n in ((1, 1000), (2, 77), (5, 300)) for p in range(n) if p % 3 or c != 5]
    G.write_words(spark.createDataFrame(rows, "seq_no long, pos long, word int").repartition(4), f"{tmp_path}/w", 64)
    some = G.read_words(spark, f"{tmp_path}/w", 1, 130, 333, 64)
    assert sorted(map(tuple, some.collect())) == [r for r in rows if r[0] == 1 and 130 <= r[1] <= 333]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(seq_no,1)" in plan and "GreaterThanOrEqual(range,2)" in plan and "LessThanOrE" in plan  # a plan cuts long lists short
    filled = G.read_words(spark, f"{tmp_path}/w", 5, 0, 299, 64)
    assert filled.filter(F.col("pos") % 3 == 0).agg(F.max("word")).first()[0] == 0 and filled.filter("word > 0").count() == sum(r[0] == 5 and r[2] > 0 for r in rows)
    assert G.read_words(spark, f"{tmp_path}/w", 9, 0, 10, 64).count() == 0


def test_first_seeds_and_a_copy_without_n(spark, tmp_path):
    rng = random.Random(4)
    lines = ["".join(rng.choice("ACGTN") for _ in range(6)) + f" {k}" for k in range(200)] + ["", "ACGT", "  ", "AC NN"]
    rng.shuffle(lines)
    (tmp_path / "s.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        seeds = [x.split()[0] for x in lines if x.strip()]
        assert sorted(r.seed for r in G.read_seeds(spark, f"{tmp_path}/s.txt").collect()) == sorted(seeds)
        assert sorted(r.seed for r in G.read_seeds(spark, f"{tmp_path}/s.txt", 57).collect()) == sorted(seeds[:57])
        G.write_without_n(spark, f"{tmp_path}/s.txt", f"{tmp_path}/out")
        assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted(x for x in lines if "N" not in x.split(" ")[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edges_and_profiles_by_depth(spark, tmp_path):
    rng = random.Random(6)
    contigs = spark.createDataFrame([(k, "".join(rng.choice("ACGT") for _ in range(80))) for k in range(3)], "seq_no long, seq string")
    nodes = K.trie(contigs, 4).select("depth", "label")
    edges = D.flagged_pairs(nodes.filter("depth <= 3"), nodes, 2).withColumn("depth", F.length("v"))
    G.write_by_depth(edges, f"{tmp_path}/edges")
    back = G.read_by_depth(spark, f"{tmp_path}/edges", 2, 3)
    kept = lambda df: sorted((r.v, r.u, r.dist, r.flag, r.depth) for r in df.collect())
    assert kept(back) == kept(edges.filter("depth between 2 and 3")) and "PartitionFilters: [isnotnull(depth" in back._jdf.queryExecution().executedPlan().toString()
    profiles = [D.position_tolerance(contigs, edges.drop("depth"), d, 3).select(F.lit(d).alias("depth"), "seq_no", F.col("pos").cast("long").alias("pos"), "ets") for d in (2, 3)]
    G.write_by_depth(profiles[0].unionByName(profiles[1]), f"{tmp_path}/ets")
    same = lambda df: sorted((r.seq_no, r.pos, r.ets) for r in df.collect())
    assert same(G.read_by_depth(spark, f"{tmp_path}/ets", 3, 3)) == same(profiles[1]) and profiles[1].count() == 240
