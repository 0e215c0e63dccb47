"""Contigs, reads and seeds as DataFrames, from tables or from text formats, and their text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import ranges, running


def contigs_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_no, seq): the bases in each document's text, in upper case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq_no"), F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("seq"))


def _lines(spark: SparkSession, path: str, of: str) -> DataFrame:
    """(file, block, at, value, own, before): the lines of text files, read in byte ranges by as many tasks as Spark cuts.

    ``at`` is in order within a range. ``own`` is 1 where the SQL condition ``of`` holds, else 0; ``before`` is their
    number in the ranges of the file that come first, summed over one row for each range.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", F.expr(f"int({of})").alias("own")
    )
    sums = lines.groupBy("file", "block").agg(F.sum("own").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sums.select("file", "block", before.alias("before")), ["file", "block"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_no, name, seq) of the contigs of FASTA files; lines of one contig are joined, what stands before the first header is left out.

    A file is read in byte ranges; a contig that crosses some is put together from its lines, and is one row in the end.
    """
    order = Window.partitionBy("file", "block").orderBy("at")
    known = _lines(spark, path, "startswith(value, '>')").withColumn("no", F.col("before") + F.sum("own").over(order) - 1).filter("no >= 0")
    part = F.when(F.col("own") == 0, F.struct("block", "at", F.regexp_replace("value", r"\s", "").alias("value")))
    whole = known.groupBy("file", F.col("no").cast("int").alias("seq_no")).agg(F.max(F.when(F.col("own") == 1, F.expr("substring(value, 2)"))).alias("name"), F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("file", "seq_no", F.regexp_replace("name", r"\r$", "").alias("name"), F.array_join("parts.value", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_no, name, seq, qual): records of four lines; a file is read in byte ranges, and records may cross them.

    Lines are numbered through each file by the ranges' sums. An incomplete last record and blank lines at the end are left out.
    """
    order = Window.partitionBy("file", "block").orderBy("at")
    known = _lines(spark, path, "true").withColumn("no", F.col("before") + F.row_number().over(order) - 1)
    line = lambda k: F.max(F.when(F.col("no") % 4 == k, F.col("value")))
    records = known.groupBy("file", F.expr("int(no div 4)").alias("read_no")).agg(F.count("*").alias("n"), line(0).alias("name"), line(1).alias("seq"), line(3).alias("qual"))
    return records.filter("n = 4 and name != ''").select("file", "read_no", F.expr("substring(name, 2)").alias("name"), "seq", "qual")


def read_seeds(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(file, seed): the first token of each line that has one; of the first ``first`` such lines of each file, if given."""
    known = _lines(spark, path, "trim(value) != ''")
    no = F.col("before") + F.sum("own").over(Window.partitionBy("file", "block").orderBy("at"))
    rows = known.filter("own = 1") if first is None else known.withColumn("no", no).filter((F.col("own") == 1) & (F.col("no") <= first))
    return rows.select("file", F.split(F.trim("value"), r"\s+")[0].alias("seed"))


def write_without_n(spark: SparkSession, path: str, out: str) -> None:
    """A copy of text files without the lines whose first token holds an N; lines keep their order within a range of a file."""
    spark.read.text(path).filter(~F.split("value", " ")[0].contains("N")).write.text(out)


def read_seed_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(seed, distance array<int>) from lines "seed d0 d1 ..."; the last line needs no line end."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        parts[0].alias("seed"), F.transform(F.slice(parts, 2, 1 << 30), lambda x: x.cast("int")).alias("distance")
    )


def write_seed_vectors(vectors: DataFrame, path: str) -> None:
    """Lines "seed d0 d1 ...", in the order of the distance vectors."""
    line = F.concat_ws(" ", "seed", F.array_join(F.transform("distance", lambda x: x.cast("string")), " "))
    vectors.orderBy("distance", "seed").select(line.alias("value")).write.text(path)


def global_offsets(contigs: DataFrame) -> DataFrame:
    """(seq_no, length, global_off): where each contig starts in the text of all in order, one separator after each."""
    rows = contigs.select("seq_no", F.length("seq").cast("long").alias("length")).withColumn("own", F.col("length") + 1)
    return running(ranges(rows, ["seq_no"]), ["seq_no"], "own", "global_off").select("seq_no", "length", "global_off")


def read_signposts(spark: SparkSession, path: str) -> DataFrame:
    """(signpost, mode int) from lines "signpost mode"."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].alias("signpost"), F.get(parts, F.lit(1)).cast("int").alias("mode"))


def write_nearest(nearest: DataFrame, path: str) -> None:
    """Lines "seed distance"."""
    nearest.select(F.concat_ws(" ", "seed", F.col("closest").cast("string")).alias("value")).write.text(path)


def neighbour_lines(edges: DataFrame) -> DataFrame:
    """(value): for each node v a line "v n: u-dist|flag ..." with its n neighbours in order."""
    one = F.concat("u", F.lit("-"), F.col("dist").cast("string"), F.lit("|"), F.col("flag").cast("string"))
    rows = edges.groupBy("v").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("x"))
    return rows.select(F.concat("v", F.lit(" "), F.col("n").cast("string"), F.lit(": "), F.array_join("x", " ")).alias("value"))


def write_by_depth(rows: DataFrame, path: str, depth: str = "depth") -> None:
    """Trie nodes, neighbour edges or profiles as Parquet with a folder for each depth."""
    rows.repartition(depth, F.pmod(F.xxhash64(*[c for c in rows.columns if c != depth]), F.lit(16))).write.partitionBy(depth).parquet(path)


def read_by_depth(spark: SparkSession, path: str, least: int, most: int, depth: str = "depth") -> DataFrame:
    """The rows of some depths; the folders of others are not opened."""
    return spark.read.parquet(path).filter(F.col(depth).between(least, most))


def write_index(kmers: DataFrame, path: str, letters: int = 2) -> None:
    """Places of k-mers (kmer, seq_no, pos) as Parquet by their first letters, sorted, so a look-up opens one folder."""
    head = kmers.withColumn("head", F.substring("kmer", 1, letters))
    head.repartition("head", F.substring("kmer", 1, letters + 3)).sortWithinPartitions("kmer", "seq_no", "pos").write.partitionBy("head").parquet(path)


def read_index(spark: SparkSession, path: str, kmer: str, letters: int = 2) -> DataFrame:
    """(kmer, seq_no, pos) of one k-mer."""
    return spark.read.parquet(path).filter((F.col("head") == kmer[:letters]) & (F.col("kmer") == kmer)).drop("head")


def write_words(words: DataFrame, path: str, width: int = 4096) -> None:
    """Position words (seq_no, pos, word) as Parquet with one array for each ``width`` places of a contig, in order, 0 where there is none."""
    at = words.select("seq_no", F.expr(f"pos div {width}").alias("range"), F.expr(f"int(pos % {width})").alias("i"), "word")
    packed = at.groupBy("seq_no", "range").agg(F.map_from_entries(F.collect_list(F.struct("i", "word"))).alias("m"))  # no more than ``width``
    cells = F.expr(f"transform(sequence(0, array_max(map_keys(m))), i -> coalesce(m[i], 0))")
    rows = packed.select("seq_no", "range", F.lit(width).alias("width"), cells.alias("words"))
    rows.repartitionByRange("seq_no", "range").sortWithinPartitions("seq_no", "range").write.parquet(path)


def read_words(spark: SparkSession, path: str, seq_no: int, first: int, last: int, width: int = 4096) -> DataFrame:
    """(seq_no, pos, word) of the places ``first`` to ``last`` of a contig; only its ranges that hold them are read. ``width`` as written."""
    rows = spark.read.parquet(path).filter((F.col("seq_no") == seq_no) & F.col("range").between(first // width, last // width))
    each = rows.select("seq_no", "range", F.posexplode("words").alias("i", "word"))
    return each.select("seq_no", (F.col("range") * width + F.col("i")).alias("pos"), "word").filter(F.col("pos").between(first, last))
