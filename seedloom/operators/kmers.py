"""Substrings of contigs: positions, counts, the depth-limited trie and what is looked up in them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ordered import ranges, running
from .packed import KINDS, ROOM, blocks, dealt, gathered, numbered, padded, spread, unpacked, weighed

#: Bases of the pieces that contigs are cut into before their substrings are taken, at least.
PIECE = 256
#: Substrings that a task holds at once.
SLICE = 1 << 18


def pieces_of(contigs: DataFrame, k: int) -> DataFrame:
    """(seq_no, begin, own, piece): contigs in pieces of ``own`` bases, each with the k - 1 that follow it.

    A contig is walked through once, so the work grows with its length and no row holds it beside its substrings.
    """
    wide = max(PIECE, 8 * k)
    parts = contigs.select("seq_no", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{wide}}}"), F.lit(0)).alias("p"))
    each = F.expr(f"explode(transform(p, (x, i) -> struct(i * {wide} as begin, length(x) as own, concat(x, left(coalesce(get(p, i + 1), ''), {k - 1})) as piece)))")
    return parts.select("seq_no", each.alias("x")).select("seq_no", "x.*")


def substrings(contigs: DataFrame, k: int) -> DataFrame:
    """(seq_no, pos, kmer) of every substring of length ``k``; none crosses contigs. Null and short contigs have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, texts in _long_enough(batches, k):
            for row, pos, kmers in _places(texts, k):
                yield pa.RecordBatch.from_arrays([numbers.take(pa.array(row)), pa.array(pos.astype(np.int32)), kmers], names=["seq_no", "pos", "kmer"])

    return contigs.select("seq_no", "seq").mapInArrow(run, f"seq_no {contigs.schema['seq_no'].dataType.simpleString()}, pos int, kmer string")


def _long_enough(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Numbers and texts of the contigs of ``k`` characters or more."""
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.greater_equal(pc.utf8_length(batch.column("seq")), k), False))
        if batch.num_rows:
            yield batch.column("seq_no"), batch.column("seq").cast(pa.large_string())


def _places(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row, place and substring of ``k`` characters, about SLICE at once, of texts that have ``k`` or more."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)
    if (data[at[0] : at[-1]] >= 128).any():  # places are characters, not bytes
        for row, text in enumerate(texts.to_pylist()):
            for first in range(0, len(text) - k + 1, SLICE):
                pos = np.arange(first, min(first + SLICE, len(text) - k + 1))
                yield np.full(len(pos), row), pos, pa.array([text[p : p + k] for p in pos])
        return
    ends = np.cumsum(np.diff(at) - (k - 1))  # of each row's places among all
    for first in range(0, int(ends[-1]), SLICE):
        number = np.arange(first, min(first + SLICE, int(ends[-1])))
        row = np.searchsorted(ends, number, side="right")
        start = number + at[0] + row * (k - 1)
        low, high = start[0], start[-1] + k
        letters = np.lib.stride_tricks.sliding_window_view(data[low:high], k)[start - low]
        size = pa.py_buffer(np.arange(0, len(number) * k + 1, k, dtype=np.int32))
        yield row, start - at[row], pa.StringArray.from_buffers(len(number), size, pa.py_buffer(np.ascontiguousarray(letters)))


def locations(contigs: DataFrame, k: int, at_least: int, only: DataFrame | None = None) -> DataFrame:
    """(kmer, seq_no, pos) of every place of the k-mers that occur ``at_least`` times; of those of ``only`` (kmer), if given."""
    counts = counts_by_batch(contigs, k) if only is None else counts_by_batch(contigs, k).join(only.select("kmer").distinct(), "kmer", "left_semi")
    frequent = counts.groupBy("kmer").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least).select("kmer")
    return substrings(contigs, k).join(frequent, "kmer", "left_semi").select("kmer", "seq_no", "pos")


def counts_by_batch(contigs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): counted in each batch only, so a k-mer may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _long_enough(batches, k):
            for _, _, kmers in _places(texts, k):
                counts = kmers.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["kmer", "n"])

    return contigs.select("seq_no", "seq").mapInArrow(run, "kmer string, n long")


def kmer_counts(contigs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): counted in each batch, then over all."""
    return counts_by_batch(contigs, k).groupBy("kmer").agg(F.sum("n").alias("n"))


def repeated_kmers(contigs: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of those that occur more than once, counted as packed numbers; such as hold other letters than ACGTN, one by one."""
    if not 0 < k <= 27:  # one number of base 5 holds no more
        return kmer_counts(contigs, k).filter("n > 1")
    many = blocks(contigs.sparkSession)
    digit = np.full(256, 5, np.uint8)
    digit[[ord(c) for c in "ACGTN"]] = range(5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _long_enough(batches, k):
            odd = pc.match_substring_regex(texts, "[^ACGTN]").to_numpy(zero_copy_only=False)
            for row, _, kmers in _places(texts.filter(pa.array(odd)), k) if odd.any() else ():
                strange = kmers.filter(pc.match_substring_regex(kmers, "[^ACGTN]")).value_counts()
                names = [t.encode() for t in strange.field("values").to_pylist()]
                if names:
                    columns = [pa.array([zlib.crc32(t) % many for t in names], pa.int32()), pa.array([1] * len(names), pa.int8()), strange.field("counts"), pa.array([(1).to_bytes(8, "little") + t for t in names]), pa.nulls(len(names), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "kind", "own", "packed", "more"])
            ends = np.cumsum(pc.utf8_length(texts).to_numpy()) // ROOM
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                few = texts.slice(int(part[0]), len(part))
                few = pc.replace_substring_regex(few, "[^\\x00-\\x7F]", "?") if odd.any() else few
                digits, at, _, _ = padded(few, k, digit, 5)
                bad = np.append(0, np.cumsum(digits == 5))
                at = at[bad[at + k] == bad[at]]
                for i in range(0, len(at), ROOM):
                    codes, n = weighed(numbered(digits, at[i : i + ROOM], k, 5))
                    yield spread(0, codes, codes, many, 0, n)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            codes, n = unpacked([x[2] for x in held.get(0, [])]), unpacked([x[3] for x in held.get(0, [])])
            if len(codes):
                order = np.argsort(codes)
                codes, n = codes[order], n[order]
                first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
                codes, n = codes[first], np.add.reduceat(n, first)
                codes, n = codes[n > 1], n[n > 1]
                letters = np.frombuffer(b"ACGTN", np.uint8)[codes[:, None] // 5 ** np.arange(k - 1, -1, -1) % 5]
                at = pa.py_buffer(np.arange(0, len(codes) * k + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(codes), at, pa.py_buffer(np.ascontiguousarray(letters))), pa.array(n)], names=["kmer", "n"])
            strange: dict[bytes, int] = {}
            for _, own, packed, _ in held.get(1, []):
                strange[packed[8:]] = strange.get(packed[8:], 0) + own
            more = {t.decode(): n for t, n in strange.items() if n > 1}
            if more:
                yield pa.RecordBatch.from_arrays([pa.array(list(more)), pa.array(list(more.values()), pa.int64())], names=["kmer", "n"])

    return dealt(contigs.select("seq_no", "seq").mapInArrow(run, KINDS)).mapInArrow(summed, "kmer string, n long")


def kmer_summary(contigs: DataFrame, k: int, at_least: int) -> DataFrame:
    """(kmer, n, seq_no, pos): frequent k-mers with their number and first position, in one aggregation; batches are summed up before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, texts in _long_enough(batches, k):
            rank = pc.rank(numbers, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
            for row, pos, kmers in _places(texts, k):
                each = kmers.dictionary_encode()
                order = np.lexsort((pos, rank[row], each.indices.to_numpy()))
                kinds = each.indices.to_numpy()[order]
                first = order[np.flatnonzero(np.diff(kinds, prepend=-1))]  # of each k-mer, in order of their numbers
                columns = [each.dictionary, pa.array(np.bincount(kinds)), numbers.take(pa.array(row[first])), pa.array(pos[first].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["kmer", "n", "seq_no", "pos"])

    first = F.min(F.struct("seq_no", "pos")).alias("p")
    parts = contigs.select("seq_no", "seq").mapInArrow(run, f"kmer string, n long, seq_no {contigs.schema['seq_no'].dataType.simpleString()}, pos int")
    found = parts.groupBy("kmer").agg(F.sum("n").alias("n"), first).filter(F.col("n") >= at_least)
    return found.select("kmer", "n", "p.seq_no", "p.pos")


def trie(contigs: DataFrame, depth: int) -> DataFrame:
    """(depth, label, freq): every substring of up to ``depth`` bases.

    The deepest level and the shorter ends of contigs are counted once; each level sums the one below it.
    """
    labels = F.explode(F.expr(f"transform(sequence(0, own - 1), i -> substring(piece, i + 1, {depth}))"))
    deepest = pieces_of(contigs, depth).select(labels.alias("label"))
    counted = deepest.groupBy("label").agg(F.count("*").alias("n"))
    cuts = counted.select("n", F.explode(F.expr("transform(sequence(1, length(label)), d -> substring(label, 1, d))")).alias("label"))
    return cuts.groupBy("label").agg(F.sum("n").alias("freq")).select(F.length("label").alias("depth"), "label", "freq")


def trie_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with node_id: breadth first, by label within a depth, the root 0. Numbered by ranges of that order."""
    order = ["depth", "label"]
    placed = ranges(nodes.select("depth", "label", "freq", F.lit(1).alias("one")), order)
    return running(placed, order, "one", "before").select("depth", "label", "freq", (F.col("before") + 1).alias("node_id"))


def trie_children(numbered: DataFrame, depth: int) -> DataFrame:
    """(node_id, label, child_offset, child_size) of nodes above ``depth`` that have children."""
    child = numbered.filter(f"depth > 1 and depth <= {depth}").select(F.expr("substring(label, 1, depth - 1)").alias("label"), F.col("node_id").alias("c"))
    return child.groupBy("label").agg(F.min("c").alias("child_offset"), F.count("*").alias("child_size")).join(
        numbered.select("label", "node_id"), "label"
    ).select("node_id", "label", "child_offset", "child_size")


def extensions(contigs: DataFrame, query: str, ext: int) -> DataFrame:
    """(pattern, n, seq_no, pos): each right extension of ``query`` by ``ext`` bases, with one location."""
    found = substrings(contigs.filter(F.col("seq").contains(query)), len(query) + ext).filter(F.col("kmer").startswith(query))
    first = F.min(F.struct("seq_no", "pos")).alias("p")
    return found.groupBy(F.col("kmer").alias("pattern")).agg(F.count("*").alias("n"), first).select("pattern", "n", "p.seq_no", "p.pos")


def majority_walk(nodes: DataFrame, start: int, end: int) -> DataFrame:
    """(label, walked, freq): from each label of ``start`` bases, the child with over half of the first count, down to ``end``."""
    at = nodes.filter(f"depth = {start}").select("label", F.col("label").alias("walked"), F.col("freq").alias("base"), "freq")
    for depth in range(start + 1, end + 1):
        child = nodes.filter(f"depth = {depth}").select(F.substring("label", 1, depth - 1).alias("walked"), F.col("label").alias("next"), F.col("freq").alias("f"))
        at = at.drop("freq").join(child, "walked").filter("f > 0.5 * base").select("label", F.col("next").alias("walked"), "base", F.col("f").alias("freq"))
    return at.select("label", "walked", "freq")


def units(reads: DataFrame, k: int) -> DataFrame:
    """(read_no, unit, kmer): the read cut into whole units of ``k`` bases."""
    many = F.floor((F.length("seq") / k).cast("double")).cast("int")
    return reads.filter(F.length("seq") >= k).select("read_no", "seq", F.explode(F.sequence(F.lit(0), many - 1)).alias("unit")).select(
        "read_no", "unit", F.expr(f"substring(seq, unit * {k} + 1, {k})").alias("kmer")
    )


def counted(seeds: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """``seeds`` (kmer) with n, how often each occurs in the contigs; 0 if it doesn't."""
    asked = seeds.select("kmer").distinct()
    found = kmer_counts(contigs, k).join(asked, "kmer", "left_semi")  # counted where they lie, then dealt
    return seeds.join(found, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pieces_at(at: DataFrame, contigs: DataFrame, length: int) -> DataFrame:
    """``at`` (seq_no, pos) with ``window``: the ``length`` bases from there on, fewer at the contig's end.

    Joined with pieces of the contigs by number and range of places, so no row carries a whole contig.
    """
    wide = max(PIECE, 8 * length)
    placed = at.withColumn("_begin", (F.floor(F.col("pos") / wide) * wide).cast("int"))
    pieces = pieces_of(contigs, length).select("seq_no", F.col("begin").alias("_begin"), F.col("piece").alias("_piece"))
    met = placed.join(pieces, ["seq_no", "_begin"])
    return met.withColumn("window", F.expr(f"substring(_piece, cast(pos - _begin as int) + 1, {length})")).select(*at.columns, "window")


def whole_windows(at: DataFrame, contigs: DataFrame, length: int) -> DataFrame:
    """``at`` (seq_no, pos) with ``window``, the ``length`` bases from there on; places where they run out are left out."""
    return pieces_at(at, contigs, length).filter(F.length("window") == length)


def windows(at: DataFrame, contigs: DataFrame, before: Column, length: int) -> DataFrame:
    """``at`` (seq_no, pos) with ``window``: ``length`` bases from ``before`` places earlier, cut at the contig's ends."""
    moved = at.withColumn("at", F.col("pos")).withColumn("pos", F.greatest(F.col("pos") - before, F.lit(0)))
    return pieces_at(moved, contigs, length).withColumn("pos", F.col("at")).drop("at")
