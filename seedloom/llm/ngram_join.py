"""N-gram Jaccard self-join of documents by a token-group matrix.

A document's set holds its distinct word shingles as 64-bit hashes. Two documents link when
100 * intersection >= percent * union. Equal sets are one node from the start. The links that decide the components
are found exactly; links inside a component that is already joined need not be listed.

1. Order. One global order of shingles: first those that are not frequent, by hash, then the FREQUENT most frequent of
   the whole corpus by rising frequency. Frequencies come from all documents, as 40-bit hashes exchanged in sorted
   blocks; they set the order, which is good for speed, and any order gives the same links. Linked documents share a
   shingle among their first n - ceil(percent * n / 100) + 1.
2. Rare shingles. Pairs that share a rare one of their first shingles are joined on it, in sorted blocks of keys, and
   dropped when the shingles missed before the last shared one leave too few to reach the threshold. Lists of more than
   LIST documents are not paired here: they are treated as those of frequent shingles.
3. Groups. Documents that share only frequent first shingles are near copies of something common. In each such
   shingle's list all documents are compared with one leader, the one with the fewest rare shingles. What links so far
   is grouped: a group holds at most about GROUP documents of one component that have the same size and number of rare
   shingles.
4. Token-group matrix. Groups of different components that share a frequent first shingle qualify when the shingles
   that are not rare suffice for the threshold. For a qualifying pair, each query document's overlap with the other
   group's token union bounds its overlap with any member; only groups that reach the bound are opened and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import BitmapFilter, without
from .components import components
from .util import broadcast_value, checkpointed, chunks, fold_case, mix, release_memory, small, span_hashes, text_bytes, top_by_count, word_spans

#: Shingles that the order knows as frequent: 16 MB in a broadcast.
FREQUENT = 1 << 20
#: Documents that hold a frequent shingle, at least.
LEAST = 8
#: Documents whose pairs are formed for a shingle that is not frequent, at most.
LIST = 64
#: Documents of one group, about, and partners that are compared with one document in one place.
GROUP = 64
PARTNERS = 256
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text laid end to end, and len + 1 offsets.

    A text with fewer words than ``words`` has its whole sequence as its one shingle; one without words has none.
    """
    data, offsets = text_bytes(column)
    data = fold_case(data)
    starts, ends, row = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    n = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.cumsum(n) - n
    keys, rows = [], []
    for size in range(1, words + 1):
        if size == words:
            at = np.arange(len(h) - words + 1) if len(h) >= words else np.empty(0, np.int64)
            at = at[row[at] == row[at + words - 1]]
        else:
            at = begin[n == size]
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total = total + h[at + k] * _FACTORS[k]
        keys.append(mix(total))
        rows.append(row[at])
    key, of_row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, of_row))
    key, of_row = key[order], of_row[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (of_row[1:] != of_row[:-1])])[: len(key)]
    key, of_row = key[fresh], of_row[fresh]
    return key, np.concatenate([[0], np.cumsum(np.bincount(of_row, minlength=len(offsets) - 1))]).astype(np.int64)


def signatures(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, sums over its hashes; equal sets have equal ones."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(salt)))])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, the lowest of all first: high bytes, mostly zero, lie together."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(blob: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def bucket_bits(df: DataFrame) -> int:
    """Leading bits of a shingle's hash that deal shingles to blocks: about 16 MB of texts ``t`` each."""
    size = df.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(8, int(size >> 24).bit_length())


def frequent_shingles(df: DataFrame, words: int) -> DataFrame:
    """(short, n): the 40-bit shingle hashes in LEAST documents or more, with their numbers, over the texts ``t``."""
    bits = bucket_bits(df)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            short, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = (short >> np.uint64(40 - bits)).astype(np.int64)
            low = (short & np.uint64((1 << (40 - bits)) - 1)).astype(np.uint32)
            used, first = np.unique(bucket, return_index=True)
            blobs = []
            for part, n in zip(np.split(low, first[1:]), np.split(times.astype(np.uint32), first[1:]), strict=True):
                blobs.append(_planes(np.diff(part, prepend=np.uint32(0))) + _planes(n))
            return pa.RecordBatch.from_arrays([pa.array(used), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for part in chunks(batches, "t"):
            held.append(shingle_sets(part.column("t"), words)[0] >> np.uint64(24))
            if sum(map(len, held)) > 700_000:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        own = table.column("bucket")[0].as_py()
        parts, times = [], []
        for blob in table.column("blob").to_pylist():
            parts.append(np.cumsum(_from_planes(blob[: len(blob) // 2], np.uint32), dtype=np.uint32))
            times.append(_from_planes(blob[len(blob) // 2 :], np.uint32))
        low, n = np.concatenate(parts), np.concatenate(times).astype(np.int64)
        order = np.argsort(low)
        low = low[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.add.reduceat(n[order], first)
        many = n >= LEAST
        short = (own << (40 - bits)) + low[first[many]].astype(np.int64)
        return pa.table({"short": pa.array(short), "n": pa.array(n[many].astype(np.int64))})

    lists = df.select("t").mapInArrow(blocks, "bucket long, blob binary")
    return lists.groupBy("bucket").applyInArrow(count, "short long, n long")


@lru_cache(maxsize=1)
def _frequent(shared):
    return shared.value


def first_shingles(df: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of (r, i, h, t): r, i, h, n, s1, s2, rare (shingles that are not frequent), first (keys in the global order)."""
    shared = broadcast_value(df.sparkSession, frequent)
    kind = df.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t"):
            short, rank_of = _frequent(shared)
            keys, offsets = shingle_sets(part.column("t"), words)
            n = np.diff(offsets)
            s1, s2 = signatures(keys, offsets)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(keys), np.int64)
            if len(short):
                own = (keys >> np.uint64(24)).astype(np.int64)
                at = np.minimum(np.searchsorted(short, own), len(short) - 1)
                rank = np.where(short[at] == own, rank_of[at], 0)
            keys = keys[np.lexsort((keys, rank, row))]
            rare = np.bincount(row, rank == 0, len(n)).astype(np.int64)
            take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            ends = np.concatenate([[0], np.cumsum(take)])
            first = keys[np.repeat(offsets[:-1] - ends[:-1], take) + np.arange(ends[-1])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("r"), part.column("i"), part.column("h"), pa.array(n), pa.array(s1), pa.array(s2), pa.array(rare), lists],
                names=["r", "i", "h", "n", "s1", "s2", "rare", "first"],
            )

    return df.mapInArrow(run, f"r long, i {kind}, h long, n long, s1 long, s2 long, rare long, first array<long>")


def needed(a: str, b: str, percent: int) -> str:
    """The intersection that sets of two sizes need, at least, in SQL."""
    return f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}"


def rare_pairs(nodes: DataFrame, bits: int, percent: int, most: int = LIST) -> DataFrame:
    """(key, a, na, pa, b, nb, pb) of nodes (r, n, rare, first) that share a first shingle that is not frequent.

    a < b are nodes, n their sizes and p the shingle's place in each. A shingle with more than ``most`` nodes gives one row
    for each of them, with b null.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            key, r, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            key, r, n, pos = key[order], r[order], n[order].astype(np.uint32), pos[order].astype(np.uint32)
            used, first = np.unique(key >> np.uint64(64 - bits), return_index=True)
            blobs, base = [], r.min()
            for some in np.split(np.arange(len(key)), first[1:]):
                gaps = np.diff(key[some], prepend=np.uint64(0))
                blobs.append(pa.compress(_planes(gaps) + _planes((r[some] - base).astype(np.uint64)) + _planes(n[some]) + _planes(pos[some]), "zstd", asbytes=True))
            sizes = np.diff(np.concatenate([first, [len(key)]]))
            return pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int64)), pa.array(np.full(len(used), base)), pa.array(sizes), pa.array(blobs, pa.binary())], names=["bucket", "base", "k", "blob"]
            )

        for batch in batches:
            first, rare = batch.column("first"), batch.column("rare").to_numpy()
            size = np.minimum(pc.list_value_length(first).to_numpy(), rare)
            begin = first.offsets.to_numpy()[:-1]
            ends = np.cumsum(size)
            pos = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
            key = first.values.to_numpy()[np.repeat(begin, size) + pos].view(np.uint64)
            held.append((key, np.repeat(batch.column("r").to_numpy(), size), np.repeat(batch.column("n").to_numpy(), size), pos))
            if sum(len(x[0]) for x in held) > 400_000:
                yield flush()
        if sum(len(x[0]) for x in held):
            yield flush()
        release_memory()

    def met(table: pa.Table) -> pa.Table:
        parts = []
        for base, k, blob in zip(*(table.column(c).to_pylist() for c in ("base", "k", "blob")), strict=True):
            raw = pa.decompress(blob, 24 * k, "zstd", asbytes=True)
            key = np.cumsum(_from_planes(raw[: 8 * k], np.uint64), dtype=np.uint64)
            r = _from_planes(raw[8 * k : 16 * k], np.uint64).astype(np.int64) + base
            parts.append((key, r, _from_planes(raw[16 * k : 20 * k], np.uint32).astype(np.int64), _from_planes(raw[20 * k :], np.uint32).astype(np.int64)))
        key, r, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((r, key))
        key, r, n, pos = key[order], r[order], n[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        size = np.repeat(size, size)
        alone = np.flatnonzero(size > most)
        one, two = [alone], [np.full(len(alone), -1)]
        for step in range(1, min(most, int(size[size <= most].max(initial=1)))):
            i = np.flatnonzero((key[:-step] == key[step:]) & (size[:-step] <= most))
            i = i[100 * np.minimum(n[i], n[i + step]) >= percent * np.maximum(n[i], n[i + step])]
            one.append(i)
            two.append(i + step)
        i, j = np.concatenate(one), np.concatenate(two)
        other = lambda x: pa.array(x[j], mask=j < 0)
        del parts, order, size, first, one, two
        release_memory()
        return pa.table({"key": key[i].view(np.int64), "a": r[i], "na": n[i], "pa": pos[i], "b": other(r), "nb": other(n), "pb": other(pos)})

    lists = nodes.select("r", "n", "rare", "first").mapInArrow(dealt, "bucket long, base long, k long, blob binary")
    return lists.groupBy("bucket").applyInArrow(met, "key long, a long, na long, pa long, b long, nb long, pb long")


def compare(pairs: DataFrame, packs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of the paired groups.

    pairs: (g1, g2); packs: (g, members array<long>, sizes array<long>, tokens binary), bounded. A group is sent once to
    its partners, PARTNERS of them at a time, and each partner once to it; they meet in sorted partitions, one after
    another. For every document of the one group, its overlap with the other group's token union bounds the overlap
    with each member; the group is opened only for documents whose bound reaches what the smallest fitting member
    would need.
    """

    def unpack(sizes: list[int], tokens: bytes) -> list[np.ndarray]:
        return np.split(np.frombuffer(tokens, np.uint64), np.cumsum(sizes)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                own, members, sizes, tokens = (batch.column(c)[k].as_py() for c in ("own", "members", "sizes", "tokens"))
                group = unpack(sizes, tokens)
                if own:
                    queries = list(zip(members, group, strict=True))
                    continue
                union = np.unique(np.frombuffer(tokens, np.uint64)) if len(group) > 1 else group[0]
                low = min(sizes)
                for doc, query in queries:
                    n = len(query)
                    bound = len(np.intersect1d(query, union, assume_unique=True))
                    least = max(low, -(-percent * n // 100))
                    if bound * (100 + percent) < percent * (n + least):
                        continue
                    for member, other in zip(members, group, strict=True):
                        same = bound if len(group) == 1 else len(np.intersect1d(query, other, assume_unique=True))
                        if 100 * same >= percent * (n + len(other) - same):
                            a.append(doc)
                            b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    many = small(pairs.groupBy("g1").agg(F.count("*").alias("k")).filter(F.col("k") > PARTNERS))
    part = F.coalesce(F.pmod(F.xxhash64("g2"), F.ceil(F.col("k") / PARTNERS)), F.lit(0)).alias("part")
    dealt = pairs.join(many, "g1", "left").select("g1", part, "g2")
    sent = dealt.select("g1", "part", F.lit(False).alias("own"), F.col("g2").alias("g"))
    sent = sent.unionAll(dealt.select("g1", "part", F.lit(True), "g1").distinct())
    place = ["g1", "part"]
    met = sent.join(packs, "g").repartition(*place).sortWithinPartitions(*place, F.desc("own"))
    return met.select("own", "members", "sizes", "tokens").mapInArrow(run, "a long, b long")


def jaccard_components(df: DataFrame, text: str = "text", doc: str = "doc_id", words: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc, n_shingles, component_id (the smallest id that links lead to, the row's own included).

    Null and empty texts, and texts without words, have no shingles and link with nothing. Repeated rows give repeated
    results. A null id counts as larger than any other. Other columns of ``df`` are ignored; an empty table gives no rows.
    """
    out = _labelled(df, text, doc, words, percent)
    return out.select(F.col("i").alias(doc), F.col("n").alias("n_shingles"), F.coalesce("component", "i").alias("component_id"))


def _labelled(df: DataFrame, text: str, doc: str, words: int, percent: int) -> DataFrame:
    """Per row: i (its id), h (a hash of its text), n (its shingles), component (null for rows that link with nothing)."""
    own = df.select(F.monotonically_increasing_id().alias("r"), F.col(doc).alias("i"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    counts = checkpointed(frequent_shingles(own, words))
    top = top_by_count(counts, "n", ["short"], FREQUENT).toArrow()
    short, n = top.column("short").to_numpy(), top.column("n").to_numpy()
    rank, order = np.empty(len(short), np.int64), np.argsort(short)
    rank[np.lexsort((short, n))] = np.arange(1, len(short) + 1)
    docs = checkpointed(first_shingles(own, words, percent, (short[order], rank[order])))

    same = ["n", "s1", "s2"]
    nodes = docs.filter("n > 0").groupBy(same).agg(F.min("r").alias("node"), F.min("i").alias("least"))
    nodes = checkpointed(nodes)
    copies = docs.filter("n > 0").select("r", *same).join(nodes.select(*same, "node"), same).filter("r != node").select("r")
    singles = without(docs.filter("n > 0"), "r", copies)

    # rare first shingles: pairs of nodes, with the shingles that they miss
    met = checkpointed(rare_pairs(singles, bucket_bits(own), percent, LIST))
    lists = met.filter("b is null").select("key", F.col("a").alias("r"), F.col("na").alias("n"), F.col("pa").alias("pos"))
    pairs = met.filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("c"), *[F.max(x).alias(x) for x in ("na", "nb", "pa", "pb")])
    # shared shingles of longer lists are not among the c
    long_lists = lists.groupBy("r").agg(F.count("*").alias("k"))
    long_lists = small(checkpointed(long_lists))
    for side in ("a", "b"):
        pairs = pairs.join(long_lists.select(F.col("r").alias(side), F.col("k").alias(f"k{side}")), side, "left")
    need = needed("na", "nb", percent)
    pairs = pairs.filter(f"pa + 1 - c - coalesce(ka, 0) <= na - {need} and pb + 1 - c - coalesce(kb, 0) <= nb - {need}").select("a", "b")

    # frequent first shingles, and longer lists: everything against the leader of each shingle's list. Two documents
    # that have no earlier shingle in common share ``left`` of each at most.
    often = singles.select("r", "n", "rare", F.posexplode(F.expr("slice(first, cast(rare as int) + 1, size(first))")).alias("pos", "key"))
    often = often.select("key", "r", "n", "rare", F.expr("n - rare").alias("left"))
    longer = lists.join(singles.select("r", "rare"), "r").select("key", "r", "n", "rare", F.expr("n - pos").alias("left"))
    often = checkpointed(often.unionAll(longer))
    rank_of = F.struct((F.col("left") / F.col("n")).alias("q"), (-F.col("r")).alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    leaders = often.groupBy("key").agg(F.max(rank_of).alias("x")).select("key", "x.*").withColumn("b", -F.col("b"))
    enough = f"{needed('n', 'nb', percent)} <= least(left, lb)"
    stars = often.join(leaders, "key").filter(f"r != b and 100 * least(n, nb) >= {percent} * greatest(n, nb) and {enough}")
    stars = stars.select(F.least("r", "b").alias("a"), F.greatest("r", "b").alias("b"))
    pairs = checkpointed(pairs.unionAll(stars).distinct())

    # shingles of the nodes that are in pairs, or in lists of frequent shingles
    wanted = pairs.select(F.col("a").alias("r")).unionAll(pairs.select(F.col("b").alias("r"))).unionAll(often.select("r")).distinct()
    wanted = checkpointed(docs.select("r", "i", *same).join(wanted, "r"))
    sets = checkpointed(token_sets(own, wanted, words))
    packs = sets.select(F.col("node").alias("g"), F.array("node").alias("members"), F.array("n").alias("sizes"), "tokens")
    links = checkpointed(compare(pairs.select(F.col("a").alias("g1"), F.col("b").alias("g2")), packs, percent))
    roots = checkpointed(components(links))

    # token-group matrix over what is left
    grouped = often.select("r", "n", "rare").distinct().join(roots.select(F.col("node").alias("r"), "root"), "r", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "r"))
    kinds = ["root", "n", "rare"]
    size = grouped.groupBy(kinds).agg(F.count("*").alias("k"))
    # a group's number: its class, and a slice of it where the class is large
    grouped = grouped.join(size, kinds).withColumn("slice", F.pmod(F.xxhash64("r"), F.ceil(F.col("k") / GROUP)))
    grouped = checkpointed(grouped.withColumn("g", F.xxhash64(*kinds, "slice")))
    matrix = often.select("key", "r", "left").join(grouped.select("r", "root", "n", "g"), "r")
    matrix = matrix.groupBy("key", "root", "n", "g").agg(F.max("left").alias("left"))
    one = matrix.select("key", F.col("root").alias("r1"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("g").alias("g1"))
    two = matrix.select("key", F.col("root").alias("r2"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("g").alias("g2"))
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    bound = f"r1 < r2 and {fits} and {need} <= least(la, lb)"
    open_pairs = checkpointed(one.join(two, "key").filter(bound).select("g1", "g2").distinct())
    in_pairs = open_pairs.select(F.col("g1").alias("g")).unionAll(open_pairs.select(F.col("g2").alias("g"))).distinct()
    members = grouped.join(in_pairs, "g", "left_semi").select("g", F.col("r").alias("node")).join(sets, "node")
    rows = F.sort_array(F.collect_list(F.struct("node", "n", "tokens")))  # about GROUP rows
    packs = members.groupBy("g").agg(rows.alias("x")).select(
        "g", F.col("x.node").alias("members"), F.col("x.n").alias("sizes"), F.expr("aggregate(x.tokens, cast('' as binary), (s, t) -> s || t)").alias("tokens")
    )
    more = compare(open_pairs, packs, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(checkpointed(more)))

    named = roots.join(nodes.select("node", "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.select("node", "root").join(least, "root").select("node", "component")
    labels = nodes.join(named, "node", "left").select(*same, F.coalesce("component", "least").alias("component"))
    return docs.select("i", "h", *same).join(labels, same, "left").select("i", "h", "n", "component")


def token_sets(own: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, n, tokens) of the wanted nodes (r, i, n, s1, s2), read again from the texts of ``own`` (r, i, t).

    A filter on the ids lets through the rows that may be wanted; the sets' digests decide.
    """
    rows = BitmapFilter(wanted.select("i")).marked(own.select("i", "t"), "i", "maybe").filter("maybe").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t"):
            keys, offsets = shingle_sets(part.column("t"), words)
            s1, s2 = signatures(keys, offsets)
            raw = memoryview(keys.tobytes())
            blobs = [bytes(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.diff(offsets)), pa.array(s1), pa.array(s2), pa.array(blobs, pa.binary())], names=["n", "s1", "s2", "tokens"]
            )

    found = rows.mapInArrow(run, "n long, s1 long, s2 long, tokens binary")
    same = ["n", "s1", "s2"]
    found = found.join(wanted.select(F.col("r").alias("node"), *same), same)
    found = found.groupBy(*same).agg(F.first("node").alias("node"), F.first("tokens").alias("tokens"))  # dealt as it was joined
    return found.select("node", "n", "tokens")


def keep_one(df: DataFrame, text: str = "text", doc: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component, all columns; rows without an id stay.

    A row goes by its id and its own text: where ids repeat, another text with the same id is judged for itself.
    """
    found = _labelled(df, text, doc, words, percent).filter("i != component").select(F.xxhash64("i", "h").alias("k"))
    keyed = df.withColumn("__key", F.when(F.col(doc).isNotNull(), F.xxhash64(doc, F.xxhash64(text))))
    return without(keyed, "__key", found).select(df.columns)
