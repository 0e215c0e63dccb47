"""Edit-distance neighbours, signposts (pivots) and nearest non-trivial seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import chebyshev, prefix_distance, relation_flags
from ..sources.storage import written
from .kmers import substrings

#: Distances to signposts stop here (a fixed value of the vector format).
CLAMP = 63
#: Seeds of a block at most, about, where pairs of blocks are compared, and seeds that a task compares with four times as many at once.
BLOCK, TILE = 1 << 14, 256


def edit_pairs(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(v, u, dist) of labels with edit distance below ``threshold``, by an equality join on shared deletions.

    Strings at distance below T share a string that each becomes by deleting at most T - 1 characters.
    """
    deletions = lambda rows, name: _cut_down(rows.select(F.col("label").alias(name)), name, threshold - 1)
    met = deletions(left, "v").join(deletions(right, "u"), "cut").select("v", "u").distinct()
    return met.withColumn("dist", F.levenshtein("v", "u", threshold - 1)).filter("dist >= 0")


def trie_pairs(labels: DataFrame, most: int, threshold: int) -> DataFrame:
    """(v, u, dist): as edit_pairs() of the labels of up to ``most`` bases and all labels, level by level of a trie.

    ``labels``: every node (label) of a trie, each with its prefixes; the root is added. A pair below ``threshold`` comes
    from one at the level before, by one base more in v, in both, or in u, so each level joins the pairs of the last one
    with the nodes' children, and then as often as u may go on alone. Work grows with the pairs found, not with the ways
    to delete characters. Each level is written before the next one. Null labels have no pairs.
    """
    spark = labels.sparkSession
    nodes = labels.select("label").filter("label is not null").union(spark.createDataFrame([("",)], "label string")).distinct()
    nodes = written(nodes.withColumn("size", F.length("label")))
    kids = nodes.filter("size > 0").select(F.expr("left(label, size - 1)").alias("parent"), F.col("label").alias("child"), "size")
    near = lambda rows: rows.withColumn("dist", F.levenshtein("v", "u", threshold - 1)).filter("dist >= 0")
    longer = lambda rows: rows.join(kids, F.col("u") == F.col("parent")).select("v", F.col("child").alias("u"))
    pairs = found = written(nodes.filter(f"size < {threshold}").select(F.lit("").alias("v"), F.col("label").alias("u"), F.col("size").alias("dist")))
    for depth in range(1, most + 1):
        base = found.join(kids.filter(f"size = {depth}"), F.col("v") == F.col("parent")).select(F.col("child").alias("v"), "u")
        found = last = written(near(base.unionByName(longer(base)).distinct()))
        for _ in range(threshold - 1):
            last = near(longer(last.filter(f"dist < {threshold - 1}")).distinct()).join(found.select("v", "u"), ["v", "u"], "left_anti")
            last = written(last)
            found = found.unionByName(last)
        pairs = pairs.unionByName(found)
    return pairs.select("v", "u", "dist")


def flagged_pairs(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(v, u, dist, flag): pairs below ``threshold`` with the bits of their relation."""
    return edit_pairs(left, right, threshold).withColumn("flag", relation_flags("v", "u", threshold))


def position_tolerance(contigs: DataFrame, pairs: DataFrame, depth: int, most: int) -> DataFrame:
    """(seq_no, pos, ets) of every position: how far its label of ``depth`` bases is from the nearest unrelated one.

    ``pairs``: v, u, dist, flag, as of flagged_pairs(). ``most`` where no unrelated label is near; 0 where fewer than
    ``depth`` bases are left.
    """
    near = pairs.filter(f"flag = 0 and length(v) = {depth}").groupBy(F.col("v").alias("kmer")).agg(F.least(F.min("dist"), F.lit(most)).alias("ets"))
    full = substrings(contigs, depth).join(near, "kmer", "left").select("seq_no", "pos", F.coalesce("ets", F.lit(most)).alias("ets"))
    begin = F.greatest(F.length("seq") - (depth - 1), F.lit(0))
    ends = contigs.filter("length(seq) > 0").select("seq_no", F.explode(F.sequence(begin, F.length("seq") - 1)).alias("pos"), F.lit(0).alias("ets"))
    return full if depth == 1 else full.unionByName(ends)


def to_signpost(seeds: DataFrame, signpost: str) -> Column:
    return F.least(prefix_distance("seed", f"'{signpost}'"), F.lit(CLAMP))


def with_distances(seeds: DataFrame, signposts: list[str]) -> DataFrame:
    """(seed, distance): the distance vector of each seed, one entry for each signpost."""
    return seeds.select("seed", F.array(*[to_signpost(seeds, s) for s in signposts]).alias("distance"))


def modes(vectors: DataFrame, signposts: int) -> DataFrame:
    """One row with m0, m1, ...: the most frequent distance to each signpost, the smallest of equals."""
    return vectors.agg(*[F.mode(F.col("distance")[k], True).alias(f"m{k}") for k in range(signposts)])


def next_signpost(vectors: DataFrame, signposts: int) -> DataFrame:
    """(seed, distance, radius): the seed nearest to the modal vector by the largest difference, first in vector order."""
    modal = modes(vectors, signposts).select(F.array(*[f"m{k}" for k in range(signposts)]).alias("modal"))
    near = vectors.crossJoin(F.broadcast(modal)).withColumn("radius", chebyshev("distance", "modal"))  # one row
    return near.orderBy("radius", "distance", "seed").limit(1).select("seed", "distance", "radius")


def choose_signposts(seeds: DataFrame, first: str, count: int) -> list[str]:
    """Signposts one after another; each round measures all seeds against those so far."""
    chosen = [first]
    while len(chosen) < count:
        row = next_signpost(with_distances(seeds, chosen), len(chosen)).first()
        if row is None:
            break
        chosen.append(row.seed)
    return chosen


def _cut_down(rows: DataFrame, text: str, most: int) -> DataFrame:
    """``rows`` with ``cut``: ``text`` with every choice of up to ``most`` characters deleted, each string once a row."""
    kept = rows.withColumn("cuts", F.array(text))
    for _ in range(most):
        one = F.expr("flatten(transform(cuts, c -> transform(sequence(1, greatest(length(c), 1)), i -> concat(substring(c, 1, i - 1), substring(c, i + 1)))))")
        kept = kept.withColumn("cuts", F.array_distinct(F.concat("cuts", one)))
    return kept.withColumn("cut", F.explode("cuts")).drop("cuts")


def prefix_candidates(left: DataFrame, right: DataFrame, errors: int) -> DataFrame:
    """(seed, t): the pairs of different seeds that may be ``errors`` or fewer apart by prefix distance, and few others.

    One of the two, whole, is then that near to a prefix of the other, so both become the same string by deleting at most
    ``errors`` characters, and that string is at most as much shorter than the whole one. So pairs are joined by such
    strings: a seed meets those within twice ``errors`` edits of it, whatever the size of the table. The number of
    strings grows as the choices of ``errors`` of a seed's characters.
    """
    whole = lambda rows, name: _cut_down(rows.select(F.col("seed").alias(name)), name, errors).select(name, "cut").distinct()
    lengths = sorted(r[0] for r in left.select(F.length("seed")).union(right.select(F.length("seed"))).distinct().collect() if r[0] is not None)  # as many as the longest seed has characters, at most
    sizes = F.array(*[F.lit(j) for j in sorted({max(m + d, 0) for m in lengths for d in range(-errors, errors + 1)})]) if lengths else F.array(F.lit(0))

    def prefixes(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(F.col("seed").alias(name))
        cut = own.withColumn("j", F.explode(F.filter(sizes, lambda j: j <= F.length(name)))).withColumn("p", F.expr(f"left({name}, j)"))
        return _cut_down(cut, "p", errors).select(name, "cut").distinct()

    one = whole(left, "seed").join(prefixes(right, "t"), "cut").select("seed", "t")
    two = prefixes(left, "seed").join(whole(right, "t"), "cut").select("seed", "t")
    return one.unionByName(two).filter("seed != t").distinct()


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as a table, 0 beyond their ends, and their lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def _prefix_scores(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, limit: int) -> np.ndarray:
    """Prefix distance of each text of ``a`` and of ``b`` where it is below ``limit``, else ``limit``.

    Bit i of level d tells whether the first i letters of ``a`` are within d edits of the letters of ``b`` read so far.
    """
    wide = a.shape[1] + 1
    kind = next(t for t, bits in ((np.uint16, 16), (np.uint32, 32), (np.uint64, 64), (object, wide)) if wide <= bits)
    bit = np.array([1 << i for i in range(wide)], kind)
    alphabet = np.unique(b)
    masks = np.zeros((len(a), len(alphabet)), kind)
    for i in range(a.shape[1]):
        masks |= np.where((a[:, i, None] == alphabet) & (i < a_size)[:, None], bit[i + 1 : i + 2], bit[:1] * 0)
    inside = np.array([(1 << int(n) + 1) - 1 for n in a_size], kind)[:, None]
    last, code = bit[a_size][:, None], np.searchsorted(alphabet, b)
    shape = (len(a), len(b))
    score = np.full(shape, limit, np.uint8 if limit < 256 else np.int64)
    one = kind(1) if kind is not object else 1
    levels = [np.full(shape, (1 << d + 1) - 1 & (1 << wide) - 1, kind) & inside for d in range(limit)]

    def note(on: np.ndarray) -> None:
        done = b_size <= on  # the text of b is at its end: any part of a will do
        for d in range(limit - 1, -1, -1):
            met = (levels[d] & np.where(done, inside, last)) != 0
            score[met] = np.minimum(score[met], d)

    note(0)
    for j in range(b.shape[1]):
        own, before = masks[:, code[:, j]], None
        going = (j < b_size)[None, :]
        for d in range(limit):
            old = levels[d]
            new = (old << one) & own
            if d:
                new |= before | (before << one) | (levels[d - 1] << one)
            levels[d], before = np.where(going, new & inside, old), old
        note(j + 1)
    return score


def _shifted(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, score: np.ndarray) -> np.ndarray:
    """As functions.sequence.pure_shift(), row by row."""

    def begins(x: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray) -> np.ndarray:
        rest = np.maximum(y_size - score, 0)
        same = rest <= x_size
        for i in range(x.shape[1]):
            at = np.minimum(i + score, y.shape[1] - 1)
            same &= (i >= rest) | (x[:, i] == y[np.arange(len(y)), at])
        return same

    return begins(a, a_size, b, b_size) | begins(b, b_size, a, a_size)


def nearest_nontrivial(queries: DataFrame, database: DataFrame, limit: int) -> DataFrame:
    """(seed, closest): the least prefix distance below ``limit`` to another seed that is no pure shift; else ``limit``.

    Seeds count if they lie within ``limit`` of each other in every signpost distance. Seeds with N take no part, nor do
    null ones. Every query is held against every seed, in pairs of blocks that tasks share, since seeds of so few bases lie
    close together and the pairs that prefix_candidates() meets are too many to be moved. A pair costs some bit operations,
    and only the least score of a query in a block leaves a task: work grows with the pairs, rows moved with the blocks.
    """
    known = lambda rows: written(rows.filter("not contains(seed, 'N')").select("seed", F.col("distance").cast("array<int>").alias("distance")).distinct())
    q, d = known(queries), known(database)
    blocks = lambda n: max(-(-n // BLOCK), min(24, -(-n // 1024)), 1)
    own, other = blocks(q.count()), blocks(d.count())
    number = lambda n: F.pmod(F.xxhash64("seed", "distance"), F.lit(n)).cast("int")
    left = q.select("seed", "distance", number(own).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("j"))
    right = d.select("seed", "distance", F.explode(F.sequence(F.lit(0), F.lit(own - 1))).alias("i"), number(other).alias("j"))

    def least(a: pa.Table, b: pa.Table) -> pa.Table:
        closest = np.full(len(a), limit)
        seeds, targets = a.column("seed").to_pylist(), b.column("seed").to_pylist()
        (x, x_size), (y, y_size) = _letters(seeds), _letters(targets)
        many = max((len(v or []) for c in (a, b) for v in c.column("distance").to_pylist()), default=0)
        far = [np.array([[np.nan if e is None else e for e in v or []] + [np.nan] * (many - len(v or [])) for v in c.column("distance").to_pylist()], float).reshape(len(c), many) for c in (a, b)]
        for r in range(0, len(a) if len(b) else 0, TILE):
            for s in range(0, len(b), 4 * TILE):
                rows, cols = slice(r, r + TILE), slice(s, s + 4 * TILE)
                score = _prefix_scores(x[rows], x_size[rows], y[cols], y_size[cols], limit)
                at, to = np.nonzero(score < limit)
                score, at, to = score[at, to].astype(np.int64), at + r, to + s
                apart = np.abs(far[0][at] - far[1][to])
                keep = (np.where(np.isnan(apart), -1, apart).max(axis=1, initial=-1) >= 0) & ~(apart > limit).any(axis=1)
                at, to, score = at[keep], to[keep], score[keep]
                width = max(x.shape[1], y.shape[1])
                u, v = (np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in (x[at], y[to]))
                keep = ~_shifted(u, x_size[at], v, y_size[to], score) & ~((u == v).all(axis=1) & (x_size[at] == y_size[to]))
                np.minimum.at(closest, at[keep], score[keep])
        return pa.table({"seed": a.column("seed"), "closest": pa.array(closest.astype(np.int32))}).filter(pa.array(closest < limit))

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(least, "seed string, closest int").groupBy("seed").agg(F.min("closest").alias("closest"))
    return q.select("seed").distinct().join(best, "seed", "left").withColumn("closest", F.coalesce("closest", F.lit(limit)))


def exclude_origins(candidates: DataFrame, origins: DataFrame, band: int, by: tuple[str, ...] = ("seq_no",)) -> DataFrame:
    """The candidates (by..., pos, ...) that lie further than ``band`` from every origin (by..., pos).

    Both are joined by equality on ranges of band + 1 places: an origin also stands in the ranges beside its own.
    """
    wide = band + 1
    keys = [F.col(c).alias(f"o_{c}") for c in by]
    near = origins.select(*keys, F.col("pos").alias("o_pos"), F.explode(F.expr(f"transform(array(-1, 0, 1), i -> floor(pos / {wide}) + i)")).alias("o_bin"))
    at = (F.floor(F.col("pos") / wide) == F.col("o_bin")) & (F.abs(F.col("pos") - F.col("o_pos")) <= band)
    for c in by:
        at = at & (F.col(c) == F.col(f"o_{c}"))
    return candidates.join(near, at, "left_anti")


def signpost_loop(seeds: DataFrame, first: str, count: int) -> DataFrame:
    """(place, signpost, mode): ``count`` signposts one after another, each with the most frequent distance to it."""
    chosen = choose_signposts(seeds, first, count)
    modal = modes(with_distances(seeds, chosen), len(chosen))
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("place"), F.lit(s).alias("signpost"), F.col(f"m{k}").cast("long").alias("mode")) for k, s in enumerate(chosen)])
    return modal.select(F.inline(rows))
