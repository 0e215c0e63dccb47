"""Quality classifier: an interpolated modified Kneser-Ney model of character 4-grams, trained on trusted text.

Characters are code points, all of them: none share a symbol, and the model gives each of Unicode's CHARACTERS a
probability, those that no trusted text holds an equal share of what the lowest order leaves. 4-grams of all trusted
texts are counted in Spark; counts of counts, context totals and continuation counts come from grouping those tables,
and the probabilities of each order from joins of the count tables, sharded by context, with the next lower order.

Nothing of the model is broadcast or reaches the driver. The corpus is packed into blocks of whole rows, about
BLOCK_BYTES of text each; a block's distinct 4-grams are joined with the count tables, by their keys, order by order
where a higher order lacks them, and their code lengths return to the block, which adds them up for each document. So a
common 4-gram is shuffled once a block, not once a document, and no key has more rows than there are blocks.

A text is rejected when its perplexity passes its language's threshold: the QUANTILE of the language's trusted texts,
times 2**SLACK, since those are the model's own training texts. Languages without trusted text take the quantile of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .bitmap import split_by_id
from .util import checkpointed, chunks, release_memory, small, text_bytes

#: Bits of a code point; START, before a text, is none.
BITS = 21
START = (1 << BITS) - 1
CHARACTERS = 0x110000
ORDER = 4
#: Quantile of the trusted texts' bits per character, and bits beyond it that are still accepted.
QUANTILE, SLACK = 0.99, 0.15
#: Characters that a text's own bits per character weigh against; shorter texts are drawn to their language's median.
PRIOR_CHARS = 100
#: Bytes of text in a block of rows, about, and in the parts of it that are held as numbers at once.
BLOCK_BYTES = 8 << 20
_PART = 1 << 19


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in column.to_pylist()]
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def four_grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 4-grams as the ORDER - 1 characters before (START before a text) and the character; each place's number."""
    seen = np.zeros(CHARACTERS, np.int64)
    seen[points] = 1
    letters = np.append(np.flatnonzero(seen), START)
    seen[letters[:-1]] = np.arange(len(letters) - 1)
    base, own = len(letters), seen[points]
    at, first = np.arange(len(points)), np.repeat(offsets[:-1], np.diff(offsets))
    code = np.zeros(len(points), np.int64)
    for back in range(ORDER - 1, 0, -1):
        before = np.full(len(points), base - 1, np.int64)
        before[back:] = own[:-back]
        code = code * base + np.where(at - back >= first, before, base - 1)
    contexts = None
    if base**ORDER >= 1 << 63:
        contexts, code = np.unique(code, return_inverse=True)
    code = code * base + own
    grams, place = np.unique(code.astype(np.uint32) if base**ORDER <= 1 << 32 else code, return_inverse=True)
    left, right = np.divmod(grams.astype(np.int64), base)
    left = left if contexts is None else contexts[left]
    context = sum(letters[left // base**k % base] << BITS * k for k in range(ORDER - 1))
    return context, letters[right], place


def _summed(held: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    context, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((c, context))
    context, c = context[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(context) != 0) | (np.diff(c) != 0)])) if len(c) else np.empty(0, np.int64)
    return [(context[first], c[first], np.add.reduceat(n[order], first) if len(c) else n)]


def counted(df: DataFrame) -> DataFrame:
    """(context, c, n) of all 4-grams of the rows' texts ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            own = _summed(held)[0]
            held.clear()
            for k in range(0, len(own[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 200_000]) for x in own], names=["context", "c", "n"])

        for part in chunks(batches, "t", _PART):
            context, c, place = four_grams(*code_points(part.column("t")))
            held.append((context, c, np.bincount(place, minlength=len(c)).astype(np.int64)))
            if len(held) >= 16:
                held[:] = _summed(held)
                if len(held[0][0]) > 1_000_000:
                    yield from flush()
        if held:
            yield from flush()

    return df.mapInArrow(run, "context long, c long, n long").groupBy("context", "c").agg(F.sum("n").alias("n"))


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Chen and Goodman's D1, D2, D3+ from the number of n-grams that occur once to four times."""
    n1, n2, n3, n4 = (max(1, x) for x in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(raw, 1)]


def probabilities(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (context, c, p) of the n-grams met, and (context, gamma) of their contexts.

    ``grams`` holds (context, c, n) of the highest order; lower orders count distinct left neighbours.
    """
    shorter = lambda order: F.col("context").bitwiseAND((1 << BITS * (order - 1)) - 1)
    levels = [grams]
    for order in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy(shorter(order).alias("context"), "c").agg(F.count("*").alias("n")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order, level in enumerate(reversed(levels), 1):
        level = checkpointed(level)
        times = {r.n: r.k for r in level.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
        d = discounts([times.get(k, 0) for k in (1, 2, 3, 4)])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        level = level.withColumn("cut", cut)
        contexts = level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        met = level.join(contexts, "context")
        if order == 1:
            lower = met.withColumn("below", F.lit(1.0 / CHARACTERS))
        else:
            below = out[-1][0].select(F.col("context").alias("suffix"), "c", F.col("p").alias("below"))
            lower = met.withColumn("suffix", shorter(order - 1)).join(below, ["suffix", "c"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("below")
        out.append((checkpointed(lower.select("context", "c", p.alias("p"))), contexts.select("context", "gamma")))
    return out


def train(df: DataFrame, text: str = "text") -> list[tuple[DataFrame, DataFrame]]:
    """The model of the texts of ``df``, all of them, as probabilities() has it; empty tables without any character."""
    return probabilities(checkpointed(counted(df.select(F.col(text).alias("t")).filter("t is not null"))))


def priced(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(context, c, p) of distinct n-grams (context, c) of the model's order, by joins with its tables.

    N-grams that an order has not met take their probability from the next lower one, by what their context leaves.
    """
    if not model:
        return grams.withColumn("p", F.lit(1.0 / CHARACTERS))
    met, contexts = model[-1]
    order = len(model)
    found = grams.join(met, ["context", "c"], "left").join(contexts, "context", "left")
    suffix = F.col("context").bitwiseAND((1 << BITS * max(0, order - 2)) - 1).alias("suffix")
    found = checkpointed(found.select("context", "c", "p", F.coalesce("gamma", F.lit(1.0)).alias("gamma"), suffix))
    lower = found.filter("p is null").select(F.col("suffix").alias("context"), "c").distinct()
    lower = priced(lower, model[:-1]).select(F.col("context").alias("suffix"), "c", F.col("p").alias("below"))
    left = found.filter("p is null").join(lower, ["suffix", "c"])
    return found.filter("p is not null").select("context", "c", "p").unionAll(left.select("context", "c", (F.col("gamma") * F.col("below")).alias("p")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows with texts ``t`` in blocks of about BLOCK_BYTES of it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in chunks(batches, "t", _PART):
        own = pc.sum(pc.binary_length(part.column("t"))).as_py() or 0
        if held and size + own > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield held
    held = []
    release_memory()


def _key(rows: list[pa.RecordBatch]) -> int:
    """A digest of a block's texts, so that a block that is built again is known again."""
    digest = hashlib.blake2b(digest_size=8)
    for part in rows:
        data, offsets = text_bytes(part.column("t"))
        digest.update(offsets.tobytes())
        digest.update(data)
    return int.from_bytes(digest.digest(), "little", signed=True)


class _Block:
    """A block's rows, its distinct 4-grams, and for each part of it which of them its characters end."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.rows = rows
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        grams, starts = [], [0]
        for part in rows:
            points, offsets = code_points(part.column("t"))
            context, c, place = four_grams(points, offsets)
            grams.append((context, c))
            self.parts.append((offsets, (place + starts[-1]).astype(np.int32)))
            starts.append(starts[-1] + len(c))
        context, c = (np.concatenate(x).astype(np.int64) for x in zip(*grams, strict=True))
        order = np.lexsort((c, context))
        fresh = np.concatenate([[True], (np.diff(context[order]) != 0) | (np.diff(c[order]) != 0)])[: len(order)]
        self.context, self.c = context[order][fresh], c[order][fresh]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(fresh) - 1

    def sums(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and bits of each row, from the bits of the distinct 4-grams."""
        n, total = [], []
        for offsets, place in self.parts:
            cost = bits[self.number[place]]
            own = np.zeros(len(offsets) - 1)
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                own[full] = np.add.reduceat(cost, offsets[full])
            n.append(np.diff(offsets))
            total.append(own)
        return np.concatenate(n), np.concatenate(total)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in rows:
                out.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([_key(rows)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])
        del rows, sink, part


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        own, key = _Block(rows), _key(rows)
        for k in range(0, len(own.c), 200_000):
            some = slice(k, k + 200_000)
            at = np.arange(k, k + len(own.c[some]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(at), pa.array(own.context[some]), pa.array(own.c[some])], names=["block", "at", "context", "c"])
        del rows, own


def with_bits(df: DataFrame, model: list[tuple[DataFrame, DataFrame]], keep_texts: bool) -> DataFrame:
    """``df``, with its text as ``t``, with k_chars and k_bits, the length and the code length of the whole text.

    Without ``keep_texts`` the result has ``t`` null. Blocks are cut twice, to ask and to add up. Should rows be dealt
    otherwise the second time, after executors were lost, blocks find no answers, and their rows are asked for again.
    """

    def added(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if not len(rows):
            return kinds.empty_table()
        at = answers.column("at").to_numpy()
        bits = np.full(at.max(initial=-1) + 1, np.nan)  # two blocks of the same texts ask twice, for the same
        bits[at] = -np.log2(answers.column("p").to_numpy())
        for blob in rows.column("rows"):
            own = None  # before the next one is built
            own = _Block(pa.ipc.open_stream(blob.as_buffer()).read_all().to_batches())
            there = len(bits) >= len(own.c)
            n, total = own.sums(bits if there else np.full(len(own.c), np.nan))
            table = pa.Table.from_batches(own.rows)
            if there and not keep_texts:
                table = table.set_column(table.column_names.index("t"), "t", pa.nulls(len(table), table.schema.field("t").type))
            out.append(table.append_column("k_chars", pa.array(n)).append_column("k_bits", pa.array(total if there else [None] * len(n), pa.float64())))
        del rows, own, bits
        release_memory()
        return pa.concat_tables(out)

    def scored(rows: DataFrame) -> DataFrame:
        requests = checkpointed(rows.mapInArrow(_asked, "block long, at int, context long, c long"))
        prices = checkpointed(priced(requests.select("context", "c").distinct(), model))
        answers = requests.join(prices, ["context", "c"]).select("block", "at", F.col("p").cast("float").alias("p"))
        blocks = rows.mapInArrow(_packed, "block long, rows binary")
        return checkpointed(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(added, f"{fields}, k_chars long, k_bits double"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    kinds = to_arrow_schema(df.schema).append(pa.field("k_chars", pa.int64())).append(pa.field("k_bits", pa.float64()))
    done = scored(df)
    while (lost := done.filter("k_bits is null").select(df.columns)).limit(1).count():
        done = done.filter("k_bits is not null").unionAll(scored(lost))
    return done


def judged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (k_id, k_lang, k_chars, k_bits, ...) with k_threshold, bits per character, and k_accepted."""
    of_trust = split_by_id(rows.select("k_id", "k_lang", "k_chars", "k_bits"), "k_id", ids)[0].filter("k_chars > 0")
    rate = F.col("k_bits") / F.col("k_chars")
    medians = checkpointed(of_trust.groupBy("k_lang").agg(F.percentile_approx(rate, 0.5, 10000).alias("k_median")))
    overall = of_trust.agg(F.percentile_approx(rate, 0.5, 10000).alias("k_overall"))

    def drawn(df: DataFrame) -> DataFrame:
        df = df.join(small(medians), "k_lang", "left").crossJoin(F.broadcast(overall))  # one row
        middle = F.coalesce("k_median", "k_overall")
        return df.withColumn("k_rate", (F.col("k_bits") + PRIOR_CHARS * middle) / (F.col("k_chars") + PRIOR_CHARS))

    trusted = drawn(of_trust)
    cut = F.percentile_approx("k_rate", QUANTILE, 10000)
    cuts = checkpointed(trusted.groupBy("k_lang").agg(cut.alias("k_cut")))
    out = drawn(rows).join(small(cuts), "k_lang", "left").crossJoin(F.broadcast(trusted.agg(cut.alias("k_all"))))  # one row
    out = out.withColumn("k_threshold", F.coalesce("k_cut", "k_all") + SLACK)
    inside = F.coalesce(F.col("k_rate") <= F.col("k_threshold"), F.lit(True))
    return out.withColumn("k_accepted", (F.col("k_chars") == 0) | inside)


def _scored(df: DataFrame, trusted: DataFrame, text: str, doc: str, lang: str, columns: list, keep_texts: bool) -> tuple[DataFrame, DataFrame]:
    ids = trusted.select(doc).distinct()
    model = train(split_by_id(df, doc, ids)[0], text)
    own = df.select(*columns, F.col(doc).alias("k_id"), F.coalesce(F.col(lang), F.lit("und")).alias("k_lang"), F.col(text).alias("t"))
    return with_bits(own, model, keep_texts), ids


def quality(df: DataFrame, trusted: DataFrame, text: str = "text", doc: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Per row: doc, lang (null: und), scored_chars, perplexity (per character), threshold, accepted.

    ``trusted`` holds the ids (column ``doc``) of trusted documents; none of them null. A text that is null or empty
    has perplexity null and is accepted: it has nothing to judge. Without trusted text all are accepted. Repeated rows
    give repeated results; other columns of ``df`` are ignored; an empty table gives no rows.
    """
    scored, ids = _scored(df, trusted, text, doc, lang, [], keep_texts=False)
    out = judged(scored, ids)
    return out.select(
        F.col("k_id").alias(doc),
        F.col("k_lang").alias("lang"),
        F.col("k_chars").alias("scored_chars"),
        F.when(F.col("k_chars") > 0, F.pow(F.lit(2.0), F.col("k_bits") / F.col("k_chars"))).alias("perplexity"),
        F.pow(F.lit(2.0), "k_threshold").alias("threshold"),
        F.col("k_accepted").alias("accepted"),
    )


def accepted_rows(df: DataFrame, trusted: DataFrame, text: str = "text", doc: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that quality() accepts, all columns; each row by its own text, whatever its id."""
    names = {c: "t" if c == text else f"k{k}" for k, c in enumerate(df.columns)}
    scored, ids = _scored(df, trusted, text, doc, lang, [F.col(c).alias(n) for c, n in names.items() if c != text], keep_texts=True)
    out = judged(scored, ids).filter("k_accepted")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
