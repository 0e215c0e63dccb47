"""Language identification by prediction by partial matching.

Each language has a context tree of variable order over bytes (A-Z folded), at most ORDER bytes deep, learnt in Spark
from all labelled training texts. A byte costs its code length under the deepest context node: a byte seen there is
coded by its count, another by the node's escape probability (method C) and then under the node's parent with the
bytes already seen excluded. The statistics are frozen, so the cost of (node, byte, language) is a table, and a text's
exact code length in a language is a sum over its bytes. The shortest code wins.

The tree keeps the nodes with the largest counts; a node's parent never counts less, so the tree is closed. Its size
is bounded by TABLE_BYTES, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import broadcast_value, checkpointed, chunks, fold_case, id_residue, text_bytes, top_by_count

ORDER = 3
#: Bytes of the cost table, at most, and nodes of the tree.
TABLE_BYTES = 48 << 20
MAX_NODES = 24_000
#: Occurrences of a context over all languages, at least.
LEAST = 4
_PART = 1 << 20


def histories(symbols: np.ndarray, offsets: np.ndarray, start: int) -> list[np.ndarray]:
    """For every byte the ORDER symbols before it, the nearest first; ``start`` before a text's first."""
    out = []
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(symbols))
    for back in range(1, ORDER + 1):
        before = np.full(len(symbols), start, symbols.dtype)
        before[back:] = symbols[: len(symbols) - back] if back <= len(symbols) else before[back:]
        out.append(np.where(at - back >= row_start, before, start).astype(symbols.dtype))
    return out


def context_counts(df: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of ORDER + 1 bytes, the coded byte lowest, over rows (lang, t)."""

    def merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part in chunks(batches, "t", _PART):
            langs = np.array(part.column("lang").to_pylist(), object)
            data, offsets = text_bytes(part.column("t"))
            data = fold_case(data).astype(np.uint32)
            gram = data.copy()
            for k, before in enumerate(histories(data, offsets, 0), 1):
                gram |= before << np.uint32(8 * k)
            names, of_row = np.unique(langs.astype(str), return_inverse=True)
            of_byte = np.repeat(of_row, np.diff(offsets))
            for k, name in enumerate(names):
                mine = held.setdefault(name, [])
                mine.append(np.unique(gram[of_byte == k], return_counts=True))
                if len(mine) >= 16:
                    held[name] = [merge(mine)]
        for name, mine in held.items():
            keys, n = merge(mine)
            for k in range(0, len(keys), 100_000):
                one = keys[k : k + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(one)), pa.array(one), pa.array(n[k : k + 100_000].astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    return df.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class PpmModel:
    """Frozen trees of all languages as one table of code lengths in bits."""

    def __init__(self, langs: list[str], nodes: list[tuple[int, int]], counts: dict[str, np.ndarray]):
        """nodes: (order, context) without the root; counts: arrays order, context, symbol, lang, n."""
        self.langs = langs
        used = {0, *np.unique(counts["symbol"]).tolist()}
        used |= {c >> 8 * k & 255 for order, c in nodes for k in range(order)}
        self.symbols = np.full(256, len(used), np.int64)
        self.symbols[sorted(used)] = np.arange(len(used))
        self.width = w = len(used) + 1  # the last stands for bytes that training never met
        node_of = {(0, 0): 0} | {x: k for k, x in enumerate(nodes, 1)}
        n = np.zeros((len(node_of), w, len(langs)), np.float32)
        place = np.array([node_of[o, c] for o, c in zip(counts["order"].tolist(), counts["context"].tolist(), strict=True)], np.int64)
        n[place, self.symbols[counts["symbol"]], counts["lang"]] = counts["n"]
        p = np.empty_like(n)
        ids = [np.array([k for x, k in node_of.items() if x[0] == order], np.int64) for order in range(ORDER + 1)]
        parent = np.zeros(len(node_of), np.int64)
        for (order, c), k in node_of.items():
            if order:
                parent[k] = node_of[order - 1, c & ((1 << 8 * (order - 1)) - 1)]
        for order, own in enumerate(ids):
            for k in range(0, len(own), 2000):
                some = own[k : k + 2000]
                above = p[parent[some]].astype(np.float64) if order else np.full((1, w, len(langs)), 1 / w)
                p[some] = self._blend(n[some].astype(np.float64), above)
        self.bits = (-np.log2(p)).reshape(-1, len(langs)).astype(np.float32)
        self.deepest = np.zeros((w, w, w), np.int32)
        for order in range(1, ORDER + 1):
            for k in ids[order].tolist():
                c = nodes[k - 1][1]
                s = [self.symbols[c >> 8 * j & 255] for j in range(order)]  # nearest first
                self.deepest[(slice(None),) * (ORDER - order) + tuple(reversed(s))] = k
        self.deepest = self.deepest.reshape(-1)

    @staticmethod
    def _blend(n: np.ndarray, above: np.ndarray) -> np.ndarray:
        seen = n > 0
        total, kinds = n.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        left = 1 - np.where(seen, above, 0).sum(1, keepdims=True)
        full = seen.all(1, keepdims=True)
        escape = np.where(full, 0, kinds / np.maximum(total + kinds, 1))
        coded = n / np.maximum(total + np.where(full, 0, kinds), 1)
        return np.where(total > 0, np.where(seen, coded, escape * above / np.maximum(left, 1e-12)), above)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language (rows x languages)."""
        symbols = self.symbols[fold_case(data)]
        node = np.zeros(len(symbols), np.int64)
        for before in reversed(histories(symbols, offsets, int(self.symbols[0]))):
            node = node * self.width + before
        cost = np.take(self.bits, self.deepest[node].astype(np.int64) * self.width + symbols, axis=0)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
        return out


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> PpmModel | None:
    """Trees of all languages in ``df`` from the rows with text and language; None if there are none."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("t")).filter("lang is not null and t is not null")
    counts = checkpointed(context_counts(rows))
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    levels = None
    for order in range(ORDER + 1):
        shape = (F.shiftright("gram", 8) % F.lit(1 << 8 * order)).alias("context")
        one = counts.select("lang", F.lit(order).alias("order"), shape, (F.col("gram") % 256).alias("symbol"), "n")
        levels = one if levels is None else levels.unionAll(one)
    levels = levels.groupBy("lang", "order", "context", "symbol").agg(F.sum("n").alias("n"))
    totals = levels.filter("order > 0").groupBy("order", "context").agg(F.sum("n").alias("total")).filter(f"total >= {LEAST}")
    most = min(MAX_NODES, max(256, TABLE_BYTES // (4 * 128 * len(langs))))
    nodes = top_by_count(checkpointed(totals), "total", ["order", "context"], most).select("order", "context")
    kept = [(r.order, r.context) for r in nodes.collect()]
    bounded = df.sparkSession.createDataFrame([(0, 0), *kept], "order int, context long")
    got = levels.join(F.broadcast(bounded), ["order", "context"]).toArrow()  # at most 257 symbols a node and language
    number = {x: k for k, x in enumerate(langs)}
    table = {c: got.column(c).to_numpy() for c in ("order", "context", "symbol", "n")}
    table["lang"] = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    return PpmModel(langs, kept, table)


def has_letter(text: str) -> bool:
    return next((True for c in text if c.isalpha()), False)


def predict(df: DataFrame, model: PpmModel | None, text: str = "text", doc: str = "doc_id", held: int = 2, folds: int = 4) -> DataFrame:
    """Per row: doc, held_out, lang_pred, score, bits (of the best code).

    Null texts and texts without a letter are ``und`` with score 0; so is everything without a model. The score is the
    posterior of the prediction over the learnt languages. Ties go to the first language in order.
    """
    shared = broadcast_value(df.sparkSession, model)
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t", _PART):
            m = shared.value
            texts = part.column("t").to_pylist()
            known = np.array([m is not None and t is not None and has_letter(t) for t in texts])
            best, score, least = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
            if m is not None:
                bits = m.code_lengths(*text_bytes(part.column("t")))
                best = bits.argmin(1)
                least = bits.min(1)
                score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
            names = [m.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("i"), part.column("h"), pa.array(names), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, least, 0.0))],
                names=[doc, "held_out", "lang_pred", "score", "bits"],
            )

    rows = df.select(F.col(doc).alias("i"), held_out(doc, held, folds).alias("h"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"`{doc}` {kind}, held_out boolean, lang_pred string, score double, bits double")


def held_out(doc: str = "doc_id", held: int = 2, folds: int = 4):
    """Whether crc32(id as text) mod ``folds`` is ``held``; a null id is not held out, and never learnt from."""
    return F.coalesce(id_residue(doc, folds) == held, F.lit(False))


def language_id(df: DataFrame, text: str = "text", doc: str = "doc_id", lang: str = "lang", held: int = 2, folds: int = 4) -> DataFrame:
    """Learns from the rows that are not held out, predicts all; see predict()."""
    return predict(df, train(df.filter(id_residue(doc, folds) != held), text, lang), text, doc, held, folds)
