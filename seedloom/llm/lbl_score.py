"""Log-probabilities of texts under a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words (A-Z folded) and one end per text. Counts of all tokens of all training texts are gathered in Spark,
by 64-bit word hashes whose low TAIL_BITS tell the word's ending. The most frequent words are symbols of their own,
GROWTH times the square root of the corpus' tokens of them; all others share the symbols of their endings, as many as
an eighth of the words have, 4096 at most. A word of an ending has the probability of that symbol, given the context,
times its own share, (c + 1) / (N' + V' + 1), of that ending's tokens.

The model predicts a symbol from the CONTEXT symbols before it: r = sum_i C_i R[w_i]. Symbols lie in blocks,
in each of which the square roots of their shares of the tokens sum up to about 1: so the scores of all blocks and of a
token's own block are fewest, and frequent words lie in small ones. P(symbol) = P(block) P(symbol in block), by scores r . S[block] + g[block] and
r . Q[w] + b[w]. Training texts belong to shards by hashes of id and text, so how the table is split and ordered does
not matter: a shard's texts meet in one task, in the order of their hashes, and train a copy in numpy, with noise shared
by a minibatch so that the work is matrix products. Spark averages what the copies that changed a row moved it by,
weighted by tokens and sent in eight bits. A round takes its own part of the texts and starts from that mean, so each
text is read by one round. Shards are the square root of the corpus' tokens over SHARDED: their number and their size
grow alike, and so does what they send. Scores are normalised exactly, over all blocks and the whole block of the
target, once for each distinct context of a batch.

Counts of the HEAD most frequent tokens are broadcast (a few MB); only rarer tokens of the texts are shuffled to meet
their counts, so no hot word is ever a key of a shuffle.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import broadcast_value, checkpointed, chunks, fold_case, id_residue, mix, span_hashes, text_bytes, top_by_count, word_spans

#: Words with a symbol of their own: so many times the square root of the tokens.
GROWTH = 4
#: Low bits of a word's key, from its last two bytes.
TAIL_BITS = 12
HEAD = 1 << 18
CONTEXT = 2
WIDTH = 16
#: Parts of the texts, trained on one after another.
ROUNDS = 2
#: Square roots of the tokens to a shard.
SHARDED = 512
NOISE = 64
MINIBATCH = 4096
RATE = 0.1
#: Where Adagrad's sums of squares start.
FIRST_STEP = np.float32(1e-7)
#: Key of the end of a text among the word hashes.
END = np.int64(-1)
#: Symbol of the end of a text; those of endings follow, then the words'.
END_SYMBOL = 0
#: Symbols whose copies are averaged together.
AVERAGED = 256
#: Contexts that are scored at once: their scores stay in a core's cache.
SCORED = 1024
#: Bytes of text whose equal contexts are scored once.
SCORED_BYTES = 3 << 20
_ENDINGS = (1 << TAIL_BITS) - 1


def token_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts laid end to end, an end after each text's words, and len + 1 offsets."""
    data, offsets = text_bytes(column)
    data = fold_case(data)
    starts, ends, row = word_spans(data, offsets)
    keys = np.full(len(starts) + len(offsets) - 1, END, np.int64)
    last = data[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    ending = mix(last << np.uint64(8) | before) & np.uint64(_ENDINGS)
    hashes = span_hashes(data, starts, ends) & ~np.uint64(_ENDINGS) | ending
    keys[np.arange(len(starts)) + row] = hashes.view(np.int64)
    n = np.bincount(row, minlength=len(offsets) - 1) + 1
    return keys, np.concatenate([[0], np.cumsum(n)])


def token_counts(df: DataFrame) -> DataFrame:
    """(key, n) over all tokens of the texts ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = merged()
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["key", "n"])

        for part in chunks(batches, "t"):
            held.append(np.unique(token_keys(part.column("t"))[0], return_counts=True))
            if len(held) >= 16:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    return df.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def words_wanted(total: int) -> int:
    return int(GROWTH * total**0.5)


class Vocabulary:
    """Head tokens with their counts, and the symbols of all tokens; corpus totals beside them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int, endings: np.ndarray):
        """keys: by falling count, at least the words_wanted(); endings: tokens and distinct words of each ending."""
        self.total, self.distinct = total, distinct
        named = np.flatnonzero(keys != END)[: words_wanted(total)]
        self.shift = TAIL_BITS - min(TAIL_BITS, max(1, len(named) // 8).bit_length() - 1)
        self.tails = 1 << TAIL_BITS - self.shift
        self.size = 1 + self.tails + len(named)
        symbols = self._ending(keys)
        symbols[named] = 1 + self.tails + np.arange(len(named))
        rest = endings.copy()
        np.subtract.at(rest, keys[named] & _ENDINGS, np.stack([counts[named], np.ones(len(named), np.int64)], 1))
        rest = rest.reshape(self.tails, -1, 2).sum(1)
        n = np.zeros(self.size)
        n[1 : 1 + self.tails] = rest[:, 0]
        n[1 + self.tails :] = counts[named]
        n[END_SYMBOL] = total - n.sum()
        #: log10 of what the shares of an ending's words are of, 0 for words with a symbol of their own.
        self.log_outside = np.zeros(self.size)
        self.log_outside[1 : 1 + self.tails] = np.log10(rest.sum(1) + 1)
        self.unigram = (n + 1) / (n + 1).sum()
        order = np.argsort(keys)
        self.keys, self.counts, self.symbols = keys[order], counts[order], symbols[order]

    def _ending(self, keys: np.ndarray) -> np.ndarray:
        return np.where(keys == END, END_SYMBOL, 1 + ((keys & _ENDINGS) >> self.shift))

    def shares_ending(self, symbols: np.ndarray) -> np.ndarray:
        return (symbols > END_SYMBOL) & (symbols <= self.tails)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each key, and its count, -1 outside the head."""
        if not len(self.keys):
            return self._ending(keys), np.where(keys == END, 0, -1)
        keys, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        head = self.keys[at] == keys
        symbols = np.where(head, self.symbols[at], self._ending(keys))
        return symbols[back], np.where(head, self.counts[at], np.where(keys == END, 0, -1))[back]


def histories(symbols: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The symbols one, two, ... before each token; the end symbol before a text."""
    at, first = np.arange(len(symbols)), np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for back in range(1, CONTEXT + 1):
        before = np.full(len(symbols), END_SYMBOL)
        before[back:] = symbols[:-back]
        out.append(np.where(at - back >= first, before, END_SYMBOL))
    return out


class LogBilinear:
    """Parameters, one step of noise-contrastive training, and normalised log-probabilities."""

    def __init__(self, unigram: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        v = len(unigram)
        #: Block of each symbol, and where the blocks begin.
        self.block = np.unique(np.floor(np.cumsum(unigram**0.5) - unigram**0.5 / 2), return_inverse=True)[1]
        self.edges = np.append(np.flatnonzero(np.diff(self.block, prepend=-1)), v)
        blocks = np.add.reduceat(unigram, self.edges[:-1])
        self.noise = {"Q": (np.cumsum(unigram), np.log(NOISE * unigram).astype(np.float32)), "S": (np.cumsum(blocks), np.log(NOISE * blocks).astype(np.float32))}
        self.R = rng.normal(0, 0.1, (v, WIDTH)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (v, WIDTH)).astype(np.float32)
        self.C = np.stack([np.eye(WIDTH, dtype=np.float32) / CONTEXT] * CONTEXT)
        self.b = np.log(unigram).astype(np.float32)
        self.S = rng.normal(0, 0.1, (len(blocks), WIDTH)).astype(np.float32)
        self.g = np.log(blocks).astype(np.float32)
        self.rate = RATE
        self.step_sizes: dict[str, np.ndarray] = {}

    #: Parameters of single symbols, and those that all texts change.
    ROWS, SHARED = ("R", "Q", "b"), ("C", "S", "g")

    def copy(self) -> LogBilinear:
        out = copy.copy(self)
        for x in self.ROWS + self.SHARED:
            setattr(out, x, getattr(self, x).copy())
        out.step_sizes = {}
        return out

    def changed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of a part (-1: what is shared), rows of it, their values, of all that training changed."""
        shared = np.concatenate([getattr(self, x).reshape(-1) for x in self.SHARED])
        yield -1, np.arange(len(shared), dtype=np.int32), shared[:, None]
        rows = np.flatnonzero((self.step_sizes["R"] != FIRST_STEP).any(1) | (self.step_sizes["Q"] != FIRST_STEP).any(1) | (self.step_sizes["b"] != FIRST_STEP))
        for some in np.split(rows, np.flatnonzero(np.diff(rows // AVERAGED)) + 1):
            yield int(some[0] // AVERAGED), some.astype(np.int32), np.concatenate([self.R[some], self.Q[some], self.b[some, None]], 1)

    def values(self, part: int, rows: np.ndarray) -> np.ndarray:
        """What changed() gives for some rows, as they are."""
        if part < 0:
            return np.concatenate([getattr(self, x).reshape(-1) for x in self.SHARED])[:, None]
        return np.concatenate([self.R[rows], self.Q[rows], self.b[rows, None]], 1)

    def put(self, part: int, rows: np.ndarray, values: np.ndarray) -> None:
        if part >= 0:
            self.R[rows], self.Q[rows], self.b[rows] = values[:, :WIDTH], values[:, WIDTH:-1], values[:, -1]
            return
        at = 0
        for x in self.SHARED:
            old = getattr(self, x)
            setattr(self, x, values[at : at + old.size].reshape(old.shape).copy())
            at += old.size

    def _ascend(self, name: str, groups: tuple[np.ndarray, ...] | None, grad: np.ndarray) -> None:
        """Adagrad, on some rows, as of _groups(), or all; the sums of squares are a task's own."""
        value = getattr(self, name)
        if name not in self.step_sizes:
            self.step_sizes[name] = np.full(value.shape, FIRST_STEP, np.float32)
        seen = self.step_sizes[name]
        if groups is None:
            seen += grad * grad
            value += self.rate * grad / np.sqrt(seen)
            return
        order, first, own = groups
        total = np.add.reduceat(grad[order], first, axis=0)
        sums = seen[own] + total * total
        seen[own] = sums
        np.sqrt(sums, out=sums)
        total *= self.rate
        total /= sums
        value[own] += total

    def _estimate(self, name: str, bias: str, r: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Ascends by targets against NOISE shared draws from their unigram distribution; the gradient at ``r``."""
        (total, shift), value, b = self.noise[name], getattr(self, name), getattr(self, bias)
        noise = np.minimum(np.searchsorted(total, rng.random(NOISE) * total[-1], side="right"), len(b) - 1)
        n, own, others = np.float32(1 / len(target)), value[target], value[noise]
        up = n / (1 + np.exp(np.clip(np.einsum("ij,ij->i", r, own) + b[target] - shift[target], -30, 30)))
        down = r @ -others.T
        down += shift[noise] - b[noise]
        np.clip(down, -30, 30, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-n, down, out=down)
        grad_r = down @ others
        own *= up[:, None]
        grad_r += own
        groups = _groups(np.concatenate([target, noise]))
        self._ascend(name, groups, np.concatenate([up[:, None] * r, down.T @ r]))
        self._ascend(bias, groups, np.concatenate([up, down.sum(0)]))
        return grad_r

    def train(self, before: list[np.ndarray], target: np.ndarray, rng: np.random.Generator) -> None:
        """One minibatch, of symbols and of their blocks."""
        parts = [self.R[w] for w in before]
        r = sum(x @ c for x, c in zip(parts, self.C, strict=True))
        grad_r = self._estimate("Q", "b", r, target, rng) + self._estimate("S", "g", r, self.block[target], rng)
        grad_c = np.stack([x.T @ grad_r for x in parts])
        self._ascend("R", _groups(np.concatenate(before)), np.concatenate([grad_r @ c.T for c in self.C]))
        self._ascend("C", None, grad_c)

    def log_probs(self, before: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Natural logarithms of normalised probabilities."""
        v = len(self.b)
        code, at = np.unique(sum(w.astype(np.int64) * v**i for i, w in enumerate(before)), return_inverse=True)
        r = sum(self.R[code // v**i % v] @ c for i, c in enumerate(self.C))
        norm = np.empty(len(code), np.float32)
        value = _beside(self.S, self.g)
        for k in range(0, len(code), SCORED):
            norm[k : k + SCORED] = _log_sums(r[k : k + SCORED], value)
        block, mine = self.block[target], r[at]
        out = np.einsum("ij,ij->i", mine, self.S[block]) + self.g[block] - norm[at]
        pair, of = np.unique(block.astype(np.int64) * len(code) + at, return_inverse=True)
        inner, where, which = np.empty(len(pair), np.float32), pair % len(code), pair // len(code)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(pair)]])
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            own = slice(self.edges[which[a]], self.edges[which[a] + 1])
            value = _beside(self.Q[own], self.b[own])
            for k in range(a, z, SCORED):
                some = slice(k, min(k + SCORED, z))
                inner[some] = _log_sums(r[where[some]], value)
        return out.astype(np.float64) + (np.einsum("ij,ij->i", mine, self.Q[target]) + self.b[target] - inner[of])


def _groups(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order in which equal rows lie together, as they came; where each begins in it; and the distinct rows."""
    bits = (len(rows) - 1).bit_length()
    both = np.sort(rows.astype(np.int64) << bits | np.arange(len(rows)))
    order, ordered = both & ((1 << bits) - 1), both >> bits
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, first, ordered[first]


def _beside(value: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vectors as columns, their biases as a last row."""
    return np.concatenate([value, b[:, None]], 1).T.copy()


def _log_sums(r: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Logarithms of the summed exponentials of each row's scores; ``value`` as of _beside()."""
    r = np.concatenate([r, np.ones((len(r), 1), np.float32)], 1)
    scores = r @ value
    with np.errstate(over="ignore"):
        total = np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32)
    if len(total) and 1e-30 < total.min() and total.max() < 1e30:
        return np.log(total)
    scores = r @ value  # sums beyond single precision: each row by its largest
    top = scores.max(1)
    return top + np.log(np.exp(scores - top[:, None]).sum(1))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total = int(whole.n or 0)
    top = top_by_count(counts, "n", ["key"], max(HEAD, words_wanted(total) + 1)).toArrow()
    endings = np.zeros((1 << TAIL_BITS, 2), np.int64)
    ending = F.col("key").bitwiseAND(_ENDINGS).alias("e")
    for row in counts.filter(F.col("key") != int(END)).groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        endings[row.e] = row.n, row.v
    return Vocabulary(top.column("key").to_numpy(), top.column("n").to_numpy(), total, int(whole.v), endings)


def _moves(part: int, raw: bytes, rows: int) -> np.ndarray:
    """Moves of rows: those of symbols are in eight bits, with a scale of each row before them."""
    if part < 0:
        return np.frombuffer(raw, np.float32).reshape(rows, -1)
    both = np.frombuffer(raw, np.uint8).reshape(rows, -1)
    return both[:, 4:].view(np.int8) * np.ascontiguousarray(both[:, :4]).view(np.float32)


def _mean(table: pa.Table) -> pa.Table:
    """One row of the mean of what the copies that changed a part's rows moved them by, added in the order of shards."""
    table = table.sort_by("shard")
    part = table.column("part")[0].as_py()
    rows = [np.frombuffer(x, np.int32) for x in table.column("rows").to_pylist()]
    ids, back = np.unique(np.concatenate(rows), return_inverse=True)
    total, weight, at = 0.0, np.zeros(len(ids)), 0
    for x, w, own in zip(table.column("x"), table.column("w").to_pylist(), rows, strict=True):
        values = _moves(part, x.as_py(), len(own))
        if at == 0:
            total = np.zeros((len(ids), values.shape[1]))
        place = back[at : at + len(own)]
        total[place] += values * w
        weight[place] += w
        at += len(own)
    mean = (total / weight[:, None]).astype(np.float32)
    return pa.table({"part": pa.array([part], pa.int32()), "rows": [ids.tobytes()], "x": [mean.tobytes()]})


def shards_wanted(total: int) -> int:
    return max(1, round(total**0.5 / SHARDED))


def rate_of(turn: int) -> float:
    """Sums of squares start anew in each round, so later rounds step less."""
    return RATE / (1 + turn)


def train_model(df: DataFrame, words: Vocabulary, rounds: int = ROUNDS, shards: int | None = None) -> LogBilinear:
    """Averages copies trained on the shards of the texts ``t`` with ids ``i``, once for each of ``rounds`` parts of them.

    Neither partitions nor the order of rows matter. Repeated rows share a shard, which its task reads as a stream.
    """
    model, shards = LogBilinear(words.unigram), shards or shards_wanted(words.total)
    placed = df.select(F.xxhash64(F.col("i").cast("string"), "t").alias("h"), "t")
    for turn in range(rounds):
        model.rate = rate_of(turn)
        shared = broadcast_value(df.sparkSession, (words, model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            vocabulary, start = _tables(shared)
            own, seen, rng, shard = None, 0, None, 0
            for part in chunks(batches, "t"):
                if own is None:
                    shard = part.column("shard")[0].as_py()
                    own, rng = start.copy(), np.random.default_rng([turn, shard])
                keys, offsets = token_keys(part.column("t"))
                symbols = vocabulary.look_up(keys)[0]
                before = histories(symbols, offsets)
                for k in range(0, len(symbols), MINIBATCH):
                    some = slice(k, k + MINIBATCH)
                    own.train([b[some] for b in before], symbols[some], rng)
                seen += len(symbols)
            for number, rows, values in own.changed() if seen else ():
                moved = np.ascontiguousarray(values - start.values(number, rows))
                if number >= 0:
                    scale = np.maximum(np.abs(moved).max(1, keepdims=True), np.float32(1e-12)) / 127
                    moved = np.concatenate([scale.view(np.uint8), np.rint(moved / scale).astype(np.int8).view(np.uint8)], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([shard], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary()), pa.array([float(seen)])],
                    names=["part", "shard", "rows", "x", "w"],
                )

        place = F.pmod(F.shiftright("h", 16), F.lit(shards)).cast("int")
        mine = placed.filter(F.pmod("h", F.lit(rounds)) == turn).withColumn("shard", place)
        copies = mine.repartitionById(shards, "shard").sortWithinPartitions("h").mapInArrow(run, "part int, shard int, rows binary, x binary, w double")
        mean = copies.groupBy("part").applyInArrow(_mean, "part int, rows binary, x binary").toArrow()  # as large as the model
        after = model.copy()
        for part, rows, x in zip(*(mean.column(c).to_pylist() for c in ("part", "rows", "x")), strict=True):
            rows = np.frombuffer(rows, np.int32)
            after.put(part, rows, model.values(part, rows) + np.frombuffer(x, np.float32).reshape(len(rows), -1))
        model = after
        shared.unpersist()
    return model


@lru_cache(maxsize=1)
def _tables(shared):
    return shared.value


def lm_scores(df: DataFrame, text: str = "text", doc: str = "doc_id", held: int = 2, folds: int = 7) -> DataFrame:
    """Per row: doc, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) mod ``folds`` is not ``held``; a null id is not held out and never
    learnt from. Null texts count as empty: their one token is the end. base_score is add-one unigram, score the
    model's; both are log10 of the whole text's probability. Repeated rows give repeated results, an empty table none;
    other columns, whatever their names, are not read.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("r"),
        F.col(doc).alias("i"),
        F.coalesce(id_residue(doc, folds) == held, F.lit(False)).alias("h"),
        F.col(text).alias("t"),
    )
    learnt = df.filter(id_residue(doc, folds) != held).select(F.col(doc).alias("i"), F.col(text).alias("t"))
    counts = checkpointed(token_counts(learnt.select("t")))
    words = vocabulary_of(counts)
    model = train_model(learnt, words)
    shared = broadcast_value(df.sparkSession, (words, model))
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t", SCORED_BYTES):
            vocabulary, lbl = _tables(shared)
            keys, offsets = token_keys(part.column("t"))
            symbols, count = vocabulary.look_up(keys)
            logs = lbl.log_probs(histories(symbols, offsets), symbols) / np.log(10)
            head, tail = count >= 0, count < 0
            plus = np.where(head, np.log10(np.maximum(count, 0) + 1), 0.0)
            add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has an end
            out = [part.column("r"), part.column("i"), part.column("h"), pa.array(np.diff(offsets))]
            out += [pa.array(add((count > 0).astype(np.int64))), pa.array(add(plus)), pa.array(add(logs))]
            out += [pa.array(add(np.where(vocabulary.shares_ending(symbols), plus, 0.0))), pa.array(add(vocabulary.log_outside[symbols]))]
            at = np.concatenate([[0], np.cumsum(tail)])[offsets]
            out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys[tail])))
            yield pa.RecordBatch.from_arrays(out, names=["r", doc, "held_out", "n_tokens", "known", "plus", "logs", "shared_plus", "outside", "tail"])

    fields = "held_out boolean, n_tokens long, known long, plus double, logs double, shared_plus double, outside double, tail array<long>"
    first = checkpointed(rows.mapInArrow(run, f"r long, `{doc}` {kind}, {fields}"))
    tails = first.select("r", F.explode("tail").alias("key")).join(counts, "key")
    sums = tails.groupBy("r").agg(F.count("*").alias("t_known"), F.sum(F.log10(F.col("n") + 1)).alias("t_plus"))
    joined = first.drop("tail").join(sums, "r", "left").na.fill(0, ["t_known", "t_plus"])
    base = F.col("plus") + F.col("t_plus") - F.col("n_tokens") * F.log10(F.lit(float(words.total + words.distinct + 1)))
    own = F.col("logs") + F.col("shared_plus") + F.col("t_plus") - F.col("outside")
    return joined.select(
        doc,
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("t_known")).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        own.alias("score"),
    )
