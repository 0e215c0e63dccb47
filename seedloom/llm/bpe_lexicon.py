"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The corpus's words are counted in Spark; the LEXICON_WORDS most frequent ones are compiled, with their token ids as
outputs, into a minimal acyclic automaton that shares prefixes and suffixes. Outputs are numbers on the transitions
that add up to a word's place in an array of id lists. The automaton is a flat file that Spark ships to every node once
and that workers map into memory. Words outside it are merged exactly, many at a time. The lexicon is a speed-up of
bounded size: what it holds never changes a result.

The tokenizer file is a word-level BPE: NFC, white space squeezed, lower case; words are contractions, runs of letters,
single digits, or runs of other characters; byte-level symbols; "</w>" ends a word; special strings are cut out first.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .token_counts import byte_symbols
from .util import checkpointed, chunks, release_memory, span_hashes, text_bytes, top_by_count

#: Words in the transducer: with the longest word of WORD_BYTES, this bounds its file to a few tens of MB.
LEXICON_WORDS = 200_000
WORD_BYTES = 48
#: Words whose merges a worker remembers, and words that it counts before it sends them on.
REMEMBERED, COUNTED = 40_000, 100_000
SPACE, LETTER, DIGIT, OTHER = range(4)


def _latin_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    white = {*range(9, 14), 32, 0x85, 0xA0}
    return np.array([SPACE if c in white else kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(256)], np.uint8)


CLASS = _latin_classes()
LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256)], np.uint8)


class Merger:
    """The tokenizer file's vocabulary, and exact merging of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size = max(*vocab.values(), *self.special.values(), 0) + 1
        by_byte = {b: c for c, b in byte_symbols().items()}
        end = spec["model"]["end_of_word_suffix"] or ""
        self.first = np.array([vocab[by_byte[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[by_byte[b] + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keep = np.unique(keys, return_index=True)[1]
        self.keys, self.rank, self.into = keys[keep], keep.astype(np.int64), into[keep]
        names = [b""] * self.size
        for token, i in {**vocab, **self.special}.items():
            names[i] = token.encode() + b" "
        self.name_at = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.memo: dict[bytes, np.ndarray] = {}
        del spec, vocab, pairs, names
        release_memory()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place of each pair's merge; rank -1 where there is none, as for pairs across words (right < 0)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank[at], -1), at

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (UTF-8, not empty): the lowest-ranked pair merges first, the leftmost of equals."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        size = np.array([len(w) for w in words], np.int64)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        ids[ends - 1] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        none = np.int64(1) << 40
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            right = np.concatenate([np.where(owner[1:] == owner[:-1], ids[1:], -1), [-1]])
            rank, at = self._ranks(ids, right)
            rank = np.where(rank >= 0, rank, none)
            best = np.minimum.reduceat(rank, begin)
            length = np.diff(np.concatenate([begin, [len(ids)]]))
            done = best == none
            if done.any():
                for k in np.flatnonzero(done):
                    out[owner[begin[k]]] = ids[begin[k] : begin[k] + length[k]].astype(np.uint32)
                stay = np.repeat(~done, length)
                ids, owner, rank, at = ids[stay], owner[stay], rank[stay], at[stay]
                if not len(ids):
                    break
                begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                length, best = np.diff(np.concatenate([begin, [len(ids)]])), best[~done]
            hit = np.flatnonzero(rank == np.repeat(best, length))
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
            ids[hit] = self.into[at[hit]]
            gone = np.ones(len(ids), bool)
            gone[hit + 1] = False
            ids, owner = ids[gone], owner[gone]
        return out

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """merge(), with a bounded memory of words met before."""
        fresh = list(dict.fromkeys(w for w in words if w not in self.memo))
        found = dict(zip(fresh, self.merge(fresh), strict=True)) if fresh else {}
        out = [self.memo[w] if w in self.memo else found[w] for w in words]
        if len(self.memo) + len(found) > REMEMBERED:
            self.memo.clear()
        if len(found) <= REMEMBERED:
            self.memo |= found
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token names, joined by spaces, special ones included."""
        return self.decode_many(ids, np.array([0, len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        start, size = self.name_at[ids], self.name_at[ids.astype(np.int64) + 1] - self.name_at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.names[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        cut = ends[offsets]
        return [flat[a : max(a, b - 1)].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Transducer:
    """A minimal acyclic automaton over bytes; the numbers on a word's path add up to its index, in sorted order.

    Built from sorted distinct words, one after another: the part of the last word's path that the next one doesn't
    share is closed, and each closed state is replaced by an equal one met before.
    """

    def __init__(self, edge_key: np.ndarray, edge_to: np.ndarray, edge_add: np.ndarray, final: np.ndarray, at: np.ndarray, ids: np.ndarray):
        self.edge_key, self.edge_to, self.edge_add, self.final, self.at, self.ids = edge_key, edge_to, edge_add, final, at, ids

    @staticmethod
    def build(words: list[bytes], outputs: list[np.ndarray]) -> Transducer:
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in outputs])])
        return Transducer.compiled(words, at, np.concatenate([np.empty(0, np.int64), *outputs]))

    @staticmethod
    def compiled(words: list[bytes], at: np.ndarray, ids: np.ndarray) -> Transducer:
        """The automaton of the words; the ids of the k-th are those from at[k] to at[k + 1]."""
        known: dict[bytes, int] = {}  # states in the order of their numbers, as 64-bit numbers: final, and 256 * state + byte of each edge
        path: list[list[int]] = [[0]]  # of the last word: final, closed edges
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                state = known.setdefault(array("q", path.pop()).tobytes(), len(known))
                path[-1].append(256 * state + last[len(path) - 1])

        for word in words:
            same = len(os.path.commonprefix([last, word]))
            close(same)
            path.extend([0] for _ in range(len(word) - same))
            path[-1][0] = 1
            last = word
        close(0)
        size = np.array([*map(len, known), 8 * len(path[0])], np.int64) // 8
        flat = np.frombuffer(b"".join(known) + array("q", path[0]).tobytes(), np.int64)
        del known, path
        begin = np.cumsum(size) - size
        final = flat[begin].astype(np.uint8)
        edges = np.delete(flat, begin)
        to, ends = edges >> 8, np.cumsum(size - 1)
        add = np.zeros(len(edges), np.int64)
        paths = np.zeros(len(size), np.int64)  # words below each state; a state's targets come before it
        for s, (first, stop) in enumerate(zip((ends - size + 1).tolist(), ends.tolist(), strict=True)):
            below = np.cumsum(paths[to[first:stop]])
            add[first:stop] = final[s]
            add[first + 1 : stop] += below[:-1]
            paths[s] = final[s] + (below[-1] if len(below) else 0)
        key = np.repeat(np.arange(len(size)) * 256, size - 1) + (edges & 255)
        return Transducer(key, to, add, final, at.astype(np.int64), ids.astype(np.int64))

    FIELDS = ("edge_key", "edge_to", "edge_add", "at", "ids", "final")

    def save(self, path: str) -> None:
        arrays = [getattr(self, f) for f in self.FIELDS]
        with open(path, "wb") as f:
            f.write(np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays))

    @staticmethod
    def load(path: str) -> Transducer:
        """The saved automaton, mapped into memory."""
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, got = np.frombuffer(view, np.int64, 6), 48, {}
        for name, size in zip(Transducer.FIELDS, sizes, strict=True):
            kind = np.uint8 if name == "final" else np.int64
            got[name] = np.frombuffer(view, kind, size, at)
            at += size * np.dtype(kind).itemsize
        return Transducer(**got)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word in sorted order, -1 for the unknown; all words step through the automaton together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.edge_key):
            return out
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero((size > 0) & (size <= WORD_BYTES))
        state = np.full(len(live), len(self.final) - 1, np.int64)
        total = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * 256 + data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            ok = self.edge_key[at] == key
            live, at, total = live[ok], at[ok], total[ok]
            state, total, step = self.edge_to[at], total + self.edge_add[at], step + 1
            ended = size[live] == step
            full = ended & (self.final[state] == 1)
            out[live[full]] = total[full]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return out


def _latin(text: bytes) -> bytes | None:
    """The text one byte a character, or None if a character is beyond U+00FF."""
    if text.isascii():
        return text
    try:
        return text.decode().encode("latin-1")
    except UnicodeEncodeError:
        return None


def exact_words(text: str, merger: Merger) -> list[bytes]:
    """The words of a text of any characters, as UTF-8, in order: by the library's own tables of characters."""
    text = merger.library.normalizer.normalize_str(text)
    return [text[a:b].encode() for _, (a, b) in merger.library.pre_tokenizer.pre_tokenize_str(text)]


def latin_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and ends in lower-case Latin-1 data in which a blank separates the texts."""
    kind = CLASS[data]
    change = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)])
    marks = np.flatnonzero((data == 39) & change)  # an apostrophe that starts a run may start a contraction
    for p in marks:
        tail = data[p + 1 : p + 3].tobytes()
        n = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
        if n:
            change[p + 1 : p + 1 + n] = False
            if p + 1 + n < len(data):
                change[p + 1 + n] = True
    starts = np.flatnonzero(change)
    ends = np.concatenate([starts[1:], [len(data)]])
    word = kind[starts] != SPACE
    return starts[word], ends[word]


class Words:
    """The words of one chunk of texts: distinct ones as UTF-8, and for each text the indices of its words in order."""

    def __init__(self, column: pa.Array, merger: Merger):
        data, offsets = text_bytes(column)
        whole = data.tobytes()
        texts = [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        rare: list[int] = []
        parts: list[bytes] = []
        for k, t in enumerate(texts):
            plain = None if merger.marks and b"<|" in t and merger.marks.search(t.decode()) else _latin(t)
            if plain is None:
                rare.append(k)
            parts.append(plain or b"")
        laid = LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
        size = np.array([len(p) + 1 for p in parts], np.int64)
        starts, ends = latin_spans(laid)
        hashes = span_hashes(laid, starts, ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(starts):
            check = span_hashes(laid, starts, ends, seed=2)
            if (check[first][inverse] != check).any():
                raise ArithmeticError("two words share a 64-bit hash")
        blob = laid.tobytes()
        self.words = [blob[a:b] for a, b in zip(starts[first], ends[first], strict=True)]
        self.words = [w if w.isascii() else w.decode("latin-1").encode() for w in self.words]
        self.index = inverse
        ends_of_texts = np.cumsum(size)
        self.offsets = np.concatenate([[0], np.searchsorted(starts, ends_of_texts)])
        self.counts = np.bincount(inverse, minlength=len(self.words))
        self.rare = [(k, texts[k].decode()) for k in rare]


def segments(text: str, merger: Merger) -> Iterator[tuple[list[bytes], int | None]]:
    """The words between special strings, and the id of the special string after them."""
    at = 0
    for m in merger.marks.finditer(text) if merger.marks else ():
        yield exact_words(text[at : m.start()], merger), merger.special[m[0]]
        at = m.end()
    yield exact_words(text[at:], merger), None


@lru_cache(maxsize=4)
def merger_of(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=4)
def transducer_of(name: str) -> Transducer:
    return Transducer.load(SparkFiles.get(name))


def word_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word binary, n long) over all texts of ``df``; words as the tokenizer file cuts them, specials left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, held = merger_of(path), {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for part in chunks(batches, "t"):
            words = Words(part.column("t"), merger)
            for w, n in zip(words.words, words.counts.tolist(), strict=True):
                held[w] = held.get(w, 0) + n
            for _, t in words.rare:
                for some, _ in segments(t, merger):
                    for w in some:
                        held[w] = held.get(w, 0) + 1
            if len(held) > COUNTED:
                yield flush()
        yield flush()

    counted = df.select(df[text].alias("t")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the ``size`` most frequent words of ``df`` and ships the file to the nodes; its name for SparkFiles."""
    spark: SparkSession = df.sparkSession
    counts = checkpointed(word_counts(df, path, text).filter((F.length("word") <= WORD_BYTES) & (F.col("n") > 1)))
    words = sorted(top_by_count(counts, "n", ["word"], size).select("word").toArrow().column("word").to_pylist())
    merger = Merger(path)
    sizes, ids = [np.zeros(1, np.int64)], [np.empty(0, np.uint32)]
    for k in range(0, len(words), 20_000):
        some = merger.merge(words[k : k + 20_000])
        sizes.append(np.array([len(x) for x in some], np.int64))
        ids.append(np.concatenate(some))
    del merger
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = os.path.join(tempfile.mkdtemp(prefix="seedloom-"), name)  # the driver's own copy, which Spark serves
    Transducer.compiled(words, np.cumsum(np.concatenate(sizes)), np.concatenate(ids)).save(place)
    del words, sizes, ids
    release_memory()
    spark.sparkContext.addFile(place)
    return name


def encode_chunk(column: pa.Array, merger: Merger, lexicon: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts of a chunk laid end to end, and len + 1 offsets."""
    words = Words(column, merger)
    place = lexicon.find(words.words)
    unknown = np.flatnonzero(place < 0)
    fresh = merger.merged([words.words[k] for k in unknown])
    n = np.zeros(len(words.words), np.int64)
    begin = np.zeros(len(words.words), np.int64)
    known = place >= 0
    n[known] = lexicon.at[place[known] + 1] - lexicon.at[place[known]]
    begin[known] = lexicon.at[place[known]]
    n[unknown] = [len(f) for f in fresh]
    begin[unknown] = len(lexicon.ids) + np.cumsum(n[unknown]) - n[unknown]
    used = np.concatenate([lexicon.ids, *fresh]) if len(fresh) else lexicon.ids
    size, start = n[words.index], begin[words.index]
    ends = np.concatenate([[0], np.cumsum(size)])
    ids = used[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])].astype(np.uint32)
    offsets = ends[words.offsets]
    if not words.rare:
        return ids, offsets
    each = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for k, text in words.rare:
        got: list[np.ndarray] = []
        for some, special in segments(text, merger):
            got += merger.merged(some)
            got += [np.array([special], np.uint32)] if special is not None else []
        each[k] = np.concatenate(got) if got else np.empty(0, np.uint32)
    return np.concatenate(each).astype(np.uint32), np.concatenate([[0], np.cumsum([len(e) for e in each])])


def bpe_encode(df: DataFrame, path: str, text: str = "text", doc: str = "doc_id", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Per row: doc, ids array<int>. Null texts count as empty, and empty ones have no ids.

    Repeated rows give repeated results, an empty table none; ``df`` may hold any other columns.
    """
    name = build_lexicon(df, path, text, lexicon_words)
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t"):
            ids, offsets = encode_chunk(part.column("t"), merger_of(path), transducer_of(name))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("i"), lists], names=[doc, "ids"])

    return df.select(df[doc].alias("i"), df[text].alias("t")).mapInArrow(run, f"`{doc}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", doc: str = "doc_id") -> DataFrame:
    """Per row: doc, text: the token names joined by spaces, special ones included; null ids count as none."""
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(path)
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column("x").to_pylist()]
            texts = [merger.decode(r).decode() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(texts, pa.string())], names=[doc, "text"])

    return df.select(df[doc].alias("i"), df[ids].alias("x")).mapInArrow(run, f"`{doc}` {kind}, text string")


def bpe_digests(
    df: DataFrame, path: str, text: str = "text", doc: str = "doc_id", lexicon_words: int = LEXICON_WORDS, keep_ids: bool = False
) -> DataFrame:
    """bpe_encode and bpe_decode as digests: doc, n_tokens, ids_sha256 (ids little-endian, 32 bits), decoded_sha256.

    With ``keep_ids`` the ids stay beside them, as array<int>.
    """
    name = build_lexicon(df, path, text, lexicon_words)
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t", 1 << 20):
            merger = merger_of(path)
            ids, offsets = encode_chunk(part.column("t"), merger, transducer_of(name))
            raw = memoryview(ids.astype("<u4").tobytes())
            own = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            back = [hashlib.sha256(t).hexdigest() for t in merger.decode_many(ids, offsets)]
            out = [part.column("i"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(own), pa.array(back)]
            if keep_ids:
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=[doc, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    fields = f"`{doc}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.select(df[doc].alias("i"), df[text].alias("t")).mapInArrow(run, fields)
