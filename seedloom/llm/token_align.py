"""Alignment of two tokenizers' tokens over a corpus, by a dictionary of the groups that they cut a text into.

A byte offset where a token of A and a token of B both end closes a group. Each block of texts interns its groups: a
text becomes a list of numbers in the block's dictionary. The dictionaries meet by group, so a group that is frequent
everywhere is one row a block; each distinct group of the corpus is expanded to its links once and counts as often as
it occurs. What a group's links are worth goes back to the blocks by the group, and there to the texts by its number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .token_counts import PATTERN, byte_symbols
from .util import chunks, release_memory

#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: A block is a row of some megabytes: the writer looks at its memory after every one, not after a hundred.
WRITER = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(1 << 25)}


class Bytes:
    """The bytes that each id of a vocabulary stands for, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array(list(map(len, tokens)), np.int64)
        self.tokens = tokens

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def byte_level(path: str):
    """(encode, Bytes) of a byte-level BPE .json file whose merges come in order of their ids; specials are plain text."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, vocab = byte_symbols(), spec["model"]["vocab"]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True

    def encode(text: str) -> list[int]:
        try:
            return coder.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # its pattern engine gives up, by an error of its own kind, on very long runs of blanks
            return exact.encode(text, add_special_tokens=False).ids

    return encode, Bytes(table)


@lru_cache(maxsize=1)
def pieces(path: str):
    """(encode, Bytes) of a sentencepiece model with byte pieces; U+2581 stands for a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        plain = b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("\u2581", " ").encode()
        raw.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else plain)
    return (lambda text: model.encode(text, num_threads=1)), Bytes(raw)


@lru_cache(maxsize=4)
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to ``most``, left in rows of bytes with room for one more, and how many each has."""
    width = len(str(most)) + 1
    table = np.array([list(f"{i:<{width}}".encode()) for i in range(most + 1)], np.uint8)
    return table, (table != 32).sum(1).astype(np.uint8)


def cut(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text "a1,a2|b1;a3|b2,b3;" of the groups of all tokens, where each group ends in it, and at which byte offset.

    Ends are byte offsets in the texts laid end to end. A token without bytes belongs to the group of those before it.
    """
    if not len(a_ids):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.zeros(int(a_ends[-1]) + 1, np.uint8)
    both[a_ends] = 1
    both[b_ends] |= 2
    both = both == 3
    common = np.flatnonzero(both)
    upto = np.cumsum(both, dtype=np.int32)
    group = [upto[e] - both[e] for e in (a_ends, b_ends)]
    del both, upto
    many = [np.bincount(g, minlength=len(common)).astype(np.int32) for g in group]
    before = [np.cumsum(m, dtype=np.int32) - m for m in many]
    ids, sign = np.empty(len(a_ids) + len(b_ids), np.int32), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    ids[np.arange(len(a_ids), dtype=np.int32) + before[1][group[0]]] = a_ids
    ids[np.arange(len(b_ids), dtype=np.int32) + (before[0] + many[0])[group[1]]] = b_ids
    del group
    last = np.cumsum(many[0] + many[1]) - 1
    sign[last] = ord(";")
    sign[last - many[1]] = ord("|")
    table, digits = _decimals(int(max(a_ids.max(), b_ids.max())))
    size = digits[ids]
    cells = table[ids]
    cells[np.arange(len(ids)), size] = sign
    data = cells[np.arange(cells.shape[1], dtype=np.uint8) <= size[:, None]]
    return data, np.cumsum(size.astype(np.int64) + 1)[last], common


def aligned_block(texts: list[str | None], first, second) -> tuple[dict[str, np.ndarray | list], pa.DictionaryArray]:
    """Counts and digest of each text, how many groups it has, and all groups of the block in order, interned."""
    (encode_a, bytes_a), (encode_b, bytes_b) = first, second
    ids, sizes = ([], []), []
    n_a, n_b, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if not text:
            continue
        want = f" {text}".encode()
        a, b = encode_a(f" {text}"), encode_b(text)
        if bytes_a.joined(a) != want or bytes_b.joined(b) != want:
            continue
        ids[0].append(np.array(a, np.int32))
        ids[1].append(np.array(b, np.int32))
        n_a[k], n_b[k], size[k] = len(a), len(b), len(want)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int32) for x in ids)
    data, stop, common = cut(a, np.cumsum(bytes_a.size[a]), b, np.cumsum(bytes_b.size[b]))
    upto = np.searchsorted(common, np.cumsum(size), side="right")
    groups = np.diff(upto, prepend=0)
    edge = np.concatenate([[0], stop])[np.concatenate([[0], upto])]
    whole = data.tobytes()
    digest = [hashlib.sha256(whole[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:])]
    starts = np.concatenate([[0], stop]).astype(np.int64)
    keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop), [None, pa.py_buffer(starts), pa.py_buffer(whole)])
    return {"n_a": n_a, "n_b": n_b, "n_groups": groups, "groups_sha256": digest}, keys.dictionary_encode()


def token_alignment(df: DataFrame, a_path: str, b_path: str, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Per row: doc, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    A: byte-level BPE .json of a space and the text; B: sentencepiece model of the text. A link is an occurrence of a
    token of A and one of B that end together: the last two of each group. A pair of ids counts as often as it is linked
    in the whole table; n_best: links whose count is the highest of their B id, ties included; count_sum: of all links.
    Null and empty texts, and those whose bytes one of the tokenizers does not keep, have no tokens: zeros and "".
    Repeated rows give repeated results and count each; an empty table gives none; other columns are not looked at.
    """
    kind = df.schema[doc].dataType.simpleString()
    whole = written(_blocks(df.select(df[doc].alias("doc"), df[text].alias("text")), a_path, b_path, kind), WRITER)
    known = whole.select("part", F.explode("known").alias("k")).select("part", "k.*")
    groups = known.groupBy("group").agg(F.sum("n").alias("n"))
    linked = groups.select("group", "n", F.explode(links("group")).alias("l")).select("group", "n", "l.a", "l.b")
    pairs = linked.groupBy("a", "b").agg(F.sum("n").alias("count"))
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    pairs = pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    worth = linked.join(pairs, ["a", "b"]).groupBy("group").agg(F.count("*").alias("links"), F.count_if("best").alias("best"), F.sum("count").alias("sum"))
    back = known.join(worth, "group").groupBy("part").agg(F.collect_list(F.struct("number", "links", "best", "sum")).alias("worth"))  # no more than a block's groups
    return _worth_of_texts(whole.select("part", "docs", "numbers").join(back, "part", "left"), doc, kind)


def links(group: str):
    """array<struct<a,b>>: the pairs of a group "a1,a2|b1;" that end together, of which it has one."""
    whole = F.col(group).cast("string")
    last = lambda x: F.substring_index(x, ",", -1).cast("int")
    return F.array(F.struct(last(F.substring_index(whole, "|", 1)).alias("a"), last(F.rtrim(F.substring_index(whole, "|", -1), F.lit(";"))).alias("b")))


def _blocks(df: DataFrame, a_path: str, b_path: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, task = byte_level(a_path), pieces(b_path), TaskContext.get().partitionId() << 32
        for k, part in enumerate(chunks(batches, "text", BLOCK_BYTES)):
            docs, groups = aligned_block(part.column("text").to_pylist(), first, second)
            counts = np.bincount(groups.indices.to_numpy(zero_copy_only=False), minlength=len(groups.dictionary))
            rows = pa.StructArray.from_arrays([part.column("doc"), *[pa.array(docs[c]) for c in ("n_a", "n_b", "n_groups", "groups_sha256")]], ["doc", "n_a", "n_b", "n_groups", "groups_sha256"])
            known = pa.StructArray.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), groups.dictionary.cast(pa.binary()), pa.array(counts.astype(np.int64))], ["number", "group", "n"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([task + k]), one(rows), one(groups.indices), one(known)], names=["part", "docs", "numbers", "known"])
            release_memory()

    return df.mapInArrow(run, f"part long, docs array<struct<doc:{kind},n_a:long,n_b:long,n_groups:long,groups_sha256:string>>, numbers array<int>, known array<struct<number:int,group:binary,n:long>>")


def _worth_of_texts(blocks: DataFrame, doc: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                docs, numbers, worth = (row.column(c).flatten() for c in ("docs", "numbers", "worth"))
                at, upto = worth.field("number").to_numpy(), np.concatenate([[0], np.cumsum(docs.field("n_groups").to_numpy())])
                sums = []
                for c in ("links", "best", "sum"):
                    value = np.zeros(len(at) and int(at.max()) + 1, np.int64)
                    value[at] = worth.field(c).to_numpy()
                    total = np.concatenate([[0], np.cumsum(value[numbers.to_numpy()])])
                    sums.append(pa.array(total[upto[1:]] - total[upto[:-1]]))
                own = [docs.field(c) for c in ("n_a", "n_b", "n_groups")]
                yield pa.RecordBatch.from_arrays([docs.field("doc"), *own, *sums, docs.field("groups_sha256")], names=[doc, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
            release_memory()

    return blocks.mapInArrow(run, f"`{doc}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
