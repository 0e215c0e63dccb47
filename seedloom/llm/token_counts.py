"""Token counts of whole texts by a byte-level BPE tokenizer, in Arrow functions that return lengths only.

Rows are encoded in batches of about BATCH_BYTES bytes, one call a batch. A text over SPLIT_BYTES is encoded in pieces,
cut only where the tokenizer's own pattern always starts a new pre-token: before white space that follows another
character, and where two of letters, digits and other signs meet (but for apostrophes), in ASCII and in the scripts of
LETTERS and SIGNS. Merges never cross pre-tokens, so the pieces' counts add up to the text's count; a single pre-token
has no such place, and stays whole however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .util import chunks

BATCH_BYTES = 1 << 20
SPLIT_BYTES = 1 << 16
#: Letters, digits and signs that every version of Unicode in use knows as such; no apostrophe, which may start a pre-token.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏΑ-Ρα-ωА-яא-תؠ-يक-हก-ฮぁ-ゖァ-ヺ一-龥가-힣"
DIGITS = "0-9"
SIGNS = r"!-&(-/:-@\[-`{-~‐-‗†-‧、-〃〈-】！-＆（-／：-＠"
SAFE = regex.compile(
    r"(?<=[^\s\p{Z}\p{C}])(?=[ \t\n\r])|"
    + "|".join(f"(?<=[{a}])(?=[{b}])" for a, b in permutations((LETTERS, DIGITS, SIGNS), 2))
)
#: The pre-token pattern of byte-level BPE files with "use_regex" (a fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a list of texts to their token counts, for a .json file of plain byte-level BPE.

    The merges are taken as ranks, which holds when the vocabulary numbers them in order; another layout is an error.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, symbols = spec["model"]["vocab"], byte_symbols()
    pre = spec["pre_tokenizer"]
    plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    added = [t for t in spec["added_tokens"] if not (t["single_word"] or t["lstrip"] or t["rstrip"])]
    if not plain or merged != sorted(merged) or len(added) != len(spec["added_tokens"]):
        raise ValueError(f"{path} is not a plain byte-level BPE file with merges in order of their ids")
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(texts: list[str]) -> np.ndarray:
        parts = [list(pieces(t, marks)) for t in texts]
        n = np.array([len(x) for x in coder.encode_batch([p for some in parts for p in some], num_threads=1, allowed_special="all")], np.int64)
        first = np.cumsum([0, *map(len, parts)])[:-1]
        return np.add.reduceat(n, first) if len(n) else n

    return count


def size_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def pieces(text: str, marks=None, limit: int = SPLIT_BYTES) -> Iterator[str]:
    """The text in pieces of ``limit`` bytes at least, cut at safe places only, and never inside a special string."""
    start = 0
    step = max(1, limit * len(text) // max(1, size_of(text)))  # characters of that many bytes, about
    while len(text) - start > step:
        cut = next(
            (m.start() for m in SAFE.finditer(text, start + step) if not marks or not _inside(marks, text, m.start())),
            None,
        )
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _inside(marks, text: str, at: int, around: int = 256) -> bool:
    return any(m.start() < at < m.end() for m in marks.finditer(text, max(0, at - around), at + around))


def token_counts(df: DataFrame, path: str, text: str = "text", doc: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Per row: doc, n_bytes, n_tokens, over_limit (n_tokens > limit). Null texts count as empty, and empty ones as 0.

    Repeated rows give repeated results, an empty table none; ``df`` may hold any other columns.
    """
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for part in chunks(batches, "t", BATCH_BYTES):
            count = count or counter(path)
            texts = [t or "" for t in part.column("t").to_pylist()]
            n = count(texts)
            size = np.fromiter(map(size_of, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("i"), pa.array(size), pa.array(n), pa.array(n > limit)],
                names=[doc, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(df[doc].alias("i"), df[text].alias("t")).mapInArrow(
        run, f"`{doc}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
