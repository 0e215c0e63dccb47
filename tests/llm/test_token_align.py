"""Token alignment against the libraries and plain counting, and odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from seedloom.llm import token_align
from seedloom.llm.token_counts import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, part string, docs int, known string, group string, n int, a int"


def brute(texts):
    tok, model, symbols = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_symbols()
    tok.encode_special_tokens = True
    found, counts = [], Counter()
    for text in texts:
        whole, groups, a, b = f" {text}".encode(), [], [], []
        if text:
            a = [(i, bytes(symbols[c] for c in tok.id_to_token(i))) for i in tok.encode(f" {text}", add_special_tokens=False).ids]
            for i in model.encode(text):
                p = model.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        common, linked = sorted(ends[0] & ends[1]), []
        for lo, hi in zip([0, *common], common):
            sides, last = [], []
            for side in (a, b):
                at, own = 0, []
                for i, x in side:
                    at += len(x)
                    if lo < at <= hi:
                        own.append(i)
                    if at == hi:
                        last.append(i)
                sides.append(own)
            groups.append("|".join(",".join(map(str, s)) for s in sides))
            linked.append(tuple(last))
        counts.update(linked)
        found.append((len(a), len(b), groups, linked))
    most = defaultdict(int)
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for n_a, n_b, groups, linked in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(linked), sum(counts[x] == most[x[1]] for x in linked), sum(counts[x] for x in linked), digest))
    return out


def texts():
    rng = np.random.default_rng(4)
    bits = ["the ", "ship", "é", "日本", "😀", " ", "  ", "\n", "<s>", "</s>", "<|endoftext|>", "<unk>", "\t", "0123", "don't", "ü", "á", "▁", "\x00", "<0x41>", "ﬁ", "　", "﻿"]
    some = ["".join(rng.choice(bits, int(rng.integers(1, 40)))) for _ in range(150)]
    return [None, "", " ", "\n", "a▁b", "<s>", "the ship " * 300, "x" * 3000, " " * 500, *some, some[3], some[3], "the ship of the north", "the ship"]


def test_alignment_equals_plain_counting(spark, monkeypatch):
    rows = [(k, t, "x", 1, "y", "z", 2, 3) for k, t in enumerate(texts())]
    want = {k: w for k, w in enumerate(brute(texts()))}
    assert sum(w[0] > 0 for w in want.values()) > 60 and sum(w[0] == 0 for w in want.values()) > 10
    for size in (token_align.BLOCK_BYTES, 700):
        monkeypatch.setattr(token_align, "BLOCK_BYTES", size)
        got = token_align.token_alignment(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        found = got.collect()
        assert {r.doc_id: tuple(r[1:]) for r in found} == want and len(found) == len(want)


def test_alignment_of_repeated_ids_and_of_an_empty_table(spark):
    rows = [(None, "the ship", "", 1, "", "", 1, 1), (None, None, "", 1, "", "", 1, 1), (5, "the ship", "", 1, "", "", 1, 1), (5, "the ship", "", 1, "", "", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute([r[1] for r in rows]))
    assert sorted(tuple(r[1:]) for r in token_align.token_alignment(docs, A, B).collect()) == want
    assert token_align.token_alignment(docs.limit(0), A, B).count() == 0


def test_a_long_run_of_blanks(spark):
    encode, table = token_align.byte_level(A)
    text = " " * 1_200_000 + "x"
    assert table.joined(encode(text)) == text.encode()
