"""Chat windows read back against the rows they were made from; budgets, masks, history and odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from seedloom.llm import chat_windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, key string, block int, piece string, tokens int"
ODD = ["</s>[INST] ok [/INST]", "<<SYS>>\nx\n<</SYS>>\n\n", "\\", "a\\</s>\\\\[INST]", "<<s>", "<", "[", " ", "\n", "", None, "<|im_end|>é日😀", "[ROLE:=x] y [/ROLE]", "<\\s>", "]", " </s>", "a\\"]


def rows():
    rng = np.random.default_rng(3)
    words = [*"the ship of north wind is at sea".split(), *[x for x in ODD if x]]
    found = []
    for c in range(40):
        lead = [("system", "be brief " * int(rng.integers(1, 60)))] if c % 3 == 0 else []
        for k in range(int(rng.integers(1, 30))):
            lead.append((("user", "assistant")[k % 2], " ".join(rng.choice(words, int(rng.integers(0, 120))))))
        found += [(c, k, r, t) for k, (r, t) in enumerate(lead)]
    found += [(100, k, ("user", "assistant")[k % 2], f"turn {k} of many") for k in range(700)]
    found += [(101, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("tool]", "", None, "a\\]", "[INST]", "system", "assistant") for t in ODD)]
    found += [(102, 0, "system", "only this"), (103, 5, "assistant", "word " * 5000), (103, None, "user", "first"), (103, 9, "user", "last"), (103, -400, "user", "early")]
    found += [(104, 1, "user", "same"), (104, 1, "user", "same"), (104, 1, "assistant", "same"), (104, 1, None, "same"), (None, 1, "assistant", "no id"), (None, 0, "user", "none")]
    found += [(105, 0, "system", "long " * 3000), (105, 1, "user", "hi"), (105, 2, "assistant", "ho")]
    return [(*r, "x", 1, "y", 2) for r in found]


def by_conversation():
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows():
        convs[c].append((t is not None, t or 0, r is not None, r or "", x or ""))
    return {c: [(v[3], v[4]) for v in sorted(x)] for c, x in convs.items()}


@pytest.fixture(scope="module")
def windows(spark):
    return chat_windows.chat_windows(spark.createDataFrame(rows(), SCHEMA).repartition(6), PATH, 300, 60).cache()


def test_read_back_gives_every_turn_and_target_once(windows):
    want = {}
    for c, turns in by_conversation().items():
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = chat_windows.read_back(windows).collect()
    assert {r.conv_id: tuple(r[1:5]) for r in got} == want and len(got) == len(want)
    size = defaultdict(int)
    for w in windows.collect():
        size[w.conv_id] += len(w.formatted)
    assert {r.conv_id: r.formatted_chars for r in got} == size


def test_windows_keep_budget_system_turn_and_history(windows):
    convs, seen = by_conversation(), defaultdict(list)
    repeated = 0
    for w in sorted(windows.collect(), key=lambda w: (w.conv_id is not None, w.conv_id or 0, w.window)):
        turns = [(r or "", x) for r, x in chat_windows.parse(w.formatted)]
        assert len(turns) == w.n_turns and w.over_budget == (w.tokens > 300)
        assert not w.over_budget or w.n_turns - w.n_repeated <= 2
        before, system = seen[w.conv_id], convs[w.conv_id][0][0] == "system"
        if w.window:
            lead = turns[: w.n_repeated]
            if system:
                assert lead[0] == convs[w.conv_id][0]
                lead = lead[1:]
            assert lead == before[len(before) - len(lead) :]
            repeated += len(lead)
        else:
            assert w.n_repeated == 0
        masked = [chat_windows.unescaped(w.formatted[a.start : a.end]) for a in w.loss]
        assert masked == [x for r, x in turns[w.n_repeated :] if r == "assistant"]
        seen[w.conv_id] += turns[w.n_repeated :]
    assert repeated > 100 and sum(len(x) > 1 for x in seen.values()) > 30
    assert {c: x for c, x in seen.items()} == {c: x for c, x in convs.items()}


def test_control_strings_are_escaped_and_come_back(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    bits = [*chat_windows.CONTROL, "\\", "<", "[", "]", " ", "s>", "/", "INST]", "é"]
    texts = [x for x in ODD if x] + ["".join(rng.choice(bits, 8)) for _ in range(2000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_windows.escaped(F.col("t")).alias("e")).collect():
        assert chat_windows.unescaped(r.e) == r.t and not any(c in r.e for c in chat_windows.CONTROL)


def test_empty_table(spark):
    none = chat_windows.chat_windows(spark.createDataFrame([], SCHEMA), PATH)
    assert none.count() == 0 and chat_windows.read_back(none).count() == 0
