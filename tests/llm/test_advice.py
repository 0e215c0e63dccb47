"""Cases of review findings: what the operators left out before."""

import numpy as np
import pytest

from seedloom.llm import kn_quality, lbl_score, nn_descent, secret_scan


def test_lm_symbols_grow_and_all_words_sum_to_one():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 6000))
    counts = np.sort(rng.zipf(1.3, len(keys)) % 3000 + 1)[::-1].astype(np.int64)
    endings = np.zeros((1 << lbl_score.TAIL_BITS, 2), np.int64)
    np.add.at(endings, keys & ((1 << lbl_score.TAIL_BITS) - 1), np.stack([counts, np.ones_like(counts)], 1))
    total = int(counts.sum()) + 50
    keys, counts = np.append(keys, lbl_score.END), np.append(counts, 50)
    words = lbl_score.Vocabulary(keys, counts, total, len(keys), endings)
    symbols, n = words.look_up(keys)
    assert words.size > 1024 and len(set(symbols[1100:1500])) == 400  # before, one symbol for all
    assert lbl_score.words_wanted(4 * total) == pytest.approx(2 * lbl_score.words_wanted(total), abs=2)
    model = lbl_score.LogBilinear(words.unigram)
    for _ in range(20):
        model.train([rng.integers(0, words.size, 500), rng.integers(0, words.size, 500)], rng.integers(0, words.size, 500), rng)
    before = [np.full(words.size, 3), np.full(words.size, 1200)]
    p = np.exp(model.log_probs(before, np.arange(words.size)))
    assert p.sum() == pytest.approx(1, abs=1e-3)
    share = np.where(words.shares_ending(symbols), (n + 1) / 10 ** words.log_outside[symbols], 1)
    unseen = (p[1 : words.tails + 1] / 10 ** words.log_outside[1 : words.tails + 1]).sum()
    assert (p[symbols] * share).sum() + unseen == pytest.approx(1, abs=1e-3)


def test_lm_learns_what_follows_words_beyond_the_thousandth(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"a{x} b{x}" for x in rng.integers(0, 1500, 400))) for k in range(250)]
    rows += [(1000, " ".join(f"a{x} b{x}" for x in range(1500))), (1001, " ".join(f"a{x} b{(x + 7) % 1500}" for x in range(1500)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in lbl_score.lm_scores(df).filter("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 1


def test_quality_rejects_smooth_junk_of_other_characters(spark):
    rng = np.random.default_rng(4)
    words = "the ship of north is in water and wind was with it for day that by sea a while 7 years ago, In 1893 They saw 20 boats".split()
    rows = [(k, " ".join(rng.choice(words, 120)), "en") for k in range(60)]
    alphabets = {900: range(48, 58), 901: range(0x4E00, 0x4E40), 902: [0xFFFD], 903: range(0x1F600, 0x1F640), 904: range(0x391, 0x3C9)}
    rows += [(k, "".join(chr(c) for c in rng.choice(list(a), 600)), "en") for k, a in alphabets.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(50)], "doc_id long")
    got = {r.doc_id: r.accepted for r in kn_quality.quality(df, trusted).collect()}
    assert [k for k in alphabets if got[k]] == []
    assert all(got[k] for k in range(60))


def test_kneser_ney_equals_plain_python(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc dé😀"), int(n))) for n in rng.integers(1, 60, 12)]
    levels = [{}]
    for t in texts:
        t = "^^^" + t
        for k in range(3, len(t)):
            levels[0][t[k - 3 : k + 1]] = levels[0].get(t[k - 3 : k + 1], 0) + 1
    for _ in range(3):
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)

    def p(gram):
        if not gram:
            return 1 / 0x110000
        level = levels[4 - len(gram)]
        d = kn_quality.discounts([sum(n == k for n in level.values()) for k in (1, 2, 3, 4)])
        cut = lambda n: d[min(n, 3) - 1]
        same = [n for g, n in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        n = level.get(gram, 0)
        return ((n - cut(n)) if n else 0) / sum(same) + sum(map(cut, same)) / sum(same) * p(gram[1:])

    rows = [(k, t, "x") for k, t in enumerate([*texts, "abc d", "é😀zz", "日本a", "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(len(texts))], "doc_id long")
    got = {r.doc_id: r for r in kn_quality.quality(df, trusted).collect()}
    bits = lambda t: -sum(np.log2(p(("^^^" + t)[k - 3 : k + 1])) for k in range(3, len(t) + 3))
    for k, t, _ in rows:
        assert got[k].scored_chars == len(t or "") and (got[k].perplexity is None) == (not t)
        if t:
            assert got[k].perplexity == pytest.approx(2 ** (bits(t) / len(t)), rel=1e-5)
    own = np.array([[bits(t), len(t)] for t in texts])
    middle = sorted(own[:, 0] / own[:, 1])[(len(own) - 1) // 2]
    drawn = lambda b, n: (b + kn_quality.PRIOR_CHARS * middle) / (n + kn_quality.PRIOR_CHARS)
    cut = sorted(drawn(own[:, 0], own[:, 1]))[int(np.ceil(kn_quality.QUANTILE * len(own))) - 1] + kn_quality.SLACK
    for k, t, _ in rows:
        assert got[k].accepted == (not t or drawn(bits(t), len(t)) <= cut)


def test_secret_models_withstand_bare_tokens_in_the_sample():
    rng = np.random.default_rng(8)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    base62, words = secret_scan.ALPHABET[:62], "the ship of north wind water with that value index name read count table state house light".split()
    texts = [" ".join(rng.choice(words, 200)) for _ in range(200)]
    planted = [make(base62, 40) for _ in range(20)]
    model = secret_scan.train([t + (" " + planted[k] if k < 20 else "") for k, t in enumerate(texts)])
    assert all(map(model.is_random, planted))
    for letters, n in (("0123456789abcdef", 31), (base62, 24), (base62, 40), (secret_scan.ALPHABET[:64], 40), (base62, 16), (base62[:52], 32)):
        assert sum(model.is_random(make(letters, n)) for _ in range(200)) >= 190, (letters, n)
    plain = ["the_north_wind_of_value_2", "IndexOfTheWaterTable2", "state/house/light/name", "thestateofthenorthwind"]
    assert not any(map(model.is_random, plain))
    assert [k for k, _, _ in secret_scan.all_spans("the value " + planted[0][:18] + " of", model)] == ["markov"]


def test_secret_scan_finds_bare_tokens_in_a_table(spark):
    """Bare tokens planted behind more than 400 words are found, however the table is split; clean documents have none."""
    rng = np.random.default_rng(9)
    words = "the ship of north wind water with that value index name read count table state house light".split()
    letters = list(secret_scan.ALPHABET[:62])
    rows = [(k, " ".join(rng.choice(words, 600)) + (" " + "".join(rng.choice(letters, 40)) + " end" if k % 15 == 0 else "")) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for parts in (2, 31):
        for r in secret_scan.secret_scan(df.repartition(parts)).collect():
            got.setdefault(r.doc_id, set()).add(r.spans)
    for k, text in rows:
        assert got[k] == ({f"markov:{len(text) - 44}:{len(text) - 4}"} if k % 15 == 0 else {""})


def test_nearest_rows_withstand_a_large_component_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[7, 3] = 1000
    y = rng.normal(size=(40, 5)).astype(np.float32)
    rows = [(10_000 + 100 * k, v.tolist()) for k, v in enumerate(y)] + [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in nn_descent.nearest_rows(df, "vec_id % 100 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    near = lambda a, q: set(np.argsort(((a.astype(np.float64) - a[q]) ** 2).sum(1))[1:11].tolist())
    assert sum(len(got[q] & near(x, q)) for q in range(0, 3000, 100)) >= 285
    assert all(got[10_000 + 100 * k] == {10_000 + 100 * i for i in near(y, k)} for k in range(40))


def test_lm_scores_few_sums_and_stays_normalised_at_extremes():
    share = 1 / np.arange(1, 4001)
    model = lbl_score.LogBilinear(share / share.sum())
    sizes = np.diff(model.edges)
    assert sizes.sum() == 4000 and (np.diff(model.block) >= 0).all() and (model.block == np.repeat(np.arange(len(sizes)), sizes)).all()
    assert len(sizes) + (share / share.sum() * sizes[model.block]).sum() < 0.75 * 2 * 4000**0.5  # scores of a token
    assert sizes[0] < 10 < sizes[-1]
    for bias in (0, 90, -120):
        model.b += np.float32(bias)
        before = [np.full(4000, 3), np.full(4000, 5)]
        assert np.exp(model.log_probs(before, np.arange(4000))).sum() == pytest.approx(1, abs=1e-3)


def test_broadcasts_of_a_search_stay_a_few_megabytes():
    widest = nn_descent.FRESH * 2 * 8 + nn_descent.ASKED * (nn_descent.POOL * 8 + 1024 * 8)
    assert widest < 4 << 20  # before: 31 MB for a round, at most
