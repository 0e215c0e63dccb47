"""Each stage of the pipeline on its own input against brute force, with odd rows and columns of clashing names."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, t string, n int"
WORDS = "the ship of north is in water and wind was with it for day that by sea a while years ago They saw boats".split()


def made():
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(k, say(int(rng.integers(30, 120))), "en", f"src{k % 7}") for k in range(80)]
    rows += [(100 + k, rows[k][1], "en", "src1") for k in range(10)]  # exact copies
    rows += [(200 + k, rows[20 + k][1] + " one more", "en", "src2") for k in range(10)]  # near copies
    rows += [(300 + k, rows[20 + k][1] + " one more time", "en", "src3") for k in range(10)]
    rows += [(400, None, None, None), (401, "", "en", "src1"), (402, "", "de", ""), (403, " \t\n", "en", "src1"), (404, "two words", "en", "src1"), (405, "two words", "en", "src9")]
    rows += [(406, say(9000), "en", "src1"), rows[3], rows[3], (407, None, "en", "src2")]
    return [(*r, len(r[1] or ""), "x", "y", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(4)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_exact_dedup_keeps_the_largest_id_of_each_text(spark, docs):
    kept = corpus_pipeline.exact_duplicates(spark, docs, "")
    largest = {}
    for i, t, *_ in made():
        largest[t or ""] = max(largest.get(t or "", i), i)
    assert kept.columns == docs.columns and ids(kept) == Counter(largest.values())


def test_near_duplicates_leave_one_of_each_component(spark, docs):
    rows = {r[0]: r[1] for r in made() if r[0] not in (100 + np.arange(10))}
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {find(i) for i in rows}
    some = docs.filter("doc_id not between 100 and 109").dropDuplicates(["doc_id"])
    kept = corpus_pipeline.near_duplicates(spark, some, "")
    assert kept.columns == docs.columns and ids(kept) == Counter(want) and len(want) < len(rows) - 15


def test_mix_takes_each_document_once_and_keeps_to_its_budget(spark, docs):
    kept = corpus_pipeline.source_mix(spark, docs, "")
    tokens = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows)
    whole, taken = [r[1] for r in made()], [r.text for r in kept.select("text").collect()]
    assert kept.columns == docs.columns and not ids(kept) - Counter(r[0] for r in made())
    largest = max(map(lambda t: tokens([t]), whole))
    assert tokens(taken) <= tokens(whole) * 9 // 10 + 25 * largest and tokens(taken) >= tokens(whole) // 2


def test_encoding_equals_the_library(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.bpe_encoding(spark, docs, "").collect())
    assert got == Counter((r[0], tuple(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in made())


def test_quality_rejects_junk_and_keeps_texts_like_the_trusted(spark, tmp_path):
    rng = np.random.default_rng(5)
    junk = [(900 + k, "".join(rng.choice(list("0123456789{}=;#"), 500)), "en", "src1", 500, "x", "y", 1) for k in range(5)]
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(900, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([*made(), *junk], SCHEMA).repartition(3)
    kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    gone = Counter(r[0] for r in [*made(), *junk]) - ids(kept)
    assert set(range(900, 905)) <= set(gone) and not {i for i in gone if i < 110 or i in (401, 402, 406)}  # others hold words that no trusted text has


def test_stages_of_an_empty_table(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
