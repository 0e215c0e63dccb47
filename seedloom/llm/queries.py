"""The queries of this subpackage, each over its whole table with production parameters, and the SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_lexicon, chat_windows, exact_dedup, filter_audit, kn_quality, lbl_score, mixing, ngram_join, nn_descent, ppm_langid, secret_scan, token_align, token_counts
from .util import read, small_batches


#: The tree of the mix: four domains by a source's number, languages, sources; its weights, budget and epochs.
LEVELS = [
    (
        "domain",
        "concat('domain', try_cast(regexp_extract(source, '([0-9]+)', 1) as int) % 4)",
        "case m_domain when 'domain0' then 4 when 'domain1' then 3 when 'domain2' then 2 else 1 end",
    ),
    ("lang", "lang", "case m_lang when 'en' then 5 when 'de' then 3 when 'fr' then 3 when 'es' then 2 else 1 end"),
    ("source", "source", "1 + length(m_source) % 3"),
]
#: Of ten parts of the table's tokens, those that the mix takes; a document is taken at most MIX_EPOCHS times.
MIX_TENTHS, MIX_EPOCHS, MIX_SEED = 9, 3, 17


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = f"tokens * {MIX_TENTHS} div 10"
    mixed = mixing.mix(read(spark, sf_dir, "documents"), LEVELS, budget, MIX_EPOCHS, MIX_SEED)
    renamed = [F.col(f"m_{c}").alias(c) for c in ("domain", "lang", "source", "epoch")]
    return mixed.select("doc_id", *renamed, F.col("m_tokens").alias("n_tokens"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.with_digest(secret_scan.secret_scan(read(spark, sf_dir, "documents")))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op4_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    trusted = read(spark, sf_dir, "labels").filter("quality = 1 and doc_id is not null")
    return kn_quality.quality(read(spark, sf_dir, "documents"), trusted)


def op5_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_langid.language_id(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_rows(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op10_lbl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_score.lm_scores(read(spark, sf_dir, "documents"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_align.token_alignment(read(spark, sf_dir, "documents"), *paths)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, said = "conv_id long, turn long, role string, text string", "</s>[INST] ok [/INST]"
    known = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], kinds)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(known)
    return chat_windows.read_back(chat_windows.chat_windows(rows, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_secret_scan,
        op3_ngram_join,
        op4_kn_quality,
        op5_ppm_langid,
        op6_exact_dedup,
        op7_token_counts,
        op8_bpe_lexicon,
        op9_nn_descent,
        op10_lbl_score,
        op11_token_align,
        op12_filter_audit,
        op13_chat_windows,
    )
}


def _mix_sql() -> str:
    """The mix over the same tree: one water-filling a level, then each leaf's epochs in their orders."""

    def level(name: str, parent: list[str], weight: str, above: str) -> str:
        path, by = [*parent, name], f"PARTITION BY {', '.join(parent) or '0'}"
        join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
        return f"""
        {name}_0 AS (SELECT l.*, budget, {weight} AS weight FROM
            (SELECT {', '.join(path)}, sum(tokens * {MIX_EPOCHS})::BIGINT AS cap FROM leaves GROUP BY ALL) l {join}),
        {name}_1 AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
            sum(weight) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM {name}_0),
        {name}_2 AS (SELECT *, cap * w <= (budget - b) * weight AS filled FROM {name}_1),
        {name}_3 AS (SELECT {', '.join(path)}, (CASE WHEN filled THEN cap ELSE
            ((budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by})) * weight) // sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) END)::BIGINT AS budget FROM {name}_2)"""

    domain = "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END"
    lang = "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 WHEN 'fr' THEN 3 WHEN 'es' THEN 2 ELSE 1 END"
    return f"""
        WITH docs AS (SELECT doc_id, coalesce('domain' || (try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT) % 4), 'none') AS domain,
            coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
        root AS (SELECT least(sum(tokens * {MIX_EPOCHS}), sum(tokens) * {MIX_TENTHS} // 10)::BIGINT AS budget FROM leaves),
        {level("domain", [], domain, "root")}, {level("lang", ["domain"], lang, "domain_3")},
        {level("source", ["domain", "lang"], "1 + length(source) % 3", "lang_3")},
        placed AS (SELECT d.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, tokens, budget
            FROM docs d JOIN source_3 USING (domain, lang, source) JOIN leaves USING (domain, lang, source)),
        ordered AS (SELECT *, budget - whole * tokens AS rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('{MIX_SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'none')), doc_id, n_tokens
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM placed)
        SELECT doc_id, domain, lang, source, unnest(range(whole))::INT AS epoch, n_tokens FROM placed
        UNION ALL SELECT doc_id, domain, lang, source, whole::INT, n_tokens FROM ordered WHERE spent < rest
    """


_AUDIT_SQL = """
    WITH marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    sets AS (SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
            + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
            + 16 * coalesce(least < doc_id, false)::INT AS mask,
        count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM docs LEFT JOIN marked USING (doc_id) GROUP BY ALL),
    one AS (SELECT chr(65 + i::INT) AS f FROM range(0, 5) r(i)),
    orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM one a, one b, one c, one d, one e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    steps AS (SELECT filter_order, (k + 1)::INT AS step, 1 << (ascii(filter_order[k + 1]) - 65) AS bit,
        coalesce(list_sum(list_transform(range(1, k + 1), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS applied FROM orders, range(0, 5) r(k)),
    paths AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & bit != 0 AND mask & applied = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & bit != 0 AND mask & applied != 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & bit != 0 AND mask & applied = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & bit != 0 AND mask & applied = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM sets, steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM paths
"""

ORACLE_SQL = {
    "op12_filter_audit": _AUDIT_SQL,
    "op1_source_mix": _mix_sql(),
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
