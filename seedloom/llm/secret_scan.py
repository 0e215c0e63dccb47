"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order Markov chains over characters are trained from labelled samples: random strings (the values that the
fixed patterns find, and seeded random strings over the usual alphabets) against ordinary identifiers (words of the
corpus, alone and joined as snake_case or camelCase). A candidate run of identifier characters is reported as a
"markov" span when its log-likelihood ratio, random over ordinary, passes fixed bounds, in all and per character; what
the sample holds does not move them. Ordinary are only whole runs that several sampled documents hold, so that neither
secrets nor their fragments train that model. The scan covers every whole text; only the training sample is bounded, by
SAMPLE_DOCS. Its words and values are counted in Spark, over whole texts; of them the most frequent reach the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import broadcast_value, chunks

#: Documents whose words and pattern matches train the models, about; those whose hashed ids fall below a bound.
SAMPLE_DOCS = 2000
#: Different ordinary words, and different values of the fixed patterns, that train the models, the most frequent first.
SAMPLE_STRINGS = 50_000
#: Characters of a candidate run that the models judge, at least.
LEAST = 16
#: Documents of the sample that hold an ordinary word, at least.
SHARED_BY = 2
#: Bits of the ratio that outweigh how rare secrets are, in all and per character: runs with digits, runs without.
PRIOR = {True: (24.0, 1.0), False: (40.0, 1.5)}
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINT = re.compile(r"passw|secret|token|key")
WORD_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,24}(?![A-Za-z0-9+/_-])")
RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns: kind, start and end of the whole match in code points, by start, then kind."""
    found = []
    if HINT.search(text.lower()):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _chain(samples: Mapping[str, int]) -> np.ndarray:
    """log2 transition probabilities of strings with their counts, add-half smoothed; the last row starts a string."""
    n = len(ALPHABET) + 1
    counts = np.full((n, n), 0.5)
    for s, times in samples.items():
        codes = CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]
        np.add.at(counts, (np.concatenate([[n - 1], codes[:-1]]), codes), times)
    return np.log2(counts / counts.sum(1, keepdims=True))


class MarkovScorer:
    """Log-likelihood ratio in bits per character of random over ordinary strings."""

    def __init__(self, random: Mapping[str, int], ordinary: Mapping[str, int]):
        self.ratio = _chain(random) - _chain(ordinary)

    def score(self, s: str) -> float:
        codes = CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]
        return float(self.ratio[np.concatenate([[len(ALPHABET)], codes[:-1]]), codes].mean()) if len(codes) else 0.0

    def is_random(self, s: str) -> bool:
        """Random by the ratio; runs without letters are numbers."""
        if not any(c.isalpha() for c in s):
            return False
        whole, each = PRIOR[any(c.isdigit() for c in s)]
        return self.score(s) > max(whole / len(s), each)


def samples_of(text: str) -> tuple[Counter, Counter]:
    """Values that the fixed patterns find in a text, and the words outside them, with their counts."""
    spans, at, outside = base_spans(text), 0, []
    for _, a, b in spans:
        outside.append(text[at : max(a, at)])
        at = max(at, b)
    outside.append(text[at:])
    return Counter(re.split(r"[\"' :=]", text[a:b])[-1] for _, a, b in spans), Counter(WORD_RUN.findall(" ".join(outside)))


def train(texts: list[str], seed: int = 7) -> MarkovScorer:
    """Both models from labelled samples: what the patterns find in the texts, and the words that texts share."""
    values, words, texts_with = Counter(), Counter(), Counter()
    for text in texts:
        found, others = samples_of(text)
        values += found
        words += others
        texts_with.update(others.keys())
    return fit(values, {w: n for w, n in words.items() if texts_with[w] >= SHARED_BY}, seed)


def fit(values: Mapping[str, int], words: Mapping[str, int], seed: int = 7) -> MarkovScorer:
    """Both models from values and words with their counts, and seeded random strings and compounds of the words."""
    rng = np.random.default_rng(seed)
    random, ordinary = Counter(values), Counter(words)
    for size, letters in ((16, "0123456789abcdef"), (36, ALPHABET[:26] + ALPHABET[52:62]), (36, ALPHABET[26:62]), (62, ALPHABET[:62]), (64, ALPHABET[:64])):
        random.update("".join(letters[k % len(letters)] for k in rng.integers(0, size, int(n))) for n in rng.integers(20, 48, 400))
    names = sorted(words) or ["the", "value", "index", "name"]
    pick = lambda n: [names[k] for k in rng.integers(0, len(names), n)]
    ordinary.update("_".join(w.lower() for w in pick(k)) + str(k) * (k % 2) for k in rng.integers(2, 6, 3000))
    ordinary.update("".join(w.capitalize() for w in pick(k)) + str(k) * (k % 2) for k in rng.integers(2, 6, 3000))
    ordinary.update(["/".join(pick(k)) for k in rng.integers(2, 6, 1000)] + ["-".join(pick(k)).lower() for k in rng.integers(2, 6, 1000)])
    return MarkovScorer(random, ordinary)


def sample_counts(texts: DataFrame) -> DataFrame:
    """(secret, s, n, texts) of the values and words of whole texts ``t``, words of one text alone left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t"):
            rows = [(kind == 0, s, n) for t in part.column("t").to_pylist() for kind, found in enumerate(samples_of(t)) for s, n in found.items()]
            if rows:
                secret, s, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(secret), pa.array(s), pa.array(n, pa.int64())], names=["secret", "s", "n"])

    each = texts.mapInArrow(run, "secret boolean, s string, n long")
    counted = each.groupBy("secret", "s").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    return counted.filter(F.col("secret") | (F.col("texts") >= SHARED_BY))


def all_spans(text: str, scorer: MarkovScorer, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """The base spans, and the runs outside them that the models call random."""
    base = base_spans(text) if base is None else base
    extra = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if all(b <= s or a >= e for _, s, e in base) and scorer.is_random(m[0]):
            extra.append(("markov", a, b))
    return sorted([*base, *extra], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(df: DataFrame, text: str = "text", doc: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: doc, spans array<struct<kind,start,end>> with code points (end exclusive), and the same as ``spans_text``.

    Null texts count as empty and have no spans. Repeated rows give repeated results; an empty table gives none. The
    sample goes by hashes of id and text, so neither the order of rows nor their partitions change the models.
    """
    spark = df.sparkSession
    own = df.select(F.col(doc).alias("i"), F.col(text).alias("t"))
    share = min(1.0, sample_docs / max(1, own.count()))
    sample = F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(1 << 31)) < int(share * (1 << 31))
    counts = sample_counts(own.filter(sample & F.col("t").isNotNull()).select("t"))
    best = Window.partitionBy("secret").orderBy(F.desc("n"), "s")
    top = counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= SAMPLE_STRINGS).orderBy("secret", "place").collect()
    model = fit(*({r.s: r.n for r in top if r.secret == secret} for secret in (True, False)))
    shared = broadcast_value(spark, model)
    kind = own.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "t"):
            base, every = [], []
            for t in part.column("t").to_pylist():
                base.append(base_spans(t or ""))
                every.append(all_spans(t or "", shared.value, base[-1]))
            n = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("i"),
                    *(pa.array(x, pa.int64()) for x in n),
                    pa.array([_joined(b) for b in base]),
                    pa.array([_joined(e) for e in every]),
                ],
                names=[doc, "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    return own.mapInArrow(run, f"`{doc}` {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def with_digest(scanned: DataFrame) -> DataFrame:
    """``scanned`` with base_sha256, the lowercase hex digest of its base spans, in place of them."""
    return scanned.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
