"""Audit of filters that are applied one after another, in every order, by aggregated edges of the lattice of subsets.

A document's result under any order depends only on the set of filters that it fails. So documents are counted once by
part and failed set; each count goes to the k * 2^(k-1) edges (filters already applied, next filter), 80 for five; and
the k! * k steps of all orders, 600 for five, are paths that look up the edge they take.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed

#: Failure conditions over ``text`` (never null), ``words`` (its words and, where blanks meet, empty strings) in order.
RULES = {
    "A": "size(array_remove(words, '')) < 50",
    "B": "100 * size(array_remove(array_distinct(words), '')) < 65 * size(array_remove(words, ''))",
    "C": "100 * length(regexp_replace(text, '[^A-Z]+', '')) > 5 * length(text)",
    "D": "contains(text, '#') or contains(text, '$') or contains(text, '%') or contains(text, '&') or contains(text, '*') or contains(text, '|')",
}
#: Rows without an id meet no label, and are dealt to so many keys.
SALT = 64


def failed_sets(docs: DataFrame, labels: DataFrame, rules: dict[str, str], copies: str | None, text: str = "text", doc: str = "doc_id", source: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, bit by bit in order.

    ``copies`` names a last filter, failed by a text that a row with a smaller id has too, anywhere in the table. Texts
    are compared by SHA-256. A null text counts as empty, a null source as the empty part. A row without an id is no
    copy, and none has it as its original; rows repeated with one id are no copies of each other and count each.
    good, toxic: those whose id some row of ``labels`` (doc_id, quality, toxic) marks with 1.

    Texts are read once and don't move. Digests are counted before they meet labels or each other, and originals are
    found by (digest, id), so a large group of copies is never one key's work.
    """
    whole = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(source), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = whole.withColumn("words", F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "))
    mask = sum((F.expr(f"if({rule}, {1 << k}, 0)") for k, rule in enumerate(rules.values())), F.lit(0))
    rows = cut.select("doc", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    salt = F.when(F.col("doc").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALT))).otherwise(0)
    rows = rows.groupBy("doc", "digest", "part", "mask").agg(F.count("*").alias("n")).withColumn("salt", salt)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(
        F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic")
    ).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(marks, ["doc", "salt"], "left").select("doc", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    counted = lambda df, mask, sign: df.groupBy("part", mask.alias("mask")).agg(*[
        F.sum(F.col("n") * F.col(c) * sign if c else F.col("n") * sign).alias(c or "n") for c in ("", "good", "toxic")
    ])
    if copies is None:
        return counted(rows, F.col("mask"), 1)
    rows, bit = checkpointed(rows), 1 << len(rules)
    least = rows.groupBy("digest").agg(F.min("doc").alias("doc"))
    first = rows.join(least, ["digest", "doc"]).unionByName(rows.filter("doc is null"))
    first = checkpointed(counted(first, F.col("mask"), 1))  # one row for each part and set
    late = counted(rows, F.col("mask") + bit, 1).unionByName(first.select("part", (F.col("mask") + bit).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")]))
    return first.unionByName(late).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).filter("n > 0")


def lattice_edges(sets: DataFrame, filters: int) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every edge.

    applied: bits of the filters before; filter: number of the next one. shapley: what the filter removes, summed over
    all orders, which is its edges' removals by the number of orders that pass them.
    """
    edges = [(s, f) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for s, f in edges]))
    met = sets.select("*", each.alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    here, earlier = "mask & bit != 0", "mask & applied != 0"
    some = lambda rule, n: F.sum(F.expr(f"if({rule}, {n}, 0)"))
    found = met.groupBy("part", "applied", "filter").agg(
        some("mask & (applied | bit) = 0", "n").alias("kept"),
        some(f"{here} and not ({earlier})", "n").alias("removed"),
        some(f"{here} and {earlier}", "n").alias("redundant"),
        some("mask = bit", "n").alias("unique_fails"),
        some(f"{here} and not ({earlier})", "good").alias("good_lost"),
        some(f"{here} and not ({earlier})", "toxic").alias("toxic_lost"),
    )
    passed = F.element_at(F.array(*[F.lit(factorial(k) * factorial(filters - 1 - k)) for k in range(filters)]), F.bit_count("applied").cast("int") + 1)
    share = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * passed).alias("shapley"))
    return found.join(share, ["part", "filter"])


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, copies: str | None = "E", text: str = "text", doc: str = "doc_id", source: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), all counts.

    One row for each part, each order of the filters and each step of it, zeros included; an empty table gives none.
    Null texts, sources and ids, and repeated rows: see failed_sets(). Other columns are not looked at.
    """
    names = [*rules, *([copies] if copies else [])]
    edges = lattice_edges(failed_sets(docs, labels, rules, copies, text, doc, source), len(names))
    steps = [
        ("".join(order), k + 1, sum(1 << names.index(x) for x in order[:k]), names.index(order[k])) for order in permutations(names) for k in range(len(names))
    ]  # 600 for five filters, whatever the table
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    return edges.join(F.broadcast(steps), ["applied", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
