"""Mixing of sources to target weights by hierarchical budgets.

A token budget flows down a tree of sources, given as path columns (domain, language, source). A node's children share
its budget by their weights; a child that holds less than its share gives all it has, and the rest goes to its siblings
first. A subtree that is short as a whole takes no more than it holds, so only then does its shortage reach the siblings
of its ancestors. What a leaf holds is its tokens times ``max_epochs``.

A leaf's budget is spent as whole epochs and a token-prefix of one more. Each epoch has its own seeded order, by
md5(seed:epoch:id); the prefix takes documents until their tokens reach the budget. Tokens are summed by the first four
digits of the order key, which settles all documents but those of one bucket per leaf; only that bucket is sorted. No
leaf, however large, is a task's alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, checkpointed, small

#: Leading hexadecimal digits of the order key: 65,536 buckets a leaf.
DIGITS = 4


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def share_out(children: DataFrame, parent: list[str], own: str) -> DataFrame:
    """``alloc`` of each child: columns parent..., own, cap, weight and budget (its parent's).

    Children fill up in the order of cap / weight; those whose capacity is below their fair share of what is left get
    it all, and the others split the rest by weight, rounded down. Integers throughout.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), own)
    full, after = Window.partitionBy(*parent), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)))
    rows = rows.withColumns({"b": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w": F.sum("weight").over(after)})
    rows = rows.withColumn("full", F.col("cap") * F.col("w") <= (F.col("budget") - F.col("b")) * F.col("weight"))
    rows = rows.withColumns(
        {
            "taken": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(full),
            "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(full),
        }
    )
    part = F.expr("(budget - taken) * weight div open")
    return rows.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("b", "w", "full", "taken", "open")


def leaf_budgets(leaves: DataFrame, levels: list[tuple[str, str]], budget: str, max_epochs: int) -> DataFrame:
    """``leaves`` (the path columns, tokens) with alloc, the leaf's token budget."""
    names = [name for name, _ in levels]
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    whole = leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    above = whole.select(F.least(F.col("cap"), F.expr(budget)).cast("long").alias("budget"))
    for depth, (name, weight) in enumerate(levels, 1):
        path = names[:depth]
        level = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", F.expr(weight).cast("long"))
        level = level.join(above, path[:-1]) if path[:-1] else level.crossJoin(F.broadcast(above))  # one row
        above = share_out(level, path[:-1] or [F.lit(0)], name).select(*path, F.col("alloc").alias("budget"))
        above = checkpointed(above)
    return leaves.drop("cap").join(above.withColumnRenamed("budget", "alloc"), names)


def mix(
    df: DataFrame,
    levels: list[tuple[str, str, str]],
    budget: str,
    max_epochs: int = 1,
    seed: int = 0,
    text: str = "text",
    doc: str = "doc_id",
) -> DataFrame:
    """The rows of ``df`` that the mix takes, once for each epoch, with m_epoch, m_tokens and the path as m_<level>.

    levels: name, path (null: "none") and integer weight over the columns m_<level>, from the root down, in SQL.
    budget: tokens in SQL, which may name ``tokens``, those of the whole table. Null and empty texts hold no tokens:
    they go with their order's prefix, at no cost. Repeated rows count each; an empty table gives an empty mix.
    """
    names = [f"m_{name}" for name, _, _ in levels]
    own = df.withColumns({n: F.coalesce(F.expr(path).cast("string"), F.lit("none")) for n, (_, path, _) in zip(names, levels, strict=True)})
    own = own.withColumn("m_tokens", token_count(text))
    leaves = checkpointed(own.groupBy(*names).agg(F.sum("m_tokens").alias("tokens")))
    budgets = leaf_budgets(leaves, [(n, w) for n, (_, _, w) in zip(names, levels, strict=True)], budget, max_epochs)
    budgets = budgets.withColumn("m_full", F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(0).cast("int"))
    budgets = budgets.withColumn("m_rest", F.col("alloc") - F.col("m_full") * F.col("tokens"))
    budgets = checkpointed(budgets.select(*names, "m_full", "m_rest"))

    key = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc).cast("string"), F.lit("none"))))
    placed = own.join(small(budgets), names).withColumn("m_key", key(F.col("m_full")))
    placed = placed.withColumn("m_bucket", F.substring("m_key", 1, DIGITS))
    sums = placed.filter("m_rest > 0").groupBy(*names, "m_rest", "m_bucket").agg(F.sum("m_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("m_before", before).filter("m_before < m_rest and m_before + n >= m_rest")
    edge = checkpointed(edge.select(*names, F.col("m_bucket").alias("m_edge"), "m_before"))

    columns = [*df.columns, *names, "m_tokens"]
    whole = placed.filter("m_full > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("m_full") - 1)).alias("m_epoch"))
    rest = placed.filter("m_rest > 0").join(small(edge), names).filter("m_bucket <= m_edge")
    sure = rest.filter("m_bucket < m_edge")
    at_edge = rest.filter("m_bucket = m_edge")
    order = Window.partitionBy(*names).orderBy("m_key", doc, "m_tokens").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("m_before") + F.coalesce(F.sum("m_tokens").over(order), F.lit(0))
    at_edge = at_edge.withColumn("m_spent", spent).filter("m_spent < m_rest")
    epoch = F.col("m_full").alias("m_epoch")
    return whole.unionAll(sure.select(*columns, epoch)).unionAll(at_edge.select(*columns, epoch))
