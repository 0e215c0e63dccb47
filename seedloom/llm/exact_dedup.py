"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass one marks cells: every text sets two of m cells, chosen by two hashes, and a cell set by two rows or more is a
*repeated* cell. The repeated cells are packed into 4 KB bitmaps. Pass two tests each text's two cells: a text with a
cell that is not repeated occurs once and passes straight through; only the others are shuffled, as narrow digests,
and decided exactly. A filter's false alarm costs a shuffled digest and never a wrong answer.

m is the power of two from 32 times the row count, at most 2**MAX_BITS, so the bitmaps that are broadcast hold 64 MB
at most; with more than 16 million rows the filter fills up and more digests are shuffled, while texts never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import checkpointed

#: Bits of the largest filter: 2**29 bits are 64 MB.
MAX_BITS = 29
#: A group with more than this share of the rows is hot; there are 1 / HOT_SHARE such groups at most.
HOT_SHARE = 0.001


def _cells(digest: Column, bits: int) -> list[Column]:
    """The two filter cells of a text, from 1 to 2**bits."""
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(1 << bits)) + 1 for k in (1, 2)]


def _bit(bitmap: Column, cell: Column) -> Column:
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(15, (32 * rows - 1).bit_length()))


def repeated_cells(rows: DataFrame, cells: list[str]) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the cells that two rows or more have set."""
    each = rows.select(F.explode(F.array_distinct(F.array(*cells))).alias("cell"))
    twice = each.groupBy("cell").count().filter("count > 1")
    return twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap")
    )


def annotate(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays (null is the smallest
    id); of repeated rows with that id too, one. Other columns of ``df`` are ignored, an empty table gives no rows.
    """
    narrow = checkpointed(
        df.select(F.col(doc).alias("__id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__sha")).select(
            "__id", F.unhex("__sha").alias("__sha"), F.monotonically_increasing_id().alias("__row")
        )
    )
    rows = narrow.count()
    first, second = _cells(F.col("__sha"), filter_bits(rows))
    celled = narrow.withColumns({"__c1": first, "__c2": second})
    bitmaps = checkpointed(repeated_cells(celled, ["__c1", "__c2"]))
    tested = celled
    for k in ("1", "2"):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__b{k}"), F.col("bitmap").alias(f"__m{k}")))
        cell = F.col(f"__c{k}")
        tested = tested.join(side, F.bitmap_bucket_number(cell) == F.col(f"__b{k}"), "left")
        tested = tested.withColumn(f"__t{k}", F.coalesce(_bit(F.col(f"__m{k}"), cell), F.lit(False))).drop(f"__b{k}", f"__m{k}")
    tested = tested.select("__id", "__sha", "__row", (F.col("__t1") & F.col("__t2")).alias("__maybe"))
    alone = tested.filter("not __maybe").withColumns(
        {"__keep": F.struct("__id", "__row"), "__size": F.lit(1).cast("long")}
    )
    maybe = tested.filter("__maybe")
    groups = maybe.groupBy("__sha").agg(
        F.max(F.struct("__id", "__row")).alias("__keep"), F.count("*").alias("__size")
    )
    groups = checkpointed(groups)
    cut = max(1, int(rows * HOT_SHARE))
    hot = groups.filter(F.col("__size") > cut)  # under 1 / HOT_SHARE rows
    decided = maybe.join(F.broadcast(hot), "__sha", "left")
    rest = decided.filter("__size is null").drop("__keep", "__size").join(groups.filter(F.col("__size") <= cut), "__sha")
    out = ["__id", "__sha", "__row", "__keep", "__size"]
    both = alone.select(out).unionAll(decided.filter("__size is not null").select(out)).unionAll(rest.select(out))
    return both.select(
        F.col("__id").alias(doc),
        F.col("__keep.__id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__row") == F.col("__keep.__row")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def keep(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    A text that the filter calls single keeps its row in place. The keepers of the others are found on digests, and the
    rows with a possibly repeated text meet them by digest; repeated rows with the keeper's id give one row.
    """
    held = [c for c in df.columns]
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    narrow = checkpointed(df.select(F.col(doc).alias("__id"), digest.alias("__sha")))
    rows = narrow.count()
    bits = filter_bits(rows)
    first, second = _cells(F.col("__sha"), bits)
    bitmaps = checkpointed(repeated_cells(narrow.select(first.alias("c1"), second.alias("c2")), ["c1", "c2"]))

    def tested(wide: DataFrame) -> DataFrame:
        for k, cell in zip(("1", "2"), _cells(F.col("__sha"), bits), strict=True):
            side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"__b{k}"), F.col("bitmap").alias(f"__m{k}")))
            wide = wide.join(side, F.bitmap_bucket_number(cell) == F.col(f"__b{k}"), "left")
            wide = wide.withColumn(f"__t{k}", F.coalesce(_bit(F.col(f"__m{k}"), cell), F.lit(False)))
        return wide

    single = F.col("__t1") & F.col("__t2")
    keepers = (
        tested(narrow).filter(single).groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count("*").alias("__size"))
    )
    keepers = checkpointed(keepers)
    cut = max(1, int(rows * HOT_SHARE))
    wide = tested(df.withColumn("__sha", digest))
    maybe = wide.filter(single).select(*held, "__sha")
    hot = F.broadcast(keepers.filter(F.col("__size") > cut))
    sure = maybe.join(hot, "__sha", "left")
    of_hot = sure.filter(F.col("__size").isNotNull() & F.col("__keep").eqNullSafe(F.col(doc)))
    of_rest = sure.filter("__size is null").drop("__keep", "__size")
    of_rest = of_rest.join(keepers.filter(F.col("__size") <= cut), "__sha").filter(F.col("__keep").eqNullSafe(F.col(doc)))
    kept = of_hot.select(*held, "__sha").unionAll(of_rest.select(*held, "__sha"))
    return wide.filter(~single).select(held).unionAll(kept.dropDuplicates(["__sha"]).select(held))
