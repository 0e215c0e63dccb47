"""A one-hash Bloom filter as a table of 4 KB bitmaps, of bounded size, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import _bit, filter_bits
from .util import checkpointed


class BitmapFilter:
    """Of the values of one column; 64 MB at most. ``maybe`` has no false negatives, nulls included."""

    def __init__(self, values: DataFrame):
        (name,) = values.columns
        self.bits = filter_bits(values.count())
        cell = self._cell(F.col(name))
        self.bitmaps = values.groupBy(F.bitmap_bucket_number(cell).alias("__bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("__bitmap")
        )

    def _cell(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(1 << self.bits)) + 1

    def marked(self, df: DataFrame, column: str, as_name: str) -> DataFrame:
        """``df`` with a boolean ``as_name``: whether the value may be among the filter's."""
        cell = self._cell(F.col(column))
        hit = df.join(F.broadcast(self.bitmaps), F.bitmap_bucket_number(cell) == F.col("__bucket"), "left")
        hit = hit.withColumn(as_name, F.coalesce(_bit(F.col("__bitmap"), cell), F.lit(False)))
        return hit.drop("__bucket", "__bitmap")


#: Buckets of 32,768 ids in an exact set that is broadcast, at most: 64 MB. FEW of them always will do: 4 MB.
EXACT_BUCKETS, FEW = 1 << 14, 1 << 10


def split_by_id(df: DataFrame, doc: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose id is among ``ids`` (one column), and the others, those without an id included.

    Whole-number ids in up to EXACT_BUCKETS ranges are an exact bitmap, and no row is shuffled. Others, more, or ids so
    far apart that their bitmap is over four times a filter's, pass a filter first, and only rows whose id may be among
    them are shuffled.
    """
    (name,) = ids.columns
    ids = checkpointed(ids.select(F.col(name).alias("__id")).filter("__id is not null").distinct())
    if ids.schema["__id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        bucket, place = F.bitmap_bucket_number(F.col("__id")), F.bitmap_bit_position(F.col("__id"))
        sets = checkpointed(ids.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(place).alias("__bitmap")))
        if sets.count() <= max(FEW, min(EXACT_BUCKETS, 4 << (filter_bits(ids.count()) - 15))):
            met = df.join(F.broadcast(sets), F.bitmap_bucket_number(F.col(doc).cast("long")) == F.col("__bucket"), "left")
            inside = F.coalesce(_bit(F.col("__bitmap"), F.col(doc).cast("long")), F.lit(False))
            return met.filter(inside).select(df.columns), met.filter(~inside).select(df.columns)
    marked = BitmapFilter(ids).marked(df, doc, "__maybe")
    sure, maybe = marked.filter("not __maybe").select(df.columns), marked.filter("__maybe").select(df.columns)
    on = maybe[doc] == ids["__id"]
    return maybe.join(ids, on, "left_semi"), sure.unionAll(maybe.join(ids, on, "left_anti"))


def without(df: DataFrame, doc: str, dropped: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is not among ``dropped`` (one column); rows without an id stay."""
    return split_by_id(df, doc, dropped)[1]
