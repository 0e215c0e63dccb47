"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may go without it (tests); elsewhere that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="seedloom-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


#: Has Spark remove the files of a query's shuffles when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back from there: it is computed once, and survives lost executors.

    What was shuffled for it is removed when it is written, so that steps one after another don't add up on disk.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/seedloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
