"""Written steps and two-level row numbers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


FEW = 10_000  # rows of offsets that are broadcast


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a folder of our own only where it is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quarrymap-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: `df` as a fresh table in the shared folder, so that what reads it twice reads the same rows."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], partition: list[str] | None = None, name: str = "position") -> DataFrame:
    """`df` with row numbers from 1 within `partition`, by `order`; ties are numbered in any one order.

    Rows are dealt by ranges of (partition, order) and sorted within them, so that a range's rows are numbered
    where they are; the ranges' counts (one row per range and partition value) are summed up and added. No
    task holds a whole partition, however large.
    """
    partition = partition or []
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*(F.asc(p) for p in partition), *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # range << 33 | row of the range
    dealt = written(dealt.withColumns({"__range": F.shiftright(at, 33), "__row": at.bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = dealt.groupBy(*partition, "__range").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = counts.select(*partition, "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    if counts.count() <= FEW:  # so that the rows themselves are not shuffled again
        offsets = F.broadcast(offsets)
    return dealt.join(offsets, [*partition, "__range"]).withColumn(name, F.col("__row") + F.col("__add")).drop("__range", "__row", "__add")
