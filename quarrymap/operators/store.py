"""Persistence as Parquet: partitioned by analysis, overwritten per partition, logs appended."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_partitioned(df: DataFrame, path: str) -> None:
    """Replace the partitions of the analyses in `df`; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def with_file_ids(rows: DataFrame, files: DataFrame, *path_columns: str) -> DataFrame:
    """Rows with <name>_id for every <name>_path column (file_id for path); rows of unknown files are dropped."""
    for column in path_columns:
        name = "file_id" if column == "path" else column.removesuffix("_path") + "_file_id"
        ids = files.select("analysis_id", F.col("path").alias(column), F.col("file_id").alias(name))
        rows = rows.join(ids, ["analysis_id", column])
    return rows


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of every key: an upsert over appended versions."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def upsert(rows: DataFrame, path: str, key: list[str], order: list[str], buckets: int = 64) -> int:
    """Put the last version of every key of `rows` into the table under `path`; returns the table's new version.

    Keys are dealt by hash over `buckets` folders. A batch rewrites only the buckets that it touches, into folders of
    the new version, and then appends the version's list of folders (a row a bucket) as one file: readers see the
    old list or the new one, and a batch that fails, or whose tasks are retried, leaves the old one. Rows of
    untouched buckets stay in the files they were in. Of versions that are equal in `order` either may stay.
    """
    spark = rows.sparkSession
    mine = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    listed = bucket_list(spark, path)
    old = {r["bucket"]: r for r in listed.collect()} if listed is not None else {}  # a row a bucket
    version = 1 + max((r["version"] for r in old.values()), default=0)
    touched = {r["bucket"] for r in mine.select("bucket").distinct().collect()}
    kept = [r["folder"] for b, r in old.items() if b in touched]
    both = mine if not kept else mine.unionByName(spark.read.schema(mine.schema).option("basePath", path).parquet(*(f"{path}/{f}" for f in kept)).select(*mine.columns))
    rest = [c for c in mine.columns if c not in [*key, "bucket"]]
    newest = both.groupBy("bucket", *key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select("bucket", *key, "row.*").select(*mine.columns)
    target = f"data/version={version}-{uuid.uuid4().hex}"
    newest.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{path}/{target}")
    folders = [(version, b, f"{target}/bucket={b}") if b in touched else (version, b, old[b]["folder"]) for b in sorted(touched | old.keys())]
    if folders:
        spark.createDataFrame(folders, "version int, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def bucket_list(spark: SparkSession, path: str) -> DataFrame | None:
    """(version, bucket, folder) of the newest version; None before the first."""
    try:
        versions = spark.read.schema("version int, bucket int, folder string").parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return versions.join(versions.agg(F.max("version").alias("version")), "version")


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that `upsert` keeps, as of its newest version."""
    listed = bucket_list(spark, path)
    if listed is None:
        raise ValueError(f"No upserted table: {path}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/{r['folder']}" for r in listed.collect())).drop("bucket", "version")


def current_status(events: DataFrame) -> DataFrame:
    """The last status event (analysis_id, status, stage, progress, at, seq) of every analysis."""
    return events.groupBy("analysis_id").agg(F.max_by(F.struct("status", "stage", "progress", "at"), F.struct("at", "seq")).alias("e")).select("analysis_id", "e.*")


def running_cap(rows: DataFrame, partition: list[str], order: list, size: str, max_rows: int, max_size: int) -> DataFrame:
    """Rows with running count and size, and whether both still hold their caps."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({"running_rows": F.count("*").over(so_far), "running_size": F.sum(size).over(so_far)})
    return counted.withColumn("within", (F.col("running_rows") <= max_rows) & (F.col("running_size") <= max_size))


def fill_embeddings(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32, chars: int = 6_000) -> DataFrame:
    """Embeddings of chunks that have none; `embed` runs on the workers, `batch` texts a call."""
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in chunks.columns}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, made = list(frame["__text"]), []
            for k in range(0, len(texts), batch):
                vectors = embed(texts[k : k + batch])
                if len(vectors) != len(texts[k : k + batch]):
                    raise ValueError("the embedding function must return a vector for every text")
                made += [[float(x) for x in v] for v in vectors]
            frame["embedding"] = made
            yield frame[list(kinds)]

    todo = chunks.filter("embedding IS NULL").withColumn("__text", F.substring("search_text", 1, chars))
    filled = todo.mapInPandas(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    return chunks.filter("embedding IS NOT NULL").unionByName(filled)
