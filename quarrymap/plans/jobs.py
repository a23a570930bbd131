"""Analysis runs over many archives: stages as event rows, failures as rows of their own analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.config import Config
from quarrymap.operators import status
from quarrymap.operators.store import append_rows, save_partitioned
from quarrymap.plans.analysis import analyze
from quarrymap.sources.repositories import archive_members, checked_members, member_failures, scan_failures


def written(events: DataFrame, target: str) -> None:
    append_rows(events.select("analysis_id", "status", "stage", F.col("progress").cast("int").alias("progress"), "error_code", "error_message", F.current_timestamp().alias("at"), F.col("seq").cast("int").alias("seq")), f"{target}/events")


def reached(ids: DataFrame, stage: str) -> DataFrame:
    """One `processing` (or, at the last stage, `completed`) event of each analysis."""
    seq, progress = next((i, p) for i, (s, p) in enumerate(status.STAGES) if s == stage)
    none = F.lit(None).cast("string")
    return ids.select("analysis_id", F.lit("completed" if stage == "complete" else "processing").alias("status"), F.lit(stage).alias("stage"), F.lit(progress).alias("progress"), none.alias("error_code"), none.alias("error_message"), F.lit(seq).alias("seq"))


def failed(failures: DataFrame, stage: str) -> DataFrame:
    seq, progress = next((i, p) for i, (s, p) in enumerate(status.STAGES) if s == stage)
    return failures.select("analysis_id", F.lit("failed").alias("status"), F.lit(stage).alias("stage"), F.lit(progress).alias("progress"), "error_code", "error_message", F.lit(seq).alias("seq"))


def run_archives(archives: DataFrame, target: str, config: Config = Config()) -> None:
    """Analyse archives (analysis_id, file_name, data) and write events, files, edges, chunks, statistics and warnings under `target`.

    A bad archive, or one with too many files, fails its own analysis with an event row; the others go on.
    What fails the job itself is recorded for every analysis that is still at work, and raised.
    """
    spark = archives.sparkSession
    alive = archives.select("analysis_id").distinct()
    try:
        written(reached(alive, "fetching_repository"), target)
        written(reached(alive, "downloading_source"), target)
        members = archive_members(archives, config)
        members.write.mode("overwrite").parquet(f"{target}/members")
        members = spark.read.schema(members.schema).parquet(f"{target}/members")
        bad = member_failures(members, config)
        written(failed(bad, "downloading_source"), target)
        alive = alive.join(bad, "analysis_id", "left_anti")
        raw = checked_members(members, config, drop=True)
        written(reached(alive, "scanning_files"), target)
        large = scan_failures(raw, config)
        written(failed(large, "scanning_files"), target)
        alive = alive.join(large, "analysis_id", "left_anti")
        bundle = analyze(raw.join(large, "analysis_id", "left_anti"), config)
        for stage, tables in (("parsing_python", ("files",)), ("building_graph", ("edges",)), ("creating_index", ("chunks",)), ("generating_overview", ("statistics", "warnings"))):
            written(reached(alive, stage), target)
            for name in tables:
                save_partitioned(getattr(bundle, name), f"{target}/{name}")
        written(reached(alive, "complete"), target)
    except Exception:
        last = spark.read.schema(status.EVENT).parquet(f"{target}/events").join(alive, "analysis_id", "left_semi")
        stuck = status.with_status(alive, last).filter("status = 'processing'")
        written(stuck.select("analysis_id", F.lit("failed").alias("status"), "stage", "progress", F.lit(status.UNEXPECTED).alias("error_code"), F.lit(status.UNEXPECTED_MESSAGE).alias("error_message"), F.lit(len(status.STAGES)).alias("seq")), target)
        raise
