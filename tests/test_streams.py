"""Run states in any order of arrival, and the bucketed cache of analyses."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quarrymap.operators import catalog
from quarrymap.streaming.run_states import write_run_ends

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "analysis_id string, seq int, status string, at timestamp, id long"


def event(run, seq, status, minutes, n):
    return run, seq, status, START + timedelta(minutes=minutes), n


EVENTS = [
    event("good", 0, "processing", 0, 1), event("good", 2, "processing", 10, 2), event("good", 1, "processing", 20, 3), event("good", 7, "completed", 30, 4), event("good", 8, "failed", 31, 5),
    event("bad", 0, "processing", 5, 6), event("bad", 3, "failed", 6, 7), event("bad", 7, "completed", 9, 8),
    event("stuck", 0, "processing", 0, 9), event("stuck", 1, "processing", 2, 10), event("stuck", 7, "completed", 63, 11),
    event("tie", 4, "processing", 8, 12), event("tie", 4, "processing", 8, 13), event("tie", 5, "completed", 68, 14),
    event(None, 1, "completed", 3, 15),
]
WANT = [("bad", "failed", 3, 6, 0, False), ("good", "completed", 7, 30, 1, False), ("stuck", "failed", 1, 2, 0, True), ("tie", "completed", 5, 68, 1, False)]


def ends(spark, folder, batches):
    for rows in [*batches, [event(None, None, None, 10_000, None)]]:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        write_run_ends(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/progress", "90 minutes", 3_600_000).awaitTermination()
    found = spark.read.parquet(f"{folder}/out").withColumn("minutes", ((F.unix_micros("at") - int(START.timestamp()) * 10**6) / 60_000_000).cast("int"))
    return sorted(tuple(r) for r in found.select("analysis_id", "status", "seq", "minutes", "refused", "stuck").collect())


def test_ends_of_runs_in_any_order(spark, tmp_path):
    assert ends(spark, f"{tmp_path}/once", [EVENTS]) == WANT
    mixed = EVENTS[:]
    random.Random(1).shuffle(mixed)
    assert ends(spark, f"{tmp_path}/mixed", [mixed[:5], mixed[5:9], mixed[9:]]) == WANT
    assert ends(spark, f"{tmp_path}/back", [EVENTS[8:], EVENTS[:8], EVENTS[:1]])[1] == ("good", "completed", 7, 30, 2, False)


def test_nothing_arrives(spark, tmp_path):
    assert ends(spark, str(tmp_path), [[]]) == []


def test_bucketed_lookup_shuffles_requests_only(spark, tmp_path):
    done = spark.range(2000).select(F.col("id").alias("repository_id"), F.hex("id").alias("commit_sha"), (F.col("id") % 7).alias("analyzer_version"), F.when(F.col("id") % 3 == 0, "failed").otherwise("completed").alias("status"))
    catalog.save_analyses(done, "cache_of_tests", str(tmp_path / "cache"))
    wanted = spark.range(1990, 2010).select(F.col("id").alias("repository_id"), F.hex("id").alias("commit_sha"), (F.col("id") % 7).alias("analyzer_version"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = catalog.cache_misses_of(wanted, "cache_of_tests")
        got = sorted(r.repository_id for r in missing.collect())
        plan = missing._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE cache_of_tests")
    assert got == [1992, 1995, 1998, *range(2000, 2010)]
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final
