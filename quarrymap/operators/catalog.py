"""Views of an analysed repository: file lists, file details and the cache of finished analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.operators.staging import numbered

# Sortable columns by their public names.
SORTS = {"importance": "importance_score", "path": "path", "lines": "line_count", "complexity": "estimated_complexity", "incoming": "incoming_count", "outgoing": "outgoing_count", "category": "category"}

CACHE_KEY = ["repository_id", "commit_sha", "analyzer_version"]
CACHE_BUCKETS = 64


def filter_files(files: DataFrame, search: str | None = None, category: str | None = None, entry_points: bool | None = None, tests: bool | None = None, parse_status: str | None = None) -> DataFrame:
    """`search` is a case-insensitive LIKE pattern between wildcards; `entry_points=False` doesn't filter, `tests=False` does."""
    if search:
        files = files.filter(F.col("path").ilike(f"%{search}%"))
    if category:
        files = files.filter(F.col("category") == category)
    if entry_points:
        files = files.filter("is_entry_point")
    if tests is not None:
        files = files.filter(F.col("is_test") == tests)
    if parse_status:
        files = files.filter(F.col("parse_status") == parse_status)
    return files


def sort_columns(sort: str = "importance", order: str = "desc") -> list[Column]:
    """Any order but "asc" falls; unknown sorts are by importance; ties go by path."""
    column = SORTS.get(sort, "importance_score")
    return [F.asc(column) if order == "asc" else F.desc(column), F.asc("path")]


def file_page(files: DataFrame, page: int = 1, size: int = 50, sort: str = "importance", order: str = "desc") -> DataFrame:
    """A page (from 1) of every analysis's files, with its row number and the count of all."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page counts from 1, and a page has 1 to 500 files")
    column = SORTS.get(sort, "importance_score")
    slim = files.select("analysis_id", *dict.fromkeys(["path", column]))
    # Keys alone are dealt by ranges and numbered where they are; only the page's rows meet the files again.
    rows = numbered(slim, sort_columns(sort, order), ["analysis_id"]).filter((F.col("position") <= page * size) & (F.col("position") > (page - 1) * size))
    rows = files.join(rows.select("analysis_id", "path", "position"), ["analysis_id", "path"])
    return rows.join(files.groupBy("analysis_id").agg(F.count("*").alias("total")), "analysis_id")


def count_files(files: DataFrame) -> DataFrame:
    return files.groupBy("analysis_id").agg(F.count("*").alias("files"))


def flags() -> Column:
    return F.array_compact(F.array(F.when(F.col("is_entry_point"), "entry point"), F.when(F.col("is_test"), "test"), F.when(F.col("parse_status") != "ok", "parse warning")))


def file_neighbours(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(analysis_id, path, dependencies, importers): one entry per edge row, sorted."""
    files = selected.select("analysis_id", "path").distinct()
    key = ["analysis_id", "path"]
    listed = lambda here, there, name: edges.select("analysis_id", F.col(here).alias("path"), F.col(there).alias("other")).join(files, key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("other")).alias(name))
    joined = files.join(listed("source_path", "target_path", "dependencies"), key, "left").join(listed("target_path", "source_path", "importers"), key, "left")
    none = F.array().cast("array<string>")
    return joined.select(*key, F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("importers", none).alias("importers"))


def cache_misses(requested: DataFrame, analyses: DataFrame, force: bool = False) -> DataFrame:
    """Requests (repository_id, commit_sha, analyzer_version) without a completed analysis; all if forced."""
    return requested if force else requested.join(analyses.filter("status = 'completed'").select(*CACHE_KEY), CACHE_KEY, "left_anti")


def save_analyses(analyses: DataFrame, name: str, path: str, buckets: int = CACHE_BUCKETS) -> None:
    """Write analyses as the table `name` under `path`, dealt over `buckets` by what a request asks for."""
    dealt = analyses.repartition(buckets, *CACHE_KEY)  # so that a bucket is one file
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *CACHE_KEY).sortBy(*CACHE_KEY).saveAsTable(name)


def cache_misses_of(requested: DataFrame, name: str, buckets: int = CACHE_BUCKETS) -> DataFrame:
    """`cache_misses` against a table of `save_analyses`: requests go to its buckets, the table stays where it is."""
    return cache_misses(requested.repartition(buckets, *CACHE_KEY), requested.sparkSession.table(name))


def next_attempts(requested: DataFrame, analyses: DataFrame) -> DataFrame:
    """Requests with the number of their next attempt, so that a forced rerun is a new row."""
    tried = analyses.groupBy(*CACHE_KEY).agg(F.max("attempt").alias("tried"))
    return requested.join(tried, CACHE_KEY, "left").withColumn("attempt", F.coalesce("tried", F.lit(0)) + 1).drop("tried")
