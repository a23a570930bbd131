"""Summaries of analysed files; all are per analysis_id, none is a global limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories that a reader should see early, and the starter questions.
EARLY = ["API / Routes", "Services", "Core / Domain", "Configuration"]
ENTRY_WHY = "Detected entry point — a natural place to begin."
QUESTIONS = ["Where does the application start?", "How are the main components organized?", "Which files should I read first?"]
CATEGORY_QUESTIONS = {
    "API / Routes": "Where are API routes defined?",
    "Models / Data": "Where is data access or model logic implemented?",
    "Configuration": "Where is configuration loaded?",
}


def ranked(files: DataFrame, name: str = "rank", *before: Column) -> DataFrame:
    order = Window.partitionBy("analysis_id").orderBy(*before, F.desc("importance_score"), "path")
    return files.withColumn(name, F.row_number().over(order))


def important_files(files: DataFrame, n: int = 12) -> DataFrame:
    return ranked(files.filter(~F.col("is_test"))).filter(F.col("rank") <= n)


def start_here(files: DataFrame, n: int = 8) -> DataFrame:
    """Reading order: entry points, then early categories, then the rest, each by importance."""
    tier = F.when(F.col("is_entry_point"), 0).when(F.col("category").isin(EARLY), 1).otherwise(2)
    kept = ranked(files.filter(~F.col("is_test")), "rank", tier).filter(F.col("rank") <= n)
    return kept.withColumn("why", F.when(F.col("is_entry_point"), ENTRY_WHY).otherwise(F.col("importance_reason")))


def category_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("analysis_id", "category").agg(F.count("*").alias("files"))


def statistics(files: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts per analysis."""
    own = files.groupBy("analysis_id").agg(
        F.count("*").alias("python_file_count"),
        F.sum("line_count").cast("long").alias("lines_of_python"),
        F.count_if("is_entry_point").alias("entry_point_count"),
        F.count_if("is_test").alias("test_file_count"),
        F.count_if(F.col("parse_status") != "ok").alias("parse_warning_count"),
    )
    n_edges = edges.groupBy("analysis_id").agg(F.count("*").alias("internal_dependency_edges"))
    n_chunks = chunks.groupBy("analysis_id").agg(F.count("*").alias("chunk_count"))
    joined = own.join(n_edges, "analysis_id", "left").join(n_chunks, "analysis_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("internal_dependency_edges", "chunk_count")})


def starter_questions(categories: Column) -> Column:
    """Four questions at most, of an array of the categories present."""
    extra = [F.when(F.array_contains(categories, c), q) for c, q in CATEGORY_QUESTIONS.items()]
    return F.slice(F.array_compact(F.array(*map(F.lit, QUESTIONS), *extra)), 1, 4)


def structural_facts(statistics_row: DataFrame, files: DataFrame) -> DataFrame:
    """(analysis_id, facts): formatted counts, entry points and the eight most important files."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", "), F.lit("]"))
    order = F.struct((-F.col("importance_score")).alias("down"), "path")
    gather = lambda df, name: df.groupBy("analysis_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.path).alias(name))
    entries = gather(files.filter("is_entry_point"), "entries")
    tops = gather(important_files(files, 8), "tops")
    none = F.array().cast("array<string>")
    joined = statistics_row.join(entries, "analysis_id", "left").join(tops, "analysis_id", "left")
    facts = F.array(
        F.format_string("Python files: %d", "python_file_count"),
        F.format_string("Internal edges: %d", "internal_dependency_edges"),
        F.concat(F.lit("Entry points: "), listed(F.coalesce("entries", none))),
        F.concat(F.lit("Important files: "), listed(F.coalesce("tops", none))),
    )
    return joined.select("analysis_id", facts.alias("facts"))
