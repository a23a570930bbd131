"""Registered queries of analyses and their states: orders are analyses, customers are repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymap.functions.text import string_list
from quarrymap.operators import status, store
from quarrymap.plans import synthetic as syn
from quarrymap.plans.registry import query

STAGES = ", ".join(f"({i}, '{s}', {p})" for i, (s, p) in enumerate(status.STAGES))


def _analyses(spark, sf):
    return syn.table(spark, sf, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("repository_id"), "o_orderstatus", F.col("o_orderdate").alias("created_at"))


def _failures(spark, sf):
    """Orders of status P fail in their fourth stage, those of the highest priority in their second."""
    rows = syn.table(spark, sf, "orders")
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", "downloading_source").when(F.col("o_orderstatus") == "P", "parsing_python")
    return rows.select(F.col("o_orderkey").alias("analysis_id"), stage.alias("stage"), F.lit("X").alias("error_code"), F.col("o_orderpriority").alias("error_message")).filter("stage IS NOT NULL")


EVENTS = f"""
    SELECT o_orderkey AS analysis_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq = fails THEN 'failed' WHEN stage = 'complete' THEN 'completed' ELSE 'processing' END AS status, stage, CAST(progress AS INTEGER) AS progress,
           CASE WHEN seq = fails THEN 'X' END AS error_code, CASE WHEN seq = fails THEN o_orderpriority END AS error_message
    FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'P' THEN 3 END AS fails FROM orders) JOIN (VALUES {STAGES}) AS s(seq, stage, progress) ON seq <= coalesce(fails, 7)"""


@query(EVENTS)
def stage_events(spark, sf):
    return status.stage_events(_analyses(spark, sf), _failures(spark, sf))


@query(f"""
    SELECT analysis_id, repository_id, status, stage, progress, error_code, c_name AS repository, c_mktsegment AS language, lines
    FROM (SELECT o_orderkey AS analysis_id, o_custkey AS repository_id FROM orders) JOIN (SELECT DISTINCT ON (analysis_id) * FROM ({EVENTS}) ORDER BY analysis_id, seq DESC) USING (analysis_id)
    LEFT JOIN (SELECT c_custkey AS repository_id, c_name, c_mktsegment FROM customer) USING (repository_id)
    LEFT JOIN (SELECT l_orderkey AS analysis_id, count(*) AS lines FROM lineitem GROUP BY 1) USING (analysis_id)""")
def analysis_header(spark, sf):
    events = status.stage_events(_analyses(spark, sf), _failures(spark, sf)).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    repositories = syn.table(spark, sf, "customer").select(F.col("c_custkey").alias("repository_id"), "c_name", "c_mktsegment")
    counts = syn.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.count("*").alias("lines"))
    found = status.headers(status.with_status(_analyses(spark, sf), events), repositories, counts)
    return found.select("analysis_id", "repository_id", "status", "stage", "progress", "error_code", F.col("repository.c_name").alias("repository"), F.col("repository.c_mktsegment").alias("language"), "statistics.lines")


@query("SELECT l_orderkey AS analysis_id, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def status_gate(spark, sf):
    states = _analyses(spark, sf).withColumn("status", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("processing"))
    view = syn.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), "l_linenumber", "l_partkey")
    return status.completed(view, states)


@query("SELECT conv_id, turn, length(text) BETWEEN 3 AND 2000 AS fits, length(left(text, CAST(turn % 5 AS INTEGER))) BETWEEN 3 AND 2000 AS head_fits, length(repeat(text, 12)) BETWEEN 3 AND 2000 AS long_fits FROM conversations")
def question_length(spark, sf):
    text = F.col("text")
    return syn.table(spark, sf, "conversations").select(
        "conv_id", "turn", status.askable(text).alias("fits"), status.askable(F.substring(text, F.lit(1), F.col("turn") % 5)).alias("head_fits"), status.askable(F.repeat(text, F.lit(12))).alias("long_fits")
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '—' ELSE left(md5(CAST(o_orderkey AS VARCHAR)), 7) END AS sha,
           CASE WHEN o_orderstatus = 'P' THEN '—' ELSE strftime(o_orderdate, '%b %-d, %Y, %-I:%M %p') END AS shown FROM orders""")
def short_display(spark, sf):
    known = F.col("o_orderstatus") != "P"
    sha = F.when(known, F.md5(F.col("o_orderkey").cast("string")))
    return syn.table(spark, sf, "orders").select("o_orderkey", status.short_sha(sha).alias("sha"), status.shown_date(F.when(known, F.col("o_orderdate"))).alias("shown"))


@query(f"""
    WITH ids AS (SELECT path, sha256(path) AS id FROM ({syn.NODES}) WHERE NOT is_test)
    SELECT source_path, s.id AS source_file_id, target_path, t.id AS target_file_id, imported_module, line_number FROM ({syn.EDGES}) JOIN ids s ON s.path = source_path JOIN ids t ON t.path = target_path""")
def edges_with_file_ids(spark, sf):
    ids = syn.nodes(spark, sf).filter("NOT is_test").withColumn("file_id", F.sha2("path", 256))
    return store.with_file_ids(syn.edges(spark, sf), ids, "source_path", "target_path").select("source_path", "source_file_id", "target_path", "target_file_id", "imported_module", "line_number")


@query("SELECT doc_id, CASE WHEN source < 'src5' THEN [1.0::DOUBLE] ELSE [CAST(length(left(text, 6000)) AS DOUBLE), CAST(length(left(text, 6000)) - length(replace(left(text, 6000), 'e', '')) AS DOUBLE)] END AS embedding FROM documents")
def embedding_fill(spark, sf):
    rows = syn.table(spark, sf, "documents").select("doc_id", F.col("text").alias("search_text"), F.when(F.col("source") < "src5", F.array(F.lit(1.0))).cast("array<double>").alias("embedding"))
    return store.fill_embeddings(rows, lambda texts: [[len(t), t.count("e")] for t in texts]).select("doc_id", "embedding")


@query("""
    SELECT doc_id, CASE kind WHEN 0 THEN word WHEN 1 THEN array_to_string(list_filter([word, source], lambda x: x <> ''), '|') WHEN 2 THEN CASE WHEN word = 'null' THEN '' ELSE word END ELSE '' END AS items
    FROM (SELECT doc_id, source, doc_id % 4 AS kind, regexp_extract(text, '[a-z]+') AS word FROM documents)""")
def string_lists(spark, sf):
    """A JSON string, a list with blanks and a null, a bare scalar, and null."""
    word, kind = F.regexp_extract("text", "[a-z]+", 0), F.col("doc_id") % 4
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    json = F.when(kind == 0, quoted(F.concat(F.lit(" "), word, F.lit(" ")))).when(kind == 1, F.concat(F.lit('["  ", '), quoted(word), F.lit(", null, "), quoted(F.col("source")), F.lit("]"))).when(kind == 2, word)
    return syn.table(spark, sf, "documents").select("doc_id", F.array_join(string_list(json), "|").alias("items"))
