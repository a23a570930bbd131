"""Registered queries over the rendered repository: parsing, resolution, the whole analysis, chunks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.operators import modules, summary
from quarrymap.operators.parsing import console_scripts, parse_files
from quarrymap.operators.staging import written
from quarrymap.plans import rendered as r
from quarrymap.plans.analysis import Bundle, analyze
from quarrymap.plans.registry import query
from quarrymap.sources import repositories as repos


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_files(r.raw_files(spark, sf))


def bundle(spark: SparkSession, sf: str) -> Bundle:
    return analyze(written(r.raw_files(spark, sf), "rendered"), r.LIMITS)


def joined(c: str, mark: str = ",") -> F.Column:
    return F.array_join(c, mark).alias(c)


@query(f"""
    SELECT path, CASE WHEN ok THEN 'ok' ELSE 'error' END AS parse_status, CASE WHEN NOT ok THEN 'SyntaxError: ''('' was never closed (line ' || total || ')' END AS parse_warning, CASE WHEN ok THEN 'Part ' || p_name || '.' END AS docstring,
           CAST(total AS INTEGER) AS line_count, CASE WHEN ok THEN CASE WHEN {r.FUNCTION} THEN 5 WHEN {r.LATER} THEN 1 ELSE 0 END + CASE WHEN {r.MAIN} THEN 1 ELSE 0 END ELSE 0 END AS estimated_complexity, ok AND {r.MAIN} AS has_main_block,
           CASE WHEN ok AND {r.APP} THEN 'fastapi_app' ELSE '' END AS framework_hints, CASE WHEN ok THEN 1 END AS module_level_start, CASE WHEN ok THEN CAST(level_end AS INTEGER) END AS module_level_end FROM ({r.FILES_SQL})
    UNION ALL SELECT 'src/__init__.py', 'ok', NULL, NULL, CAST(count(*) AS INTEGER), 0, FALSE, '', NULL, NULL FROM region""")
def parse_status(spark, sf):
    return parsed(spark, sf).select("path", "parse_status", "parse_warning", "docstring", "line_count", "estimated_complexity", "has_main_block", joined("framework_hints"), "module_level_start", "module_level_end")


@query(f"""
    SELECT path, nth, module, names, level, nth + 2 AS line_number, is_from, replace(statement, ' as alias', '') AS raw FROM ({r.STATEMENTS_SQL}) WHERE NOT ({r.ERROR})
    UNION ALL SELECT path, nth, NULL, name, 1, nth + 1, TRUE, 'from . import ' || name FROM ({r.PACKAGE_SQL})""")
def parse_imports(spark, sf):
    rows = parsed(spark, sf).select("path", F.posexplode("imports").alias("nth", "i")).select("path", "nth", "i.*")
    return rows.withColumn("names", F.array_join("names", ","))


@query(f"SELECT path, nth, name, kind, line_start, line_end, decorators, docstring FROM ({r.SYMBOLS_SQL})")
def parse_symbols(spark, sf):
    rows = parsed(spark, sf).select("path", F.posexplode("symbols").alias("nth", "s")).select("path", "nth", "s.*")
    return rows.withColumn("decorators", F.array_join("decorators", ","))


@query(f"SELECT *, CASE WHEN target_path IS NULL THEN 'low' ELSE 'high' END AS confidence FROM ({r.RESOLVED_SQL})")
def resolve_branches(spark, sf):
    rows = written(parsed(spark, sf).select("analysis_id", "path", "imports"), "parsed")
    found = modules.resolve_imports(modules.import_rows(rows), modules.module_map(rows))
    return found.select("source_path", "nth", "imported_module", F.array_join("imported_names", ",").alias("imported_names"), "line_number", "target_path", "confidence", "unresolved_reason")


@query(f"SELECT path, category, FALSE AS is_test, is_entry_point, entrypoint_confidence, entrypoint_reasons, external_imports, incoming_count, outgoing_count, importance_score FROM ({r.ANALYSED_SQL})")
def analysed_files(spark, sf):
    return bundle(spark, sf).files.select("path", "category", "is_test", "is_entry_point", "entrypoint_confidence", joined("entrypoint_reasons", "; "), joined("external_imports"), "incoming_count", "outgoing_count", "importance_score")


_GOOD = f"ok AND NOT ({r.KEY})"
_SYMBOLS = f"SELECT path, string_agg(kind || ':' || name, ', ' ORDER BY nth) AS s FROM ({r.SYMBOLS_SQL}) GROUP BY 1"
#: (path, chunk_type, symbol_name, line_start, line_end, content) of the rendered files.
CHUNKS = f"""
    SELECT path, 'module_overview' AS chunk_type, NULL AS symbol_name, 1 AS line_start, CAST(least(total, 40) AS INTEGER) AS line_end,
           concat_ws(chr(10) || chr(10), 'Part ' || p_name || '.', CASE WHEN n_imports > 0 THEN 'Imports:' || chr(10) || array_to_string(raws[1:40], chr(10)) END, 'Symbols: ' || s) AS content FROM ({r.FILES_SQL}) LEFT JOIN ({_SYMBOLS}) USING (path) WHERE {_GOOD}
    UNION ALL SELECT path, 'module_level', NULL, 1, CAST(level_end AS INTEGER), array_to_string(lines[1:level_end], chr(10)) FROM ({r.FILES_SQL}) WHERE {_GOOD}
    UNION ALL SELECT path, kind, name, CAST(s AS INTEGER), CAST(least(s + 3, line_end) AS INTEGER), array_to_string(lines[s:least(s + 3, line_end)], chr(10)) FROM (SELECT *, unnest(range(line_start, line_end + 1, 4)) AS s FROM ({r.SYMBOLS_SQL})) WHERE NOT ({r.KEY})
    UNION ALL SELECT 'src/__init__.py', 'module_overview', NULL, 1, CAST(count(*) AS INTEGER), 'Imports:' || chr(10) || string_agg('from . import ' || name, chr(10) ORDER BY nth) FROM ({r.PACKAGE_SQL})"""


@query(f"SELECT path, chunk_type, symbol_name, line_start, line_end, md5(content) AS content_md5, length(concat_ws(chr(10), path, CASE WHEN chunk_type = 'module_level' THEN 'module_level' ELSE symbol_name END, content)) AS search_chars FROM ({CHUNKS})")
def analysed_chunks(spark, sf):
    return bundle(spark, sf).chunks.select("path", "chunk_type", "symbol_name", "line_start", "line_end", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.length("search_text").alias("search_chars"))


_EDGE_ROWS = f"SELECT DISTINCT source_path, target_path, imported_module, line_number FROM ({r.RESOLVED_SQL}) WHERE target_path IS NOT NULL AND target_path <> source_path"


@query(f"""
    SELECT count(*) AS python_file_count, CAST(sum(total) AS BIGINT) AS lines_of_python, (SELECT count(*) FROM ({_EDGE_ROWS})) AS internal_dependency_edges, count(*) FILTER (is_entry_point) AS entry_point_count, 0 AS test_file_count,
           count(*) FILTER (NOT ok) AS parse_warning_count, (SELECT count(*) FROM ({CHUNKS})) AS chunk_count FROM ({r.ANALYSED_SQL})""")
def run_statistics(spark, sf):
    return bundle(spark, sf).statistics.drop("analysis_id").withColumn("test_file_count", F.col("test_file_count").cast("int"))


@query(f"""
    WITH a AS (SELECT *, row_number() OVER (ORDER BY importance_score DESC, path) AS rank FROM ({r.ANALYSED_SQL}))
    SELECT unnest([0, 1, 2, 3]) AS nth, unnest(['Python files: ' || count(*), 'Internal edges: ' || (SELECT count(*) FROM ({_EDGE_ROWS})), 'Entry points: [' || string_agg('''' || path || '''', ', ' ORDER BY rank) FILTER (is_entry_point) || ']',
        'Important files: [' || string_agg('''' || path || '''', ', ' ORDER BY rank) FILTER (rank <= 8) || ']']) AS fact FROM a""")
def facts(spark, sf):
    b = bundle(spark, sf)
    return summary.structural_facts(b.statistics, b.files).select(F.posexplode("facts").alias("nth", "fact"))


@query(f"""
    SELECT (SELECT '# Nations' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_name) FROM nation) AS readme_excerpt,
           (SELECT string_agg(replace(regexp_replace(path, '^src/|\\.py$', '', 'g'), '/', '.') || ':run', ',' ORDER BY replace(regexp_replace(path, '^src/|\\.py$', '', 'g'), '/', '.') || ':run') FROM ({r.FILES_SQL}) WHERE {r.SCRIPT}) AS scripts""")
def repository_texts(spark, sf):
    kept, _ = repos.scan(r.raw_files(spark, sf), r.LIMITS)
    kept = kept.filter("kind = 'metadata'")
    scripts = repos.metadata_text(kept, "pyproject.toml").select("analysis_id", console_scripts("text").alias("scripts"))
    return repos.readme_excerpts(kept).join(scripts, "analysis_id", "full").select("readme_excerpt", joined("scripts"))
