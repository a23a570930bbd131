"""Source text rendered from the driver's tables, and what SQL says of it.

Parts are files and their successions in orders are import statements of nine kinds; part numbers decide which
definitions, statements and faults a file has, regions render a package file that is no module, and a project
file names scripts. `raw_files` renders text by Column expressions; `FILES_SQL` and `STATEMENTS_SQL` state the same
files by their lines, so that twins can say what parsing, resolution, classification and chunking must find.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.config import Config
from quarrymap.plans import synthetic as syn
from quarrymap.schemas import CATEGORY_BONUS

REPOSITORY = "rendered"
#: One repository holds all parts, and windows of four lines cut definitions in two.
LIMITS = Config(max_extracted_files=1 << 40, max_python_files=1 << 40, chunk_lines=4)

#: Lines that files with some property have, with `{p}` for the part number: condition in SQL, and lines.
APP, LIMIT, KEY = "part % 13 = 0", "part % 5 = 0", "part % 29 = 0"
FUNCTION, LATER, CLASS = "part % 3 = 0", "part % 3 = 1", "part % 2 = 0"
MAIN, ERROR, SCRIPT = "part % 37 = 0", "part % 41 = 0", "part % 500 = 7"
BLOCKS = [
    (APP, ["app = FastAPI()"]),
    (LIMIT, ["LIMIT = {p}"]),
    (KEY, ['API_KEY = "abcdefghijklmnopqrstuv"']),
    (FUNCTION, ['@app.route("/m{p}")', "def run{p}(x):", '    """Do {p}."""', "    if x and x or None:", "        return [y for y in x if y]", "    return x"]),
    (LATER, ["async def later{p}():", "    while True:", "        break"]),
    (CLASS, ["class Route{p}:", "    size = {p}"]),
    (MAIN, ['if __name__ == "__main__":', "    run()"]),
    (ERROR, ["def oops("]),
]


def statement(n: Column) -> Column:
    """The import line of an edge (imported_module, line_number, target_path) of the file `path`."""
    leaf, own = F.regexp_extract(n.target_path, r"(m\d+)\.py$", 1), F.regexp_extract("path", r"(m\d+)\.py$", 1)
    dotted = F.translate(F.regexp_replace(n.target_path, r"^src/|\.py$", ""), "/", ".")
    package = F.regexp_replace(dotted, r"\.m\d+$", "")
    kind = (n.imported_module.cast("long") + n.line_number) % 9
    outside = F.element_at(F.array(F.lit("sqlalchemy"), F.lit("fastapi"), F.concat(F.lit("ext_"), leaf), F.lit("os")), (F.length(leaf) % 4 + 1).cast("int"))
    made = [
        F.concat(F.lit("import "), dotted), F.concat(F.lit("import "), dotted, F.lit(" as alias")), F.concat(F.lit("from "), dotted, F.lit(" import thing")),
        F.concat(F.lit("from "), package, F.lit(" import "), leaf, F.lit(", nothing")), F.concat(F.lit("from "), package, F.lit(" import gone")), F.concat(F.lit("from ..."), dotted, F.lit(" import thing")),
        F.concat(F.lit("from ...."), leaf, F.lit(" import far")), F.concat(F.lit("from . import "), own, F.lit(", missing")), F.concat(F.lit("import "), outside, F.lit(".sub")),
    ]
    return reduce(lambda found, i: found.when(kind == i, made[i]), range(len(made)), F)  # only the kind that is asked for is made


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW_FILES of the rendered repository."""
    # Edges are gathered, not the longer lines that they make.
    edges = syn.edges(spark, sf_dir).groupBy(F.col("source_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("imported_module", "line_number", "target_path"))).alias("n"))
    lines = edges.select("path", F.transform("n", statement).alias("statements"))
    parts = syn.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", syn.part_path().alias("path")).join(lines, "path", "left")
    none = F.array().cast("array<string>")
    number = F.col("part").cast("string")
    block = lambda rows: F.array(*(F.replace(F.lit(line), F.lit("{p}"), number) for line in rows))
    body = F.concat(F.array(F.concat(F.lit('"""Part '), "p_name", F.lit('."""'))), F.coalesce("statements", none), *(F.when(F.expr(test), block(rows)).otherwise(none) for test, rows in BLOCKS))
    files = parts.select("path", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("content"))
    package = syn.table(spark, sf_dir, "region").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("from . import "), F.lower(F.translate("r_name", " ", "_")), F.lit("\n")))), "").alias("content"))
    target = F.concat(F.lit("s"), number, F.lit(' = "'), F.translate(F.regexp_replace("path", r"^src/|\.py$", ""), "/", "."), F.lit(':run"\n'))
    scripts = parts.filter(SCRIPT).agg(F.concat(F.lit("[project.scripts]\n"), F.array_join(F.array_sort(F.collect_list(target)), "")).alias("content"))
    readme = syn.table(spark, sf_dir, "nation").agg(F.concat(F.lit("# Nations\n"), F.array_join(F.array_sort(F.collect_list(F.col("n_name"))), "\n")).alias("content"))
    named = lambda df, path: df.select(F.lit(path).alias("path"), "content")
    every = files.unionByName(named(package, "src/__init__.py")).unionByName(named(scripts, "pyproject.toml")).unionByName(named(readme, "README.md"))
    kind = F.when(F.col("path").endswith(".py"), "python").otherwise("metadata")
    return every.select(F.lit(REPOSITORY).alias("analysis_id"), "path", F.octet_length("content").cast("long").alias("size_bytes"), kind.alias("kind"), "content")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{p}", "' || part || '") + "'"


_N = "regexp_extract(source_path, 'm(\\d+)\\.py$', 1)"
_KINDS = f"""
    SELECT source_path AS path, target_path, CAST({_N} AS BIGINT) AS part, regexp_extract(target_path, '(m\\d+)\\.py$', 1) AS leaf, 'm' || {_N} AS own,
           replace(regexp_replace(target_path, '^src/|\\.py$', '', 'g'), '/', '.') AS dotted, regexp_replace(replace(regexp_replace(source_path, '^src/|\\.py$', '', 'g'), '/', '.'), '\\.m\\d+$', '') AS own_package,
           CAST((CAST(imported_module AS BIGINT) + line_number) % 9 AS INTEGER) AS kind, CAST(row_number() OVER (PARTITION BY source_path ORDER BY imported_module, line_number, target_path) - 1 AS INTEGER) AS nth FROM ({syn.EDGES})"""
#: A row per import line: what it says (`statement`, `raw`) and what the parser must make of it.
STATEMENTS_SQL = f"""
    SELECT *, CASE kind WHEN 0 THEN 'import ' || dotted WHEN 1 THEN 'import ' || dotted || ' as alias' WHEN 2 THEN 'from ' || dotted || ' import thing' WHEN 3 THEN 'from ' || package || ' import ' || leaf || ', nothing'
               WHEN 4 THEN 'from ' || package || ' import gone' WHEN 5 THEN 'from ...' || dotted || ' import thing' WHEN 6 THEN 'from ....' || leaf || ' import far' WHEN 7 THEN 'from . import ' || own || ', missing' ELSE 'import ' || outside || '.sub' END AS statement,
           CASE WHEN kind IN (0, 1, 2, 5) THEN dotted WHEN kind IN (3, 4) THEN package WHEN kind = 6 THEN leaf WHEN kind = 8 THEN outside || '.sub' END AS module,
           CASE kind WHEN 0 THEN leaf WHEN 1 THEN 'alias' WHEN 3 THEN leaf || ',nothing' WHEN 4 THEN 'gone' WHEN 6 THEN 'far' WHEN 7 THEN own || ',missing' WHEN 8 THEN 'sub' ELSE 'thing' END AS names,
           CASE kind WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 1 ELSE 0 END AS level, kind BETWEEN 2 AND 7 AS is_from
    FROM (SELECT *, regexp_replace(dotted, '\\.m\\d+$', '') AS package, (['sqlalchemy', 'fastapi', 'ext_' || leaf, 'os'])[length(leaf) % 4 + 1] AS outside FROM ({_KINDS}))"""
#: A row per part file: its lines and the places of its definitions; `ok` files parse.
FILES_SQL = f"""
    SELECT *, head + fn + cls + CASE WHEN {MAIN} THEN 2 ELSE 0 END + CASE WHEN ok THEN 0 ELSE 1 END AS total,
           CASE WHEN {MAIN} THEN head + fn + cls + 2 WHEN {APP} OR {LIMIT} OR {KEY} THEN head ELSE 1 END AS level_end,
           ['\"\"\"Part ' || p_name || '.\"\"\"'] || stmts || {" || ".join(f"CASE WHEN {test} THEN [{', '.join(map(_sql, rows))}] ELSE [] END" for test, rows in BLOCKS)} AS lines
    FROM (SELECT n.part, n.path, p_name, NOT ({ERROR}) AS ok, coalesce(s.stmts, []) AS stmts, coalesce(s.raws, []) AS raws, coalesce(len(s.stmts), 0) AS n_imports,
                 1 + coalesce(len(s.stmts), 0) + CASE WHEN {APP} THEN 1 ELSE 0 END + CASE WHEN {LIMIT} THEN 1 ELSE 0 END + CASE WHEN {KEY} THEN 1 ELSE 0 END AS head,
                 CASE WHEN {FUNCTION} THEN 6 WHEN {LATER} THEN 3 ELSE 0 END AS fn, CASE WHEN {CLASS} THEN 2 ELSE 0 END AS cls
          FROM ({syn.NODES}) n JOIN part ON p_partkey = n.part
          LEFT JOIN (SELECT path, list(statement ORDER BY nth) AS stmts, list(replace(statement, ' as alias', '') ORDER BY nth) AS raws FROM ({STATEMENTS_SQL}) GROUP BY 1) s USING (path))"""
#: The definitions of files that parse.
SYMBOLS_SQL = f"""
    SELECT path, part, nth, name, kind, CAST(s AS INTEGER) AS line_start, CAST(e AS INTEGER) AS line_end, decorators, docstring, lines FROM (
        SELECT path, part, lines, 0 AS nth, 'run' || part AS name, 'function' AS kind, head + 2 AS s, head + 6 AS e, 'app.route' AS decorators, 'Do ' || part || '.' AS docstring FROM ({FILES_SQL}) WHERE ok AND {FUNCTION}
        UNION ALL SELECT path, part, lines, 0, 'later' || part, 'async_function', head + 1, head + 3, '', NULL FROM ({FILES_SQL}) WHERE ok AND {LATER}
        UNION ALL SELECT path, part, lines, CASE WHEN fn > 0 THEN 1 ELSE 0 END, 'Route' || part, 'class', head + fn + 1, head + fn + 2, '', NULL FROM ({FILES_SQL}) WHERE ok AND {CLASS})"""
_PACKAGE = "SELECT 'src/__init__.py' AS path, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS nth, name FROM (SELECT lower(replace(r_name, ' ', '_')) AS name FROM region)"
#: A row per resolved target, or unresolved statement, of files that parse.
RESOLVED_SQL = f"""
    SELECT path AS source_path, nth, CASE WHEN kind IN (0, 1, 2, 3, 5) THEN dotted WHEN kind = 7 THEN own_package || '.' || own ELSE module END AS imported_module, CASE WHEN kind = 3 THEN leaf WHEN kind = 7 THEN own ELSE names END AS imported_names,
           CASE WHEN kind IN (0, 1, 2, 3, 5) THEN target_path WHEN kind = 7 THEN path END AS target_path, CASE WHEN kind IN (4, 8) THEN 'external_or_unresolved' WHEN kind = 6 THEN 'relative_level_too_high' END AS unresolved_reason, nth + 2 AS line_number
    FROM ({STATEMENTS_SQL}) WHERE NOT ({ERROR})
    UNION ALL SELECT path, nth, own_package || '.missing', 'missing', NULL, 'external_or_unresolved', nth + 2 FROM ({STATEMENTS_SQL}) WHERE kind = 7 AND NOT ({ERROR})
    UNION ALL SELECT path, nth, '', name, NULL, 'relative_import_without_source_module', nth + 1 FROM ({_PACKAGE})"""
PACKAGE_SQL = _PACKAGE
_BONUS = " ".join(f"WHEN '{c}' THEN {b}" for c, b in CATEGORY_BONUS.items())
_PAIRS = f"SELECT DISTINCT source_path, target_path FROM ({RESOLVED_SQL}) WHERE target_path IS NOT NULL AND target_path <> source_path"
#: A row per Python file: what the whole analysis says of it.
ANALYSED_SQL = f"""
    WITH f AS (SELECT path, part, ok, lines, total FROM ({FILES_SQL}) UNION ALL SELECT 'src/__init__.py', -1, TRUE, list('x'), count(*) FROM region),
    x AS (SELECT source_path AS path, string_agg(DISTINCT imported_module, ',' ORDER BY imported_module) AS external_imports, bool_or(imported_module LIKE 'fastapi.%') AS web, bool_or(imported_module LIKE 'sqlalchemy.%') AS orm
          FROM ({RESOLVED_SQL}) WHERE target_path IS NULL AND imported_module <> '' GROUP BY 1),
    i AS (SELECT target_path AS path, count(*) AS n FROM ({_PAIRS}) GROUP BY 1), o AS (SELECT source_path AS path, count(*) AS n FROM ({_PAIRS}) GROUP BY 1),
    a AS (SELECT path, part, ok, total, coalesce(external_imports, '') AS external_imports, coalesce(web, FALSE) AS web, coalesce(orm, FALSE) AS orm, coalesce(i.n, 0) AS incoming_count, coalesce(o.n, 0) AS outgoing_count,
                 part >= 0 AND ok AND {MAIN} AS main, part >= 0 AND ok AND {APP} AS app, part >= 0 AND {SCRIPT} AS script,
                 CASE WHEN part < 0 OR NOT ok THEN 0 ELSE CASE WHEN {FUNCTION} OR {LATER} THEN 1 ELSE 0 END + CASE WHEN {CLASS} THEN 1 ELSE 0 END END AS symbols
          FROM f LEFT JOIN x USING (path) LEFT JOIN i USING (path) LEFT JOIN o USING (path)),
    c AS (SELECT *, CASE WHEN main OR app OR script THEN 'Entry Point' WHEN path LIKE '%/api/%' THEN 'API / Routes' WHEN path LIKE '%/services/%' THEN 'Services' WHEN path LIKE '%/models/%' THEN 'Models / Data' WHEN path LIKE '%/core/%' THEN 'Core / Domain'
               WHEN path LIKE '%/utils/%' THEN 'Utilities' WHEN part >= 0 AND ok AND {FUNCTION} THEN 'API / Routes' WHEN web AND part >= 0 AND ok AND {CLASS} THEN 'API / Routes' WHEN orm THEN 'Models / Data' ELSE 'Other' END AS category FROM a)
    SELECT *, main OR app OR script AS is_entry_point, CASE WHEN main OR app THEN 'high' WHEN script THEN 'medium' END AS entrypoint_confidence,
           concat_ws('; ', CASE WHEN main THEN 'Contains if __name__ == "__main__" block' END, CASE WHEN app THEN 'Defines a FastAPI application instance' END,
                     CASE WHEN script THEN 'Referenced by console script (' || replace(regexp_replace(path, '^src/|\\.py$', '', 'g'), '/', '.') || ':run)' END) AS entrypoint_reasons,
           least(incoming_count * 4.0::DOUBLE + outgoing_count + CASE WHEN main OR app OR script THEN 25 ELSE 0 END + symbols * 1.5::DOUBLE + CASE category {_BONUS} END, 100)::DOUBLE AS importance_score
    FROM c"""
