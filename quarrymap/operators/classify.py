"""Entry points, categories and importance of files, as Column expressions; the join of files and console scripts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.paths import basename, is_test_path, parts
from quarrymap.schemas import CATEGORY_BONUS

# Entry file names, notable symbols, labels of framework hints, what makes confidence high, and the
# sentences of reasons here and in `entry_reasons` and `classify`.
ENTRY_NAMES = ["main.py", "app.py", "server.py", "cli.py", "manage.py", "wsgi.py", "asgi.py", "__main__.py"]
SURE_NAMES = ["__main__.py", "manage.py", "wsgi.py", "asgi.py"]
NOTABLE = ["main", "cli", "app", "create_app", "get_application"]
HINT_LABELS = {
    "fastapi_app": "Defines a FastAPI application instance",
    "flask_app": "Defines a Flask application instance",
    "typer_app": "Defines a Typer CLI application",
    "uvicorn_run": "Calls uvicorn.run",
    "click_command": "Defines Click commands",
    "django_management": "Django management entry patterns",
    "django_asgi": "Django ASGI application",
    "django_wsgi": "Django WSGI application",
}
MAIN_REASON = 'Contains if __name__ == "__main__" block'
SURE_REASONS = [MAIN_REASON, *(HINT_LABELS[h] for h in ("fastapi_app", "flask_app", "django_asgi", "django_wsgi"))]

# Directory names (and file names) of each category, in order of precedence.
BY_PATH = [
    ("API / Routes", ["api", "routes", "routers", "views", "endpoints"], [], "Directory suggests API / routing layer"),
    ("Services", ["services", "service", "use_cases", "usecases"], [], "Directory suggests service layer"),
    ("Models / Data", ["models", "schemas", "entities", "db", "database", "repositories"], [], "Directory suggests models / data access"),
    ("Core / Domain", ["core", "domain", "business"], [], "Directory suggests core / domain logic"),
    ("Configuration", ["config", "settings", "conf"], ["config.py", "settings.py", "configuration.py"], "Path or filename indicates configuration"),
    ("CLI", ["cli", "commands"], ["cli.py", "commands.py"], "Path indicates CLI tooling"),
    ("Scripts", ["scripts"], [], "Located under scripts/"),
    ("Utilities", ["utils", "util", "helpers", "common"], [], "Directory suggests utilities"),
]
WEB_ROOTS, DATA_ROOTS = ["fastapi", "flask", "starlette"], ["sqlalchemy", "django", "tortoise", "peewee"]


#: Characters of a script's end that it and a file's name meet by.
TAIL = 16


def _dotted(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.py$", "")


def _by_module(path: Column, target: Column) -> Column:
    return F.endswith(target, _dotted(path)) | F.endswith(_dotted(path), F.replace(target, F.lit(":"), F.lit(".")))


def _script_files(target: Column) -> list[Column]:
    """Ends of the paths that a script may mean."""
    file = F.replace(F.element_at(F.split(target, ":"), 1), F.lit("."), F.lit("/"))
    return [F.concat(file, F.lit(".py")), F.concat(file, F.lit("/__init__.py"))]


def _by_path(path: Column, target: Column) -> Column:
    return reduce(or_, (F.endswith(path, end) for end in _script_files(target)))


def script_targets(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """(analysis_id, path, target): the least script that refers to a file, of files (analysis_id, path) and scripts (analysis_id, scripts).

    No file meets all scripts: a script's last `TAIL` characters (all, if fewer) are the key of an equi-join with ends of
    paths and modules that are as long, and every end of a script is looked up among whole modules; the rule then decides.
    """
    each = scripts.select("analysis_id", F.explode("scripts").alias("target"))
    target, module = F.col("target"), _dotted(F.col("path"))
    made = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    tail = lambda c: F.right(c, F.lit(TAIL))
    ends = F.transform(F.sequence(F.lit(0), F.length("target")), lambda n: made("whole", F.right(target, n)))
    keys = F.concat(ends, F.array(made("module", tail(F.replace(target, F.lit(":"), F.lit(".")))), *(made("path", tail(end)) for end in _script_files(target))))
    wanted = each.select("analysis_id", "target", F.explode(keys).alias("k")).select("analysis_id", "target", "k.*")
    sizes = wanted.filter("kind <> 'whole'").groupBy("analysis_id").agg(F.collect_set(F.struct("kind", F.length("key").alias("size"))).alias("sizes"))
    asked = F.transform("sizes", lambda s: F.struct(s.kind.alias("kind"), F.right(F.when(s.kind == "module", module).otherwise(F.col("path")), s.size).alias("key")))
    named = files.select("analysis_id", "path").join(sizes, "analysis_id")
    named = named.select("analysis_id", "path", F.explode(F.array_union(F.array(made("whole", module)), asked)).alias("k")).select("analysis_id", "path", "k.*")
    met = named.join(wanted, ["analysis_id", "kind", "key"]).filter(_by_module(F.col("path"), target) | _by_path(F.col("path"), target))
    return met.groupBy("analysis_id", "path").agg(F.min("target").alias("target"))


def entry_reasons(path: Column, has_main: Column, hints: Column, symbol_names: Column, scripts: Column) -> Column:
    """Ordered distinct reasons; of several matching scripts the least one is reported."""
    name = basename(path)
    target = F.get(F.filter(F.array_sort(scripts), lambda t: _by_module(path, t) | _by_path(path, t)), 0)
    script = F.when(_by_module(path, target), F.concat(F.lit("Referenced by console script target ("), target, F.lit(")"))).when(target.isNotNull(), F.concat(F.lit("Referenced by console script ("), target, F.lit(")")))
    labels = F.transform(hints, lambda h: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in HINT_LABELS.items() for x in kv)), h), h))
    own = F.array(F.when(name.isin(ENTRY_NAMES), F.concat(F.lit("Filename matches common entry-point pattern ("), name, F.lit(")"))), F.when(has_main, MAIN_REASON))
    notable = F.transform(F.filter(symbol_names, lambda s: s.isin(NOTABLE)), lambda s: F.concat(F.lit("Defines notable symbol `"), s, F.lit("`")))
    return F.array_distinct(F.array_compact(F.concat(own, labels, F.array(script), notable)))


def entry_confidence(path: Column, reasons: Column) -> Column:
    name = basename(path)
    sure = F.arrays_overlap(reasons, F.array(*map(F.lit, SURE_REASONS))) | name.isin(SURE_NAMES)
    likely = name.isin(ENTRY_NAMES) | F.exists(reasons, lambda r: r.startswith("Referenced by console script"))
    return F.when(F.size(reasons) == 0, F.lit(None).cast("string")).when(sure, "high").when(likely, "medium").otherwise("low")


def related_symbols(symbol_names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(symbol_names, lambda s: s.isin(NOTABLE))))


def classify(path: Column, is_entry: Column, symbols: Column, externals: Column) -> Column:
    """struct(category, reason): the first arm that holds."""
    low = F.transform(parts(path), F.lower)
    name = F.lower(basename(path))
    has = lambda words: F.arrays_overlap(low, F.array(*map(F.lit, words)))
    roots = F.transform(externals, lambda e: F.element_at(F.split(e, r"\."), 1))
    uses = lambda words: F.arrays_overlap(roots, F.array(*map(F.lit, words)))
    decorators = F.flatten(F.transform(symbols, lambda s: s.decorators))
    routed = F.exists(decorators, lambda d: d.endswith("route") | d.endswith("get") | d.endswith("post") | F.lower(d).contains("router"))
    route_symbol = F.exists(symbols, lambda s: F.lower(s["name"]).contains("route"))
    migration = F.array_contains(low, "migrations") | (name.startswith("0") & F.lower(path).contains("alembic"))
    arms = [
        (is_test_path(path), "Tests", "Path or filename indicates a test module"),
        (is_entry, "Entry Point", "Detected as an entry point"),
        (migration, "Migrations", "Path indicates database migrations"),
        *((reduce(or_, [has(dirs), *([name.isin(names)] if names else [])]), category, reason) for category, dirs, names, reason in BY_PATH),
        (routed, "API / Routes", "Route-like decorators detected"),
        (uses(WEB_ROOTS) & route_symbol, "API / Routes", "Web framework imports with route symbols"),
        (uses(DATA_ROOTS), "Models / Data", "ORM / data library imports"),
    ]
    made = lambda category, reason: F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))
    chain = F
    for test, category, reason in arms:
        chain = chain.when(test, made(category, reason))
    return chain.otherwise(made("Other", "No strong structural signal"))


def importance(incoming: Column, outgoing: Column, is_entry: Column, symbol_count: Column, category: Column) -> Column:
    """Score between 0 and 100: 4 an importer, 1 an import, 25 an entry point, 1.5 a symbol (20 at most), and the category's bonus."""
    bonus = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_BONUS.items() for x in kv)), category), F.lit(0.0))
    raw = incoming * 4.0 + outgoing * 1.0 + F.when(is_entry, 25.0).otherwise(0.0) + F.least(symbol_count, F.lit(20)) * 1.5 + bonus
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))


def importance_sentence(incoming: Column, outgoing: Column, is_entry: Column, category: Column) -> Column:
    s = lambda n: F.when(n != 1, "s").otherwise("")
    return F.concat(
        F.lit("Imported by "), incoming.cast("string"), F.lit(" internal module"), s(incoming),
        F.lit(" with "), outgoing.cast("string"), F.lit(" outgoing dependency edge"), s(outgoing),
        F.when(is_entry, " and detected as an application entry point").otherwise(""),
        F.lit(" (category: "), category, F.lit(")."),
    )
