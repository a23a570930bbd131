"""The demonstration repositories, whose texts stand in the code, against rows worked out from the texts by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.config import Config
from quarrymap.operators import answers, graph, retrieval
from quarrymap.operators.parsing import console_scripts, parse_files
from quarrymap.plans import demo
from quarrymap.plans.analysis import Bundle, analyze
from quarrymap.sources import repositories as repos
from tests.test_driver_queries import normal

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def literal(columns: str, *rows: tuple) -> str:
    """SQL of literal rows: the twin of a query over texts that stand in the code."""

    def value(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    listed = ",\n           ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) AS t({columns})"


def joined(c: str, mark: str = ",") -> F.Column:
    return F.array_join(c, mark).alias(c)


def bundle(spark: SparkSession) -> Bundle:
    return analyze(demo.raw_files(spark).unionByName(demo.odd_files(spark)))


def parsed(spark: SparkSession) -> DataFrame:
    return parse_files(demo.raw_files(spark).unionByName(demo.odd_files(spark)))


def _archive_rows() -> list[tuple]:
    """What the archives of the first two repositories hold, by name and text."""
    kind = {"notes.txt": "other", "README.md": "metadata", "pyproject.toml": "metadata"}
    digest = lambda p, c: None if p in ("notes.txt", ".venv/lib/x.py") else hashlib.md5(c.encode()).hexdigest()
    return [(a, p, len(c.encode()), kind.get(p, "python"), digest(p, c)) for a in ("shop", "broken") for p, c in demo.TREES[a].items()]


@query(
    literal(
        "analysis_id, path, parse_status, parse_warning, docstring, line_count, estimated_complexity, has_main_block, framework_hints, module_level_start, module_level_end",
        ('broken', 'lib/thing.py', 'ok', None, None, 1, 0, False, '', None, None),
        ('broken', 'tool.py', 'error', "SyntaxError: '(' was never closed (line 1)", None, 1, 0, False, '', None, None),
        ('odd', 'manage.py', 'ok', None, None, 3, 0, False, 'django_management', 3, 3),
        ('odd', 'migrations/0001_init.py', 'ok', None, None, 1, 0, False, '', 1, 1),
        ('odd', 'secret.py', 'ok', None, None, 1, 0, False, '', 1, 1),
        ('odd', 'src/__init__.py', 'ok', None, None, 1, 0, False, '', None, None),
        ('odd', 'src/pkg/__init__.py', 'ok', None, None, 2, 0, False, '', None, None),
        ('odd', 'src/pkg/a.py', 'ok', None, None, 6, 0, False, '', None, None),
        ('odd', 'src/pkg/b.py', 'ok', None, 'Bee.', 35, 13, True, 'click_command', 1, 35),
        ('odd', 'src/pkg/sub/__init__.py', 'ok', None, None, 0, 0, False, '', None, None),
        ('odd', 'src/pkg/sub/deep.py', 'ok', None, None, 3, 0, False, '', None, None),
        ('shop', '.venv/lib/x.py', 'ok', None, None, 1, 0, False, '', None, None),
        ('shop', 'src/shop/__init__.py', 'ok', None, None, 0, 0, False, '', None, None),
        ('shop', 'src/shop/api/__init__.py', 'ok', None, 'API.', 1, 0, False, '', 1, 1),
        ('shop', 'src/shop/api/routes.py', 'ok', None, None, 7, 0, False, 'fastapi_app', None, None),
        ('shop', 'src/shop/core/settings.py', 'ok', None, None, 1, 0, False, '', 1, 1),
        ('shop', 'src/shop/main.py', 'ok', None, 'Start.', 13, 1, True, 'uvicorn_run', 1, 13),
        ('shop', 'src/shop/models/order.py', 'ok', None, None, 6, 0, False, '', None, None),
        ('shop', 'src/shop/services/orders.py', 'ok', None, None, 7, 2, False, '', None, None),
        ('shop', 'src/shop/utils/ids.py', 'ok', None, None, 2, 0, False, '', None, None),
        ('shop', 'tests/test_orders.py', 'ok', None, None, 5, 0, False, '', None, None),
    )
)
def parse_status(spark, sf):
    return parsed(spark).select("analysis_id", "path", "parse_status", "parse_warning", "docstring", "line_count", "estimated_complexity", "has_main_block", joined("framework_hints"), "module_level_start", "module_level_end")


@query(
    literal(
        "analysis_id, path, nth, module, names, level, line_number, is_from, raw",
        ('broken', 'lib/thing.py', 0, 'os', 'os', 0, 1, False, 'import os'),
        ('broken', 'lib/thing.py', 1, 'sys', 'sys', 0, 1, False, 'import sys'),
        ('odd', 'manage.py', 0, 'django.core.management', 'execute_from_command_line', 0, 1, True, 'from django.core.management import execute_from_command_line'),
        ('odd', 'src/__init__.py', 0, None, 'pkg', 1, 1, True, 'from . import pkg'),
        ('odd', 'src/pkg/__init__.py', 0, None, 'a,missing', 1, 1, True, 'from . import a, missing'),
        ('odd', 'src/pkg/__init__.py', 1, 'b', 't', 1, 2, True, 'from .b import thing'),
        ('odd', 'src/pkg/a.py', 0, 'pkg.b', 'bee', 0, 1, False, 'import pkg.b'),
        ('odd', 'src/pkg/a.py', 1, 'json.decoder', 'decoder', 0, 1, False, 'import json.decoder'),
        ('odd', 'src/pkg/a.py', 2, None, 'far', 2, 2, True, 'from .. import far'),
        ('odd', 'src/pkg/a.py', 3, 'toofar', 'x', 3, 3, True, 'from ...toofar import x'),
        ('odd', 'src/pkg/a.py', 4, 'pkg', 'b,nothing', 0, 4, True, 'from pkg import b, nothing'),
        ('odd', 'src/pkg/a.py', 5, 'pkg.sub', 'deep', 0, 5, True, 'from pkg.sub import deep'),
        ('odd', 'src/pkg/a.py', 6, 'unknown.place', '*', 0, 6, True, 'from unknown.place import *'),
        ('odd', 'src/pkg/b.py', 0, 'click', 'click', 0, 2, False, 'import click'),
        ('odd', 'src/pkg/sub/deep.py', 0, 'b', 'thing', 2, 1, True, 'from ..b import thing'),
        ('odd', 'src/pkg/sub/deep.py', 1, 'pkg', 'a', 3, 2, True, 'from ...pkg import a'),
        ('odd', 'src/pkg/sub/deep.py', 2, 'os.path', 'path', 0, 3, False, 'import os.path'),
        ('shop', '.venv/lib/x.py', 0, 'os', 'os', 0, 1, False, 'import os'),
        ('shop', 'src/shop/api/routes.py', 0, 'fastapi', 'FastAPI', 0, 1, True, 'from fastapi import FastAPI'),
        ('shop', 'src/shop/api/routes.py', 1, 'shop.services', 'o', 0, 2, True, 'from shop.services import orders'),
        ('shop', 'src/shop/api/routes.py', 2, 'models', 'order', 2, 3, True, 'from ..models import order'),
        ('shop', 'src/shop/main.py', 0, 'shop.api.routes', 'build', 0, 2, True, 'from shop.api.routes import build'),
        ('shop', 'src/shop/main.py', 1, 'core', 'settings', 1, 3, True, 'from .core import settings'),
        ('shop', 'src/shop/models/order.py', 0, 'dataclasses', 'dataclass', 0, 1, True, 'from dataclasses import dataclass'),
        ('shop', 'src/shop/services/orders.py', 0, 'shop.models.order', 'order', 0, 1, False, 'import shop.models.order'),
        ('shop', 'src/shop/services/orders.py', 1, 'shop.utils.ids', 'fresh', 0, 2, True, 'from shop.utils.ids import fresh'),
        ('shop', 'tests/test_orders.py', 0, 'shop.services.orders', 'Orders', 0, 1, True, 'from shop.services.orders import Orders'),
    )
)
def parse_imports(spark, sf):
    rows = parsed(spark).select("analysis_id", "path", F.posexplode("imports").alias("nth", "i")).select("analysis_id", "path", "nth", "i.*")
    return rows.withColumn("names", F.array_join("names", ","))


@query(
    literal(
        "analysis_id, path, nth, name, kind, line_start, line_end, decorators, docstring",
        ('odd', 'src/pkg/b.py', 0, 'thing', 'function', 9, 17, 'click.command,Subscript.wrap', 'Do it.'),
        ('odd', 'src/pkg/b.py', 1, 'later', 'async_function', 20, 26, '', None),
        ('odd', 'src/pkg/b.py', 2, 'Keeper', 'class', 29, 31, '', None),
        ('shop', 'src/shop/api/routes.py', 0, 'build', 'function', 6, 7, '', None),
        ('shop', 'src/shop/main.py', 0, 'run', 'function', 6, 9, '', None),
        ('shop', 'src/shop/models/order.py', 0, 'Order', 'class', 5, 6, 'dataclass', None),
        ('shop', 'src/shop/services/orders.py', 0, 'Orders', 'class', 5, 7, '', None),
        ('shop', 'src/shop/utils/ids.py', 0, 'fresh', 'function', 1, 2, '', None),
        ('shop', 'tests/test_orders.py', 0, 'test_all', 'function', 4, 5, '', None),
    )
)
def parse_symbols(spark, sf):
    rows = parsed(spark).select("analysis_id", "path", F.posexplode("symbols").alias("nth", "s")).select("analysis_id", "path", "nth", "s.*")
    return rows.withColumn("decorators", F.array_join("decorators", ","))


@query(
    literal(
        "source_path, nth, imported_module, imported_names, line_number, target_path, confidence, unresolved_reason",
        ('manage.py', 0, 'django.core.management', 'execute_from_command_line', 1, None, 'low', 'external_or_unresolved'),
        ('src/__init__.py', 0, '', 'pkg', 1, None, 'low', 'relative_import_without_source_module'),
        ('src/pkg/__init__.py', 0, 'pkg.a', 'a', 1, 'src/pkg/a.py', 'high', None),
        ('src/pkg/__init__.py', 0, 'pkg.missing', 'missing', 1, None, 'low', 'external_or_unresolved'),
        ('src/pkg/__init__.py', 1, 'pkg.b', 't', 2, 'src/pkg/b.py', 'high', None),
        ('src/pkg/a.py', 0, 'pkg.b', 'bee', 1, 'src/pkg/b.py', 'high', None),
        ('src/pkg/a.py', 1, 'json.decoder', 'decoder', 1, None, 'low', 'external_or_unresolved'),
        ('src/pkg/a.py', 2, 'far', 'far', 2, None, 'low', 'external_or_unresolved'),
        ('src/pkg/a.py', 3, 'toofar', 'x', 3, None, 'low', 'relative_level_too_high'),
        ('src/pkg/a.py', 4, 'pkg', 'b,nothing', 4, 'src/pkg/__init__.py', 'high', None),
        ('src/pkg/a.py', 5, 'pkg.sub', 'deep', 5, 'src/pkg/sub/__init__.py', 'high', None),
        ('src/pkg/a.py', 6, 'unknown.place', '*', 6, None, 'low', 'external_or_unresolved'),
        ('src/pkg/b.py', 0, 'click', 'click', 2, None, 'low', 'external_or_unresolved'),
        ('src/pkg/sub/deep.py', 0, 'pkg.b', 'thing', 1, 'src/pkg/b.py', 'high', None),
        ('src/pkg/sub/deep.py', 1, 'pkg', 'a', 2, 'src/pkg/__init__.py', 'high', None),
        ('src/pkg/sub/deep.py', 2, 'os.path', 'path', 3, None, 'low', 'external_or_unresolved'),
    )
)
def resolve_branches(spark, sf):
    from quarrymap.operators import modules

    rows = parsed(spark)
    found = modules.resolve_imports(modules.import_rows(rows), modules.module_map(rows)).filter("analysis_id = 'odd'")
    return found.select("source_path", "nth", "imported_module", F.array_join("imported_names", ",").alias("imported_names"), "line_number", "target_path", "confidence", "unresolved_reason")


@query(
    literal(
        "analysis_id, path, category, category_reason, is_test, entrypoint_confidence, entrypoint_reasons, external_imports, incoming_count, outgoing_count, importance_score, related_symbols",
        ('broken', 'lib/thing.py', 'Other', 'No strong structural signal', False, None, '', 'os,sys', 0, 0, 0.0, ''),
        ('broken', 'tool.py', 'Other', 'No strong structural signal', False, None, '', '', 0, 0, 0.0, ''),
        ('odd', 'manage.py', 'Entry Point', 'Detected as an entry point', False, 'high', 'Filename matches common entry-point pattern (manage.py); Django management entry patterns', 'django.core.management', 0, 0, 45.0, ''),
        ('odd', 'migrations/0001_init.py', 'Migrations', 'Path indicates database migrations', False, None, '', '', 0, 0, 3.0, ''),
        ('odd', 'secret.py', 'Other', 'No strong structural signal', False, None, '', '', 0, 0, 0.0, ''),
        ('odd', 'src/__init__.py', 'Other', 'No strong structural signal', False, None, '', '', 0, 0, 0.0, ''),
        ('odd', 'src/pkg/__init__.py', 'Other', 'No strong structural signal', False, None, '', 'pkg.missing', 2, 2, 10.0, ''),
        ('odd', 'src/pkg/a.py', 'Other', 'No strong structural signal', False, None, '', 'far,json.decoder,toofar,unknown.place', 1, 3, 7.0, ''),
        ('odd', 'src/pkg/b.py', 'Entry Point', 'Detected as an entry point', False, 'high', 'Contains if __name__ == "__main__" block; Defines Click commands', 'click', 3, 0, 61.5, ''),
        ('odd', 'src/pkg/sub/__init__.py', 'Other', 'No strong structural signal', False, None, '', '', 1, 0, 4.0, ''),
        ('odd', 'src/pkg/sub/deep.py', 'Other', 'No strong structural signal', False, None, '', 'os.path', 0, 2, 2.0, ''),
        ('shop', 'src/shop/__init__.py', 'Other', 'No strong structural signal', False, None, '', '', 0, 0, 0.0, ''),
        ('shop', 'src/shop/api/__init__.py', 'API / Routes', 'Directory suggests API / routing layer', False, None, '', '', 0, 0, 12.0, ''),
        ('shop', 'src/shop/api/routes.py', 'Entry Point', 'Detected as an entry point', False, 'high', 'Defines a FastAPI application instance', 'fastapi,shop.models,shop.services', 1, 0, 50.5, ''),
        ('shop', 'src/shop/core/settings.py', 'Core / Domain', 'Directory suggests core / domain logic', False, None, '', '', 0, 0, 10.0, ''),
        ('shop', 'src/shop/main.py', 'Entry Point', 'Detected as an entry point', False, 'high', 'Filename matches common entry-point pattern (main.py); Contains if __name__ == "__main__" block; Calls uvicorn.run; Referenced by console script (shop.main:run)', 'shop.core', 0, 1, 47.5, ''),
        ('shop', 'src/shop/models/order.py', 'Models / Data', 'Directory suggests models / data access', False, None, '', 'dataclasses', 1, 0, 13.5, ''),
        ('shop', 'src/shop/services/orders.py', 'Services', 'Directory suggests service layer', False, None, '', '', 1, 2, 17.5, ''),
        ('shop', 'src/shop/utils/ids.py', 'Utilities', 'Directory suggests utilities', False, None, '', '', 1, 0, 9.5, ''),
        ('shop', 'tests/test_orders.py', 'Tests', 'Path or filename indicates a test module', True, None, '', '', 0, 1, 4.5, ''),
    )
)
def analysed_files(spark, sf):
    return bundle(spark).files.select("analysis_id", "path", "category", F.col("category_reasons")[0].alias("category_reason"), "is_test", "entrypoint_confidence", joined("entrypoint_reasons", "; "), joined("external_imports"), "incoming_count", "outgoing_count", "importance_score", joined("related_symbols"))


@query(
    literal(
        "analysis_id, path, nth, chunk_type, symbol_name, line_start, line_end, content, search_chars",
        ('broken', 'lib/thing.py', 0, 'module_overview', None, 1, 1, 'Imports:\nimport os\nimport sys', 42),
        ('odd', 'manage.py', 0, 'module_overview', None, 1, 3, 'Imports:\nfrom django.core.management import execute_from_command_line', 79),
        ('odd', 'manage.py', 1, 'module_level', None, 3, 3, 'execute_from_command_line()', 50),
        ('odd', 'migrations/0001_init.py', 0, 'module_overview', None, 1, 1, 'Module migrations/0001_init.py', 54),
        ('odd', 'migrations/0001_init.py', 1, 'module_level', None, 1, 1, 'x = 1', 42),
        ('odd', 'src/__init__.py', 0, 'module_overview', None, 1, 1, 'Imports:\nfrom . import pkg', 42),
        ('odd', 'src/pkg/__init__.py', 0, 'module_overview', None, 1, 2, 'Imports:\nfrom . import a, missing\nfrom .b import thing', 74),
        ('odd', 'src/pkg/a.py', 0, 'module_overview', None, 1, 6, 'Imports:\nimport pkg.b\nimport json.decoder\nfrom .. import far\nfrom ...toofar import x\nfrom pkg import b, nothing\nfrom pkg.sub import deep\nfrom unknown.place import *', 177),
        ('odd', 'src/pkg/b.py', 0, 'module_overview', None, 1, 35, 'Bee.\n\nImports:\nimport click\n\nSymbols: function:thing, async_function:later, class:Keeper', 101),
        ('odd', 'src/pkg/b.py', 1, 'module_level', None, 1, 35, '"""Bee."""\nimport click\n\nLIMIT = 3 if click else 4\n\n\n@click.command("go")\n@register[0].wrap\ndef thing(x):\n    """Do it."""\n    for y in x:\n        if y and not x or LIMIT:\n            continue\n    try:\n        return {z for z in x if z if y}\n    except ValueError:\n        pass\n\n\nasync def later():\n    while True:\n        match LIMIT:\n            case 1:\n                pass\n            case _:\n                pass\n\n\nclass Keeper(Base):\n    def inner(self):\n        return [w for w in self]\n\n\nif __name__ == "__main__":\n    thing([])', 562),
        ('odd', 'src/pkg/b.py', 2, 'function', 'thing', 9, 17, 'def thing(x):\n    """Do it."""\n    for y in x:\n        if y and not x or LIMIT:\n            continue\n    try:\n        return {z for z in x if z if y}\n    except ValueError:\n        pass', 204),
        ('odd', 'src/pkg/b.py', 3, 'async_function', 'later', 20, 26, 'async def later():\n    while True:\n        match LIMIT:\n            case 1:\n                pass\n            case _:\n                pass', 156),
        ('odd', 'src/pkg/b.py', 4, 'class', 'Keeper', 29, 31, 'class Keeper(Base):\n    def inner(self):\n        return [w for w in self]', 93),
        ('odd', 'src/pkg/sub/deep.py', 0, 'module_overview', None, 1, 3, 'Imports:\nfrom ..b import thing\nfrom ...pkg import a\nimport os.path', 86),
        ('shop', 'src/shop/api/__init__.py', 0, 'module_overview', None, 1, 1, 'API.', 29),
        ('shop', 'src/shop/api/__init__.py', 1, 'module_level', None, 1, 1, '"""API."""', 48),
        ('shop', 'src/shop/api/routes.py', 0, 'module_overview', None, 1, 7, 'Imports:\nfrom fastapi import FastAPI\nfrom shop.services import orders\nfrom ..models import order\n\nSymbols: function:build', 144),
        ('shop', 'src/shop/api/routes.py', 1, 'function', 'build', 6, 7, 'def build():\n    return FastAPI()', 62),
        ('shop', 'src/shop/core/settings.py', 0, 'module_overview', None, 1, 1, 'Module src/shop/core/settings.py', 58),
        ('shop', 'src/shop/core/settings.py', 1, 'module_level', None, 1, 1, 'DEBUG = True', 51),
        ('shop', 'src/shop/main.py', 0, 'module_overview', None, 1, 13, 'Start.\n\nImports:\nfrom shop.api.routes import build\nfrom .core import settings\n\nSymbols: function:run', 117),
        ('shop', 'src/shop/main.py', 1, 'module_level', None, 1, 13, '"""Start."""\nfrom shop.api.routes import build\nfrom .core import settings\n\n\ndef run():\n    import uvicorn\n\n    uvicorn.run(build())\n\n\nif __name__ == "__main__":\n    run()', 200),
        ('shop', 'src/shop/main.py', 2, 'function', 'run', 6, 9, 'def run():\n    import uvicorn\n\n    uvicorn.run(build())', 76),
        ('shop', 'src/shop/models/order.py', 0, 'module_overview', None, 1, 6, 'Imports:\nfrom dataclasses import dataclass\n\nSymbols: class:Order', 89),
        ('shop', 'src/shop/models/order.py', 1, 'class', 'Order', 5, 6, 'class Order:\n    id: int', 55),
        ('shop', 'src/shop/services/orders.py', 0, 'module_overview', None, 1, 7, 'Imports:\nimport shop.models.order\nfrom shop.utils.ids import fresh\n\nSymbols: class:Orders', 117),
        ('shop', 'src/shop/services/orders.py', 1, 'class', 'Orders', 5, 7, 'class Orders:\n    def all(self):\n        return [x for x in range(3) if x]', 109),
        ('shop', 'src/shop/utils/ids.py', 0, 'module_overview', None, 1, 2, 'Symbols: function:fresh', 45),
        ('shop', 'src/shop/utils/ids.py', 1, 'function', 'fresh', 1, 2, 'def fresh():\n    return 1', 53),
        ('shop', 'tests/test_orders.py', 0, 'module_overview', None, 1, 5, 'Imports:\nfrom shop.services.orders import Orders\n\nSymbols: function:test_all', 97),
        ('shop', 'tests/test_orders.py', 1, 'function', 'test_all', 4, 5, 'def test_all():\n    assert Orders().all()', 71),
    )
)
def analysed_chunks(spark, sf):
    return bundle(spark).chunks.select("analysis_id", "path", "nth", "chunk_type", "symbol_name", "line_start", "line_end", "content", F.length("search_text").alias("search_chars"))


@query(literal("analysis_id, path, size_bytes, kind, content_md5", *_archive_rows()))
def archive_files(spark, sf):
    return repos.checked_members(repos.archive_members(demo.archives(spark))).select("analysis_id", "path", "size_bytes", "kind", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    literal(
        "analysis_id, error_code, error_message",
        ('climbs', 'INVALID_ARCHIVE', 'Unsafe archive path rejected: owner-repo-sha/../up.py'),
        ('crowd', 'REPOSITORY_TOO_LARGE', 'Too many files in the archive.'),
        ('heavy', 'REPOSITORY_TOO_LARGE', 'Too many bytes in the archive.'),
        ('junk', 'INVALID_ARCHIVE', 'Downloaded archive is invalid or corrupt.'),
        ('links', 'INVALID_ARCHIVE', 'Archives containing symlinks are not allowed.'),
    )
)
def archive_failures(spark, sf):
    limits = Config(max_extracted_files=3, max_extracted_bytes=400)
    return repos.member_failures(repos.archive_members(demo.bad_archives(spark), limits), limits)


@query(
    literal(
        "analysis_id, readme_excerpt, scripts",
        ('odd', 'odd things\n', None),
        ('shop', '# shop\n', 'shop.main:run'),
    )
)
def repository_texts(spark, sf):
    kept, _ = repos.scan(demo.raw_files(spark).unionByName(demo.odd_files(spark)))
    scripts = repos.metadata_text(kept, "pyproject.toml").select("analysis_id", console_scripts("text").alias("scripts"))
    return repos.readme_excerpts(kept).join(scripts, "analysis_id", "full").select("analysis_id", "readme_excerpt", joined("scripts"))


@query(
    literal(
        "analysis_id, nth, fact",
        ('broken', 0, 'Python files: 2'),
        ('broken', 1, 'Internal edges: 0'),
        ('broken', 2, 'Entry points: []'),
        ('broken', 3, "Important files: ['lib/thing.py', 'tool.py']"),
        ('odd', 0, 'Python files: 9'),
        ('odd', 1, 'Internal edges: 7'),
        ('odd', 2, "Entry points: ['src/pkg/b.py', 'manage.py']"),
        ('odd', 3, "Important files: ['src/pkg/b.py', 'manage.py', 'src/pkg/__init__.py', 'src/pkg/a.py', 'src/pkg/sub/__init__.py', 'migrations/0001_init.py', 'src/pkg/sub/deep.py', 'secret.py']"),
        ('shop', 0, 'Python files: 9'),
        ('shop', 1, 'Internal edges: 4'),
        ('shop', 2, "Entry points: ['src/shop/api/routes.py', 'src/shop/main.py']"),
        ('shop', 3, "Important files: ['src/shop/api/routes.py', 'src/shop/main.py', 'src/shop/services/orders.py', 'src/shop/models/order.py', 'src/shop/api/__init__.py', 'src/shop/core/settings.py', 'src/shop/utils/ids.py', 'src/shop/__init__.py']"),
    )
)
def facts(spark, sf):
    from quarrymap.operators.summary import structural_facts

    b = bundle(spark)
    return structural_facts(b.statistics, b.files).select("analysis_id", F.posexplode("facts").alias("nth", "fact"))


# -- answers -------------------------------------------------------------------------------------

RETRIEVED = [("q1", "a.py", 1, 20, 2), ("q1", "a.py", 21, 40, 1), ("q1", "b.py", 1, 9, 3), ("q2", "a.py", 1, 20, 1)]
RAW = [
    ("q1", "r", '{"answer": " Yes. ", "confidence": "high", "citations": [{"file_path": "a.py", "line_start": 5, "line_end": 8, "reason": "why"}, "b.py", {"file_path": "gone.py", "line_start": 1, "line_end": 2}, {"file_path": "b.py", "line_start": 50, "line_end": 60}], "suggested_files": ["b.py", "gone.py"], "limitations": [" few ", ""]}'),
    ("q2", "r", '{"answer": "Sure.", "confidence": "high", "citations": ["gone.py"]}'),
    ("q3", "r", '{"answer": "  ", "confidence": "medium", "citations": [], "suggested_files": "a.py"}'),
    ("q4", "r", '{"answer": "Perhaps.", "citations": "a.py"}'),
]


@query(
    literal(
        "query_id, answer, confidence, limitations, citations, suggested_files",
        ("q1", "Yes.", "high", "few", "a.py:5-8 why; b.py:1-9 Referenced in evidence; b.py:50-60 Referenced in evidence", "b.py"),
        ("q2", answers.NO_ANSWER, "low", answers.NO_EVIDENCE, "", ""),
        ("q3", answers.NO_ANSWER, "low", answers.NO_EVIDENCE, "", "a.py"),
        ("q4", "Perhaps.", "low", "", "", ""),
    )
)
def answer_grounding(spark, sf):
    raw = spark.createDataFrame(RAW, "query_id string, analysis_id string, raw string")
    retrieved = spark.createDataFrame(RETRIEVED, "query_id string, path string, line_start int, line_end int, rank int")
    known = spark.createDataFrame([("r", "a.py"), ("r", "b.py")], "analysis_id string, path string")
    cited = F.transform("citations", lambda c: F.format_string("%s:%d-%d %s", c.file_path, c.line_start, c.line_end, c.reason))
    return answers.grounded_answers(raw, retrieved, known).select("query_id", "answer", "confidence", joined("limitations", "; "), F.array_join(cited, "; ").alias("citations"), joined("suggested_files"))


OVERVIEW = '{"project_purpose": "Sells.", "main_components": [{"name": "", "description": "core", "files": ["a.py", "gone.py"]}, {"name": "B", "files": ["b.py"]}], "execution_flow": ["one", "two"], "start_here": [{"file_path": "b.py", "reason": "small"}, {"file_path": "gone.py", "reason": "x"}, {"file_path": "a.py"}]}'


@query(
    literal(
        "nth, purpose, architecture, components, flow, start_here, caveats",
        (1, "Sells.", "", "Component|core|a.py; B||b.py", "one,two", "b.py small; a.py ", ""),
        (2, "", "", "", "", "", ""),
    )
)
def overview_grounding(spark, sf):
    rows = spark.createDataFrame([(1, OVERVIEW), (2, "{}")], "nth int, raw string")
    o = answers.valid_overview(F.col("raw"), F.array(F.lit("a.py"), F.lit("b.py")))
    parts = F.transform("o.main_components", lambda c: F.concat_ws("|", c["name"], c.description, F.array_join(c.files, ",")))
    first = F.transform("o.start_here", lambda s: F.concat_ws(" ", s.file_path, s.reason))
    return rows.withColumn("o", o).select(
        "nth", F.col("o.project_purpose").alias("purpose"), F.col("o.architecture_summary").alias("architecture"), F.array_join(parts, "; ").alias("components"),
        F.array_join("o.execution_flow", ",").alias("flow"), F.array_join(first, "; ").alias("start_here"), F.array_join("o.caveats", ",").alias("caveats"),
    )


# -- retrieval over the demonstration repository ---------------------------------------------------

QUESTIONS = [("q1", "shop", "Where does Orders use fresh ids in src/shop/services/orders.py?"), ("q2", "shop", "uvicorn"), ("q3", "odd", "What is thing")]


def _retrieved(spark: SparkSession, with_vectors: bool) -> DataFrame:
    b = bundle(spark)
    asked = spark.createDataFrame(QUESTIONS, "query_id string, analysis_id string, question string")
    vectors = None
    if with_vectors:
        # A chunk points along its number of lines; q2 looks for chunks of one line, q3 for long ones.
        lines = F.col("line_end") - F.col("line_start") + 1
        placed = b.chunks.withColumn("embedding", F.array(F.lit(1.0), lines.cast("double")))
        wanted = asked.join(spark.createDataFrame([("q2", [1.0, 1.0]), ("q3", [0.0, 1.0])], "query_id string, embedding array<double>"), "query_id")
        vectors = retrieval.vector_scores(placed, wanted, k=3)
    return retrieval.hybrid_retrieve(b.chunks, b.files, b.edges, asked, vectors, limit=6)


@query()
def hybrid_lexical_demo(spark, sf):
    return _retrieved(spark, False).select("query_id", "rank", "path", "symbol_name", "line_start", "line_end", F.round("score", 6).alias("score"), joined("reasons"))


@query(
    literal(
        "query_id, rank, path, symbol_name, line_start, line_end, score, reasons",
        ("q1", 1, "src/shop/services/orders.py", "Orders", 5, 7, 1.4, "exact_symbol,exact_path"),
        ("q1", 2, "src/shop/services/orders.py", None, 1, 7, 1.25, "exact_path"),
        ("q1", 3, "src/shop/api/routes.py", None, 1, 7, 0.35, ""),
        ("q1", 4, "src/shop/main.py", None, 1, 13, 0.35, "graph_neighbor"),
        ("q1", 5, "src/shop/main.py", None, 1, 13, 0.35, "graph_neighbor"),
        ("q1", 6, "src/shop/main.py", "run", 6, 9, 0.35, "graph_neighbor"),
        ("q2", 1, "src/shop/api/__init__.py", None, 1, 1, 1.0, ""),
        ("q2", 2, "src/shop/core/settings.py", None, 1, 1, 1.0, ""),
        ("q2", 3, "src/shop/core/settings.py", None, 1, 1, 1.0, ""),
        ("q2", 4, "src/shop/api/routes.py", None, 1, 7, 0.35, "graph_neighbor"),
        ("q2", 5, "src/shop/api/routes.py", "build", 6, 7, 0.35, "graph_neighbor"),
        ("q2", 6, "src/shop/main.py", None, 1, 13, 0.15, ""),
        ("q3", 1, "src/pkg/b.py", None, 1, 35, 1.149592, ""),
        ("q3", 2, "src/pkg/b.py", None, 1, 35, 1.149592, ""),
        ("q3", 3, "src/pkg/b.py", "thing", 9, 17, 1.143884, ""),
        ("q3", 4, "src/pkg/__init__.py", None, 1, 2, 0.15, ""),
        ("q3", 5, "src/pkg/a.py", None, 1, 6, 0.15, ""),
        ("q3", 6, "src/pkg/sub/deep.py", None, 1, 3, 0.15, ""),
    )
)
def hybrid_vector_demo(spark, sf):
    return _retrieved(spark, True).select("query_id", "rank", "path", "symbol_name", "line_start", "line_end", F.round("score", 6).alias("score"), joined("reasons"))


@query()
def explain_evidence(spark, sf):
    b = bundle(spark)
    chosen = spark.createDataFrame([("shop", "src/shop/services/orders.py"), ("odd", "src/pkg/b.py")], "analysis_id string, path string")
    return answers.explain_chunks(b.files, b.chunks, b.edges, chosen).select("analysis_id", "selected", "rank", "path", "chunk_type", "symbol_name", "score")


@query()
def impact_demo(spark, sf):
    b = bundle(spark)
    found = graph.change_impact(b.files, b.edges, b.files.select("analysis_id", "path"))
    return found.select("analysis_id", "selected_path", joined("direct_dependents"), joined("second_level_dependents"), joined("related_tests"), joined("affected_entry_points"), F.array_join(F.transform("representative_paths", lambda p: F.array_join(p, " ")), "; ").alias("representative_paths"))


@query()
def scan_limits(spark, sf):
    limits = Config(max_file_bytes=120, max_extracted_files=6)
    kept, warnings = repos.scan(demo.raw_files(spark).unionByName(demo.odd_files(spark)), limits)
    seen = kept.select("analysis_id", F.col("path").alias("item"), F.col("scan_order").cast("int").alias("nth"), F.lit("kept").alias("outcome"))
    return seen.unionByName(warnings.select("analysis_id", F.col("warning").alias("item"), F.col("nth").cast("int").alias("nth"), F.lit("warning").alias("outcome")))


@pytest.mark.parametrize("name", list(QUERIES))
def test_demonstration(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = QUERIES[name](spark, "")
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert rows
    if name in ORACLES:
        result = duckdb.connect().execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert normal(rows) == normal([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
