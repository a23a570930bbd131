"""AST extraction: the one step that needs Python on the workers. Source is never executed."""

from __future__ import annotations

import ast
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrymap.functions.text import line_count
from quarrymap.schemas import IMPORT, PARSED, SYMBOL

# Text needles of framework hints, in reporting order, and call names that hint the same.
HINT_NEEDLES = [
    ("FastAPI(", "fastapi_app"),
    ("Flask(", "flask_app"),
    ("Typer(", "typer_app"),
    ("uvicorn.run(", "uvicorn_run"),
    ("click.command", "click_command"),
    ("django.core.management", "django_management"),
    ("get_asgi_application", "django_asgi"),
    ("get_wsgi_application", "django_wsgi"),
]
HINT_CALLS = {"FastAPI": "fastapi_app", "Flask": "flask_app", "Typer": "typer_app"}
KINDS = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}


def dotted(node: ast.AST) -> str:
    """Name of a decorator or callee: dotted where it is names and attributes, else its node class."""
    tail: list[str] = []
    while True:
        match node:
            case ast.Call():
                node = node.func
            case ast.Attribute():
                tail.append(node.attr)
                node = node.value
            case ast.Name():
                return ".".join([node.id, *reversed(tail)])
            case _:
                return ".".join([type(node).__name__, *reversed(tail)])


def branching(node: ast.AST) -> int:
    """What one node adds to the complexity estimate."""
    match node:
        case ast.If() | ast.For() | ast.AsyncFor() | ast.While() | ast.ExceptHandler() | ast.IfExp():
            return 1
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.Match():
            return len(node.cases)
        case ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp():
            return 1 + sum(bool(g.ifs) for g in node.generators)
    return 0


def imports_of(body: list[ast.stmt]) -> list[dict]:
    """Top-level imports: a record per alias of `import`, one per `from` statement."""
    found = []
    for s in body:
        if isinstance(s, ast.Import):
            found += [dict(module=a.name, names=[a.asname or a.name.rpartition(".")[2]], level=0, line_number=s.lineno, is_from=False, raw=f"import {a.name}") for a in s.names]
        elif isinstance(s, ast.ImportFrom):
            level = s.level or 0
            raw = f"from {'.' * level}{s.module or ''} import {', '.join(a.name for a in s.names)}"
            found.append(dict(module=s.module, names=[a.asname or a.name for a in s.names], level=level, line_number=s.lineno, is_from=True, raw=raw))
    return found


def symbols_of(body: list[ast.stmt]) -> list[dict]:
    """Top-level functions and classes."""
    return [
        dict(name=s.name, kind=KINDS[type(s)], line_start=s.lineno, line_end=s.end_lineno or s.lineno, decorators=[dotted(d) for d in s.decorator_list], docstring=ast.get_docstring(s))
        for s in body
        if type(s) in KINDS
    ]


def is_main_block(s: ast.stmt) -> bool:
    match s:
        case ast.If(test=ast.Compare(left=ast.Name(id="__name__"), ops=[ast.Eq()], comparators=[ast.Constant(value="__main__")])):
            return True
    return False


def parse_source(source: str) -> dict:
    """Everything that needs the tree. Any failure is this file's alone."""
    empty = dict(parse_status="error", parse_warning=None, docstring=None, estimated_complexity=0, has_main_block=False, call_hints=[], module_level_start=None, module_level_end=None, imports=[], symbols=[])
    try:
        tree = ast.parse(source)
        rest = [s for s in tree.body if not isinstance(s, (*KINDS, ast.Import, ast.ImportFrom))]
        # Imports hold names only.
        nodes = list(ast.walk(ast.Module([s for s in tree.body if not isinstance(s, (ast.Import, ast.ImportFrom))], [])))
        calls = [dotted(n.func) for n in nodes if isinstance(n, ast.Call)]
        return dict(
            parse_status="ok",
            parse_warning=None,
            docstring=ast.get_docstring(tree),
            estimated_complexity=sum(map(branching, nodes)),
            has_main_block=any(map(is_main_block, tree.body)),
            call_hints=[hint for c in calls for name, hint in HINT_CALLS.items() if c.endswith(name)],
            module_level_start=min((s.lineno for s in rest), default=None),
            module_level_end=max((s.end_lineno or s.lineno for s in rest), default=None),
            imports=imports_of(tree.body),
            symbols=symbols_of(tree.body),
        )
    except SyntaxError as e:
        return empty | dict(parse_warning=f"SyntaxError: {e.msg} (line {e.lineno})")
    except (ValueError, RecursionError, MemoryError) as e:
        return empty | dict(parse_warning=f"{type(e).__name__}: {e}")


ROWS = 500  # files that are trees at a time
TREE = f"parse_status string, parse_warning string, docstring string, estimated_complexity int, has_main_block boolean, call_hints array<string>, module_level_start int, module_level_end int, imports array<{IMPORT}>, symbols array<{SYMBOL}>"


def parse_files(files: DataFrame) -> DataFrame:
    """PARSED rows of Python files (analysis_id, path, kind, content); other kinds are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                own = [part.column(c).to_pylist() for c in ("analysis_id", "path", "content")]
                sources = [c or "" for c in own[2]]
                trees = [parse_source(c) for c in sources]
                columns = [*own, [c.splitlines() for c in sources], *([t[n] for t in trees] for n in made.names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    made = to_arrow_schema(T.StructType.fromDDL(TREE))
    schema = f"analysis_id string, path string, content string, lines array<string>, {TREE}"
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    trees = files.filter("kind = 'python'").select("analysis_id", "path", "content").mapInArrow(run, schema)
    source = F.coalesce(F.col("content"), F.lit(""))
    hints = F.array_compact(F.array(*(F.when(source.contains(n), hint) for n, hint in HINT_NEEDLES)))
    hints = F.when(F.col("parse_status") == "ok", F.array_distinct(F.concat(hints, "call_hints"))).otherwise(F.array().cast("array<string>"))
    rows = trees.withColumns({"framework_hints": hints, "line_count": line_count(source)})
    return rows.select(*(c.strip().split(" ")[0] for c in PARSED_COLUMNS), "content")


PARSED_COLUMNS = ["analysis_id", "path", "parse_status", "parse_warning", "docstring", "line_count", "estimated_complexity", "has_main_block", "framework_hints", "module_level_start", "module_level_end", "imports", "symbols", "lines"]
assert all(f"{c} " in PARSED for c in PARSED_COLUMNS)


@F.pandas_udf(T.ArrayType(T.StringType()))
def console_scripts(text: pd.Series) -> pd.Series:
    """Distinct script targets of pyproject texts, sorted; none where the text is missing or broken."""

    def targets(toml: str | None) -> list[str]:
        try:
            data = tomllib.loads(toml or "")
            tables = [(data.get("project") or {}).get("scripts"), ((data.get("tool") or {}).get("poetry") or {}).get("scripts")]
            return sorted({v for t in tables if isinstance(t, dict) for v in t.values() if isinstance(v, str)})
        except (tomllib.TOMLDecodeError, AttributeError):
            return []

    return text.map(targets)
