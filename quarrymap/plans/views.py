"""The tables of an analysis for users of Spark SQL: temporary views, and the parser as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarrymap.operators.parsing import parse_source
from quarrymap.plans.analysis import Bundle

VIEWS = ("files", "edges", "chunks", "statistics", "warnings", "readmes")


def register_views(bundle: Bundle, prefix: str = "") -> list[str]:
    """Temporary views <prefix>files, <prefix>edges and so on; returns their names."""
    for name in VIEWS:
        getattr(bundle, name).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in VIEWS]


@udtf(returnType="name string, kind string, line_start int, line_end int, decorators array<string>, docstring string")
class SymbolsOf:
    """Top-level functions and classes of a source text; none for null or broken texts.

    For ad hoc queries, as in `SELECT path, s.* FROM sources, LATERAL symbols_of(content) s`: rows cross to
    Python one by one. Whole tables go through `operators.parsing.parse_files`, in Arrow batches.
    """

    def eval(self, source: str) -> Iterator[tuple]:
        for s in parse_source(source or "")["symbols"]:
            yield s["name"], s["kind"], s["line_start"], s["line_end"], s["decorators"], s["docstring"]


def register_functions(spark: SparkSession) -> None:
    """Makes `symbols_of` known to Spark SQL in this session."""
    spark.udtf.register("symbols_of", SymbolsOf)
