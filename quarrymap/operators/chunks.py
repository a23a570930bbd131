"""Retrieval chunks of parsed files: an overview, the module level, and windows of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.text import looks_like_secret, slice_lines

OVERVIEW_IMPORTS, OVERVIEW_LINES = 40, 40


def windows(start: Column, end: Column, size: int) -> Column:
    """array<struct(line_start, line_end)> of tumbling windows over start..end."""
    return F.transform(F.sequence(start, end, F.lit(size)), lambda s: F.struct(s.alias("line_start"), F.least(s + (size - 1), end).alias("line_end")))


def overview(path: Column, docstring: Column, imports: Column, symbols: Column) -> Column:
    raws = F.transform(F.slice(imports, 1, OVERVIEW_IMPORTS), lambda i: i.raw)
    named = F.transform(symbols, lambda s: F.concat(s.kind, F.lit(":"), s["name"]))
    parts = F.array_compact(
        F.array(
            F.when(docstring != "", docstring),
            F.when(F.size(raws) > 0, F.concat(F.lit("Imports:\n"), F.array_join(raws, "\n"))),
            F.when(F.size(named) > 0, F.concat(F.lit("Symbols: "), F.array_join(named, ", "))),
        )
    )
    text = F.trim(F.array_join(parts, "\n\n"), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(text != "", text).otherwise(F.concat(F.lit("Module "), path))


def chunk_files(parsed: DataFrame, chunk_lines: int = 120) -> DataFrame:
    """Chunks of files that parsed, aren't empty and hold no secret."""
    good = parsed.filter((F.col("parse_status") == "ok") & (F.col("content") != "") & ~looks_like_secret(F.col("content")))
    null = F.lit(None).cast("string")
    made = lambda kind, name, start, end, content, tag: F.struct(
        kind.alias("chunk_type"), name.alias("symbol_name"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), content.alias("content"),
        F.concat_ws("\n", F.col("path"), tag, content).alias("search_text"),
    )
    lines = F.col("lines")
    head = made(F.lit("module_overview"), null, F.lit(1), F.greatest(F.least(F.size(lines), F.lit(OVERVIEW_LINES)), F.lit(1)), overview(*map(F.col, ("path", "docstring", "imports", "symbols"))), null)
    start, end = F.col("module_level_start"), F.col("module_level_end")
    level = F.when(start.isNotNull(), made(F.lit("module_level"), null, start, end, slice_lines(lines, start, end), F.lit("module_level")))
    symbol_chunks = F.flatten(F.transform("symbols", lambda s: F.transform(windows(s.line_start, s.line_end, chunk_lines), lambda w: made(s.kind, s["name"], w.line_start, w.line_end, slice_lines(lines, w.line_start, w.line_end), s["name"]))))
    every = F.array_compact(F.concat(F.array(head), F.array(level), symbol_chunks))
    rows = good.select("analysis_id", "path", F.posexplode(every).alias("nth", "c")).select("analysis_id", "path", "nth", "c.*")
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("\0", "analysis_id", "path", F.col("nth").cast("string")), 256))
