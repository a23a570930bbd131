"""The whole analysis of many repositories in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.config import Config
from quarrymap.functions.paths import is_test_path, module_name
from quarrymap.operators import chunks as chunking
from quarrymap.operators import classify, graph, modules, summary
from quarrymap.operators.parsing import console_scripts, parse_files
from quarrymap.operators.staging import written
from quarrymap.sources.repositories import metadata_text, readme_excerpts, scan


@dataclass(frozen=True)
class Bundle:
    """Tables of an analysis over `parsed`, which is written. Imports are resolved, and written, when a table first needs them."""

    parsed: DataFrame
    kept: DataFrame
    scan_warnings: DataFrame
    config: Config

    @cached_property
    def resolved(self) -> DataFrame:
        return written(modules.resolve_imports(modules.import_rows(self.parsed), modules.module_map(self.parsed)), "resolved")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.dependency_edges(self.resolved)

    @cached_property
    def chunks(self) -> DataFrame:
        return chunking.chunk_files(self.parsed, self.config.chunk_lines)

    @cached_property
    def statistics(self) -> DataFrame:
        return summary.statistics(self.files, self.edges, self.chunks)

    @cached_property
    def warnings(self) -> DataFrame:
        own = self.files.filter("parse_warning IS NOT NULL").select("analysis_id", F.concat_ws(": ", "path", "parse_warning").alias("warning"))
        return self.scan_warnings.select("analysis_id", "warning").unionByName(own)

    @cached_property
    def readmes(self) -> DataFrame:
        return readme_excerpts(self.kept)

    @cached_property
    def files(self) -> DataFrame:
        key = ["analysis_id", "path"]
        none = F.array().cast("array<string>")
        scripts = metadata_text(self.kept, "pyproject.toml").select("analysis_id", console_scripts("text").alias("scripts"))
        rows = self.parsed.join(modules.external_imports(self.resolved), key, "left").join(classify.script_targets(self.parsed, scripts), key, "left").join(graph.degrees(self.parsed, self.edges), key)
        script = F.when(F.col("target").isNotNull(), F.array("target")).otherwise(none)
        names = F.transform("symbols", lambda s: s["name"])
        path = F.col("path")
        rows = rows.withColumns({"external_imports": F.coalesce("external_imports", none), "entrypoint_reasons": classify.entry_reasons(path, F.col("has_main_block"), F.col("framework_hints"), names, script)})
        rows = rows.withColumn("is_entry_point", F.size("entrypoint_reasons") > 0)
        rows = rows.withColumn("arm", classify.classify(path, F.col("is_entry_point"), F.col("symbols"), F.col("external_imports")))
        degree = F.col("incoming_count"), F.col("outgoing_count"), F.col("is_entry_point")
        category = F.col("arm.category")
        return rows.select(
            "analysis_id",
            F.sha2(F.concat_ws("\0", "analysis_id", "path"), 256).alias("file_id"),
            "path",
            module_name(path).alias("module_name"),
            category.alias("category"),
            F.array("arm.reason").alias("category_reasons"),
            "line_count",
            "estimated_complexity",
            classify.importance(*degree, F.size("symbols"), category).alias("importance_score"),
            classify.importance_sentence(*degree, category).alias("importance_reason"),
            "incoming_count",
            "outgoing_count",
            is_test_path(path).alias("is_test"),
            "is_entry_point",
            classify.entry_confidence(path, F.col("entrypoint_reasons")).alias("entrypoint_confidence"),
            "entrypoint_reasons",
            "parse_status",
            "parse_warning",
            "docstring",
            "symbols",
            "external_imports",
            F.when(F.col("is_entry_point"), classify.related_symbols(names)).otherwise(none).alias("related_symbols"),
        )

    def entry_points(self) -> DataFrame:
        return self.files.filter("is_entry_point").select("analysis_id", "path", "entrypoint_confidence", "entrypoint_reasons", "category")

    def important_files(self) -> DataFrame:
        return summary.important_files(self.files)

    def start_here(self) -> DataFrame:
        return summary.start_here(self.files)

    def category_counts(self) -> DataFrame:
        return summary.category_counts(self.files)

    def impact(self, selected: DataFrame) -> DataFrame:
        return graph.change_impact(self.files, self.edges, selected)


def analyze(raw: DataFrame, config: Config = Config()) -> Bundle:
    """RAW_FILES in, tables out; every step is keyed by analysis_id."""
    kept, scan_warnings = scan(raw, config)
    return Bundle(written(parse_files(kept), "parsed"), kept, scan_warnings, config)
