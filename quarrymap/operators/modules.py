"""Module names of files and resolution of imports, as joins.

Files are compared by path components, so `a/__init__.py` comes before `a.py` and owns module `a`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.paths import module_name, parts

HIGH, LOW = "high", "low"
# Why an import has no internal target.
NO_SOURCE_MODULE = "relative_import_without_source_module"
LEVEL_TOO_HIGH = "relative_level_too_high"
EXTERNAL = "external_or_unresolved"


def module_map(files: DataFrame) -> DataFrame:
    """(analysis_id, module, path): the first file of each module."""
    named = files.select("analysis_id", "path", module_name(F.col("path")).alias("module")).filter("module IS NOT NULL")
    return named.groupBy("analysis_id", "module").agg(F.min_by("path", parts(F.col("path"))).alias("path"))


def import_rows(parsed: DataFrame) -> DataFrame:
    """One row per import statement or alias: source_path, nth and the fields of the import."""
    exploded = parsed.select("analysis_id", F.col("path").alias("source_path"), F.posexplode("imports").alias("nth", "i"))
    return exploded.select("analysis_id", "source_path", "nth", F.col("i.module").alias("module"), F.col("i.names").alias("names"), F.col("i.level").alias("level"), F.col("i.line_number").alias("line_number"), F.col("i.is_from").alias("is_from"))


def packages(source_path: Column, level: Column) -> tuple[Column, Column, Column]:
    """(source module, whether the level is too high, parts of the package a relative import starts from)."""
    own = module_name(source_path)
    split = F.split(own, r"\.")
    base = F.when(source_path.endswith("__init__.py"), split).otherwise(F.slice(split, F.lit(1), F.size(split) - 1))
    keep = F.size(base) - (level - 1)
    return own, level > F.size(base) + 1, F.slice(base, F.lit(1), F.greatest(keep, F.lit(0)))


def candidates(imports: DataFrame) -> DataFrame:
    """Imports with the targets to look up first: the statement's own module, or each name of `from . import`.

    below: whether it is a `from` import that may mean submodules if its own module has no target.
    reason: set if nothing is looked up.
    """
    level, module, names = F.coalesce(F.col("level"), F.lit(0)), F.coalesce(F.col("module"), F.lit("")), F.col("names")
    own, too_high, package = packages(F.col("source_path"), level)
    made = lambda m, n: F.struct(m.alias("module"), n.alias("names"))
    joined = lambda head, tail: F.array_join(F.concat(head, F.array(tail)), ".")
    siblings = F.transform(names, lambda n: made(joined(package, n), F.array(n)))
    reason = F.when((level > 0) & own.isNull(), NO_SOURCE_MODULE).when((level > 0) & too_high, LEVEL_TOO_HIGH)
    tries = F.when(reason.isNotNull() | (level == 0), F.array(made(module, names))).when(module != "", F.array(made(joined(package, module), names))).otherwise(siblings)
    below = (level == 0) & F.col("is_from")
    rows = imports.select("analysis_id", "source_path", "nth", "line_number", reason.alias("reason"), below.alias("below"), F.posexplode(tries).alias("try", "t"))
    return rows.select("analysis_id", "source_path", "nth", "line_number", "reason", "below", "try", "t.*")


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """One row per resolved target, or per statement (name of `from . import`) without one.

    Every statement is looked up once by its own module; only those that miss, and may mean submodules, are looked
    up by their names, and only these are gathered again.
    """
    known = modules.withColumnRenamed("path", "target_path")
    looked = candidates(imports).withColumn("sought", F.when(F.col("reason").isNull(), F.col("module")))
    looked = looked.join(known.withColumnRenamed("module", "sought"), ["analysis_id", "sought"], "left").drop("sought")
    again = F.col("target_path").isNull() & F.coalesce(F.col("below"), F.lit(False)) & (F.size("names") > 0)
    submodule = lambda n: F.struct(F.when(F.col("module") != "", F.concat("module", F.lit("."), n)).otherwise(n).alias("module"), F.array(n).alias("names"))
    columns = ["analysis_id", "source_path", "nth", "try", "module", "names", "line_number", "target_path", "reason"]
    key = ["analysis_id", "source_path", "nth"]
    named = looked.filter(again).select(*key, "line_number", "reason", F.struct("module", "names").alias("whole"), F.posexplode(F.transform("names", submodule)).alias("at", "b"))
    named = named.select("*", F.col("b.module").alias("below_module")).join(known.withColumnRenamed("module", "below_module"), ["analysis_id", "below_module"], "left")
    hit = F.when(F.col("target_path").isNotNull(), F.struct((F.col("at") + 1).alias("try"), F.col("b.module").alias("module"), F.col("b.names").alias("names"), "target_path"))
    tried = named.groupBy(*key).agg(F.collect_list(hit).alias("hits"), F.any_value("line_number").alias("line_number"), F.any_value("reason").alias("reason"), F.any_value("whole").alias("whole"))
    missed = F.array(F.struct(F.lit(0).alias("try"), F.col("whole.module").alias("module"), F.col("whole.names").alias("names"), F.lit(None).cast("string").alias("target_path")))
    below = tried.select(*key, "line_number", "reason", F.explode(F.when(F.size("hits") > 0, F.col("hits")).otherwise(missed)).alias("t")).select(*key, "line_number", "reason", "t.*")
    rows = looked.filter(~again).select(*columns).unionByName(below.select(*columns))
    internal = F.col("target_path").isNotNull()
    return rows.select(
        *key,
        "try",
        F.col("module").alias("imported_module"),
        F.col("names").alias("imported_names"),
        "line_number",
        "target_path",
        internal.alias("is_internal"),
        F.when(internal, HIGH).otherwise(LOW).alias("confidence"),
        F.when(~internal, F.coalesce("reason", F.lit(EXTERNAL))).alias("unresolved_reason"),
    )


def external_imports(resolved: DataFrame) -> DataFrame:
    """(analysis_id, path, external_imports): sorted distinct modules without an internal target."""
    outside = resolved.filter(~F.col("is_internal") & (F.col("imported_module") != ""))
    return outside.groupBy("analysis_id", F.col("source_path").alias("path")).agg(F.array_sort(F.collect_set("imported_module")).alias("external_imports"))
