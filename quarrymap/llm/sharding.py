"""Sharding (operator 13): k-d tree partitioning by bytes, in DataFrame functions only.

The root holds all rows and stands for `shards` leaves. A node of k > 1 leaves is cut in two, of k // 2 and the
other leaves, at the weighted median (the k // 2 : k - k // 2 quantile of bytes) along its widest metadata
dimension - the one whose values span the largest share of the whole table's span. Rows are ordered
by (value, text hash, row number), which is unique, so a cut exists however many rows share a value. Copies of a
text all take the least metadata among them, so they lie side by side and stay in one shard, unless they weigh
more than the slack together and a cut has to fall between them.

A weighted median is found by histograms: all nodes of a level at once, the interval that holds the cut is
divided into `BUCKETS` parts, whose bytes one aggregation sums (combined before the shuffle); the part that the
cut falls in is the next interval, until it holds one value - then the next key of the order follows - or weighs
at most the slack. Rows are never sorted, moved or gathered for it: only the slim table (keys, size,
metadata) is read again, and what a level or a histogram sends to the driver is one row per node, at most one
per shard. A level's assignment is a join with its cuts, again at most one row per shard, and is written as
a table, so lineage stays short.

Slots number the rows of a shard by (part, row number), where a shard's rows are dealt over hash parts of about
`PART_ROWS` rows; prefix sums over the parts' counts make them gapless without a window over a whole shard.

Law `bytes`: a cut misses its goal by at most half of the row (or the group within the slack) that it falls in, and
each node's goal is set from its own bytes, so misses don't add up over unrelated branches. A row heavier than
a shard's share makes its shard that heavy.

Defined cases: null and empty texts weigh `OVERHEAD` bytes, and their hash is 0; null metadata counts as the
least value; a dimension of one value is never cut, and without any other only hash and row number decide; repeated
rows are rows of their own, with slots of their own; with fewer rows than shards some shards are empty; an empty
table gives no rows; the input's other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.llm.common import materialize

OVERHEAD = 16  # bytes that a row costs besides its text
BUCKETS = 4096  # parts of an interval, of each node
SLACK = 0.01  # of a shard's share of bytes; a group as light as that is not cut
PART_ROWS, LEAST_PARTS = 20_000, 8


def metadata(df: DataFrame, lang: str = "lang", source: str = "source", chars: str = "n_chars") -> list[Column]:
    """Dimensions of documents: language and source by hash, and length; integers, null where unknown."""
    spread = [F.crc32(F.col(c).cast("string").cast("binary")) for c in (lang, source) if c in df.columns]
    return spread + [F.col(c).cast("long") for c in (chars,) if c in df.columns]


def literal_table(spark: SparkSession, rows: list[dict[str, int]], names: list[str]) -> DataFrame:
    """A table of long columns from at most one row per shard."""
    values = ", ".join("(" + ", ".join(f"{int(r[n])}L" for n in names) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def pick(columns: list[str], by: str) -> Column:
    """The column that number `by` names."""
    out = F.lit(None).cast("long")
    for k in range(len(columns) - 1, -1, -1):
        out = F.when(F.col(by) == k, F.col(columns[k])).otherwise(out)
    return out


def widest(nodes: DataFrame, dims: list[str], whole: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Of every node: its bytes, its widest dimension and the interval of that dimension."""
    found = nodes.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(c).alias(f"{c}_{n}") for c in dims for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    out = []
    for r in found:
        spans = [(r[f"{c}_hi"] - r[f"{c}_lo"]) / max(1, hi - lo) for c, (lo, hi) in zip(dims, whole)]
        best = max(range(len(dims)), key=lambda k: (spans[k], -k)) if dims else 0
        out.append({"node": r["node"], "bytes": int(r["bytes"]), "dim": best, "lo": r[f"{dims[best]}_lo"] if dims else 0, "hi": r[f"{dims[best]}_hi"] if dims else 0})
    return out


class Cut:
    """The search for one node's cut: the interval of one key, with the keys before it fixed."""

    def __init__(self, node: dict[str, int], leaves: int):
        self.node, self.dim, self.left = node["node"], node["dim"], leaves // 2
        self.goal = node["bytes"] * self.left / leaves
        self.stage, self.lo, self.hi, self.below = 0, node["lo"], node["hi"], 0
        self.fixed = [0, 0, 0]  # the cut: rows whose keys are at most these go left
        self.done = False

    def row(self) -> dict[str, int]:
        lo, hi = (0, 0) if self.lo is None else (self.lo, self.hi)
        return {"node": self.node, "dim": self.dim, "stage": self.stage, "lo": lo, "hi": hi, "width": -(-(hi - lo + 1) // BUCKETS), "f0": self.fixed[0], "f1": self.fixed[1], "goal": math.ceil(self.goal) - self.below}

    def end(self, stage: int, value: int) -> None:
        """Rows up to `value` in this key go left, whatever their later keys."""
        self.fixed[stage:] = [value, *[(1 << 62)] * (2 - stage)]
        self.done = True

    def take(self, before: int, weight: int, first: int, last: int, slack: float) -> None:
        """The cut falls in a bucket of `weight` bytes after `before` bytes of the interval, whose values run from first to last."""
        goal = self.goal - self.below
        if weight <= slack or (first == last and self.stage == 2):
            self.end(self.stage, last if goal - before >= before + weight - goal else first - 1)
            return
        self.below += before
        if first == last:
            self.fixed[self.stage] = first
            self.stage += 1
            self.lo, self.hi = None, None
        else:
            self.lo, self.hi = first, last


def find_cuts(nodes: DataFrame, dims: list[str], cuts: list[Cut], slack: float) -> None:
    """Narrow the intervals of all cuts together until each is decided."""
    spark = nodes.sparkSession
    value = pick(dims, "dim") if dims else F.lit(0).cast("long")
    while open_cuts := {c.node: c for c in cuts if not c.done}:
        fresh = {n: c for n, c in open_cuts.items() if c.lo is None}  # the interval of their next key comes first
        table = literal_table(spark, [c.row() for c in (fresh or open_cuts).values()], ["node", "dim", "stage", "f0", "f1", "lo", "hi", "width", "goal"])
        inside = nodes.join(F.broadcast(table), "node").withColumn("value", value)
        inside = inside.filter(((F.col("stage") < 1) | (F.col("value") == F.col("f0"))) & ((F.col("stage") < 2) | (F.col("hash") == F.col("f1"))))
        inside = inside.withColumn("at", F.when(F.col("stage") == 0, F.col("value")).when(F.col("stage") == 1, F.col("hash")).otherwise(F.col("row")))
        if fresh:
            for r in inside.groupBy("node").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect():
                fresh[r["node"]].lo, fresh[r["node"]].hi = r["lo"], r["hi"]
            continue
        inside = inside.filter(F.col("at").between(F.col("lo"), F.col("hi")))
        bucket = F.expr("(at - lo) div width")
        parts = inside.groupBy("node", "goal", bucket.alias("bucket")).agg(F.sum("size").alias("weight"), F.min("at").alias("first"), F.max("at").alias("last"))
        order = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most BUCKETS rows
        parts = parts.withColumn("upto", F.sum("weight").over(order)).filter(F.col("upto") >= F.col("goal"))
        hit = parts.groupBy("node").agg(F.min_by(F.struct("upto", "weight", "first", "last"), "bucket").alias("b"))
        for r in hit.collect():
            b = r["b"]
            open_cuts[r["node"]].take(int(b["upto"] - b["weight"]), int(b["weight"]), b["first"], b["last"], slack)


def grow(rows: DataFrame, dims: list[str], shards: int, slack: float = SLACK) -> DataFrame:
    """`rows` (hash, row, size, dimensions) with `shard`, the number of their leaf."""
    nodes = rows.withColumn("node", F.lit(0).cast("long"))
    total, *ends = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), *(f(c) for c in dims for f in (F.min, F.max))).first()
    whole = list(zip(ends[::2], ends[1::2]))
    open_leaves, share = {0: shards}, slack * total / shards  # a node's number is its first shard's
    while total and any(k > 1 for k in open_leaves.values()):
        inner = nodes.filter(F.col("node").isin([n for n, k in open_leaves.items() if k > 1]))
        cuts = [Cut(n, open_leaves[n["node"]]) for n in widest(inner, dims, whole)]
        if not cuts:
            break
        find_cuts(inner, dims, cuts, share)
        table = literal_table(rows.sparkSession, [{"node": c.node, "dim": c.dim, "left": c.left, "f0": c.fixed[0], "f1": c.fixed[1], "f2": c.fixed[2]} for c in cuts], ["node", "dim", "left", "f0", "f1", "f2"])
        value = F.coalesce(pick(dims, "dim"), F.lit(0)) if dims else F.lit(0)
        goes_left = (value < F.col("f0")) | ((value == F.col("f0")) & ((F.col("hash") < F.col("f1")) | ((F.col("hash") == F.col("f1")) & (F.col("row") <= F.col("f2")))))
        nodes = nodes.join(F.broadcast(table), "node", "left").withColumn("node", F.when(F.col("left").isNull() | goes_left, F.col("node")).otherwise(F.col("node") + F.col("left")))
        nodes = materialize(nodes.drop("dim", "left", "f0", "f1", "f2"), "shard-nodes")
        split = {c.node: c.left for c in cuts}
        open_leaves = {n: k for old, leaves in open_leaves.items() for n, k in (((old, split[old]), (old + split[old], leaves - split[old])) if old in split else ((old, 1),))}
    return nodes.withColumnRenamed("node", "shard")


def with_slots(placed: DataFrame, count: int, shards: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in every shard."""
    parts = max(LEAST_PARTS, -(-count // (shards * PART_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return placed.withColumn("own", own).join(offsets, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("own") - 1)


def shard_documents(df: DataFrame, shards: int = 40, dims: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; metadata dimensions are integer Columns."""
    dims = metadata(df) if dims is None else dims
    names = [f"d{k}" for k in range(len(dims))]
    text = F.col(text_col).cast("string")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0))
    values = [F.coalesce(d.cast("long"), F.lit(-1)).alias(n) for n, d in zip(names, dims)]
    slim = df.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), crc.cast("long").alias("hash"), *values)
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "shard-rows")  # written, so numbers stay as they are
    rows = slim
    if names:  # a text that holds a third of the rows makes a skewed join, which Spark splits as it runs
        least = slim.groupBy("hash", "size").agg(*(F.min(n).alias(n) for n in names))
        rows = materialize(slim.drop(*names).join(least, ["hash", "size"]), "shard-copies")
    out = with_slots(grow(rows, names, shards), slim.count(), shards)
    return out.select(F.col("id").alias(id_col), "size", F.col("hash").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
