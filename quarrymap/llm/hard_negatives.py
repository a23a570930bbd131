"""Hard-negative mining (operator 12): a pivot table over vectors augmented so that inner product is a distance.

With M the largest norm of the table, a row p becomes p' = (p, sqrt(M^2 - |p|^2)) and an anchor q' = (q, 0), so

    |q' - p'|^2 = |q|^2 + M^2 - 2 <q, p>.

Pivots v are augmented rows of a bounded sample (farthest first); every row stores its distances to them. By
the triangle inequality, max_v | |q'v| - |p'v| |  <=  |q'p'|  <=  min_v (|q'v| + |p'v|), which brackets the score
<q, p> from both sides. An anchor looks for the k highest scores within intervals: its positives in one interval
without ends, the negatives of each positive s in [low s, high s]. A row, or a whole cell of rows, whose bracket
misses all intervals, or can't beat the kth score found in them, is never multiplied; the survivors are checked
with exact integer scores.

1. Every row goes to the cell of its nearest pivot. The cells' least and largest distances to all pivots
   (at most `PIVOTS` ^ 2 pairs) are the cells' brackets.
2. Positives: rows and anchors meet by label, where a label's rows are dealt over parts of about `SHARD` rows, however
   many a label has. The parts' best are merged.
3. Negatives: an anchor, with the intervals of its positives, is sent to those cells whose bracket meets one, and to all
   parts of about `SHARD` rows of the cell; the parts' best are merged.

A task holds one part and at most `CHUNK` anchors. Work is what a search of n / 100 anchors in n rows needs,
less what is pruned; on vectors without structure in many dimensions brackets are wide and little is.

Defined cases: rows with a null label or a vector that is null or holds null or non-finite components take no
part; shorter vectors count as padded with zeros; rows that repeat an id are rows of their own (an anchor's other rows
are all but itself, and each anchor row has its own results); null ids come last among ties; an interval of a
negative positive score is empty if low < high; anchors without positives, and positives without negatives, give no
rows; scores beyond a long are cut to its range; an empty table gives no rows; the input's other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm.common import Batches, int_products, materialize, tidy

SCALE = 256
SAMPLE, PIVOTS = 2048, 24  # sampled rows; pivots, which are also the cells
SHARD, CHUNK, BLOCK = 8_192, 1_024, 512
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor long, anchor_id long, slot int, row long, id long, score long"


def integers(embedding: Column) -> Column:
    """floor(SCALE * x) of every component as long; null if the vector takes no part."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def augmented(v: np.ndarray, largest: float) -> np.ndarray:
    """Rows with the entry that gives all the norm `largest`."""
    v = v.astype(float)
    return np.concatenate([v, np.sqrt(np.maximum(0.0, largest**2 - (v**2).sum(1)))[:, None]], 1)


def pivots_of(sample: np.ndarray, largest: float, count: int = PIVOTS) -> np.ndarray:
    """Augmented pivots, each the farthest from those before it; fewer if the sample has fewer different rows."""
    points = augmented(sample, largest)
    chosen, gap = [0], np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1)))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[points, pivots], both augmented."""
    squares = (points**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def anchored(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1)


def brackets(norm2: np.ndarray, largest: float, gap: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible scores [anchors, things], from anchors' pivot distances `gap` and the things' range of them."""
    low, high = np.zeros((len(gap), len(near))), np.full((len(gap), len(near)), np.inf)
    for j in range(gap.shape[1]):
        g = gap[:, j, None]
        np.maximum(low, np.maximum(g - far[:, j], near[:, j] - g), out=low)
        np.minimum(high, g + far[:, j], out=high)
    base = norm2[:, None] + largest**2
    slack = 1e-7 * (1.0 + base)  # of rounding, in the distances' squares
    return (base - high**2) / 2 - slack, (base - low**2) / 2 + slack


class Part:
    """The rows of one part, in blocks of rows that lie near in their distance to the part's middle pivot."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, gaps: np.ndarray, largest: float):
        order = np.argsort(gaps[:, gaps.var(0).argmax()], kind="stable")
        self.row, self.ids, self.labels, self.vectors, self.gaps, self.largest = row[order], ids[order], labels[order], vectors[order], gaps[order], largest
        self.starts = np.arange(0, len(row), BLOCK)
        self.near, self.far = np.minimum.reduceat(self.gaps, self.starts, axis=0), np.maximum.reduceat(self.gaps, self.starts, axis=0)

    def search(self, q: np.ndarray, gap: np.ndarray, row: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], int]:
        """(anchor, interval, rows, scores) of the k best of each interval [anchors, intervals]; and how many pairs were multiplied."""
        norm2 = (q.astype(float) ** 2).sum(1)
        least, most = brackets(norm2, self.largest, gap, self.near, self.far)
        out, multiplied = [], 0
        for a in range(len(q)):
            lo, hi = low[a], high[a]
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lo]  # rows here, scores
            floor = lo.astype(float)
            for b in np.argsort(-most[a]).tolist():
                meets = (most[a, b] >= floor) & (least[a, b] <= hi)
                if not meets.any():
                    continue
                here = np.arange(self.starts[b], min(self.starts[b] + BLOCK, len(self.row)))
                here = here[((self.labels[here] == labels[a]) == same) & (self.row[here] != row[a])]
                down, up = brackets(norm2[a : a + 1], self.largest, gap[a : a + 1], self.gaps[here], self.gaps[here])
                hit = ((up[0][:, None] >= floor[meets]) & (down[0][:, None] <= hi[meets])).any(1)
                here = here[hit]
                if not len(here):
                    continue
                multiplied += len(here)
                scores = int_products(q[a : a + 1], self.vectors[here])[0]
                for j in np.flatnonzero(meets).tolist():
                    inside = (scores >= lo[j]) & (scores <= hi[j])
                    if not inside.any():
                        continue
                    at, s = np.concatenate([best[j][0], here[inside]]), np.concatenate([best[j][1], scores[inside]])
                    keep = np.lexsort((self.row[at], self.ids[at], -s.astype(object) if s.min() == LEAST else -s))[:k]
                    best[j] = at[keep], s[keep]
                    if len(keep) == k:
                        floor[j] = max(floor[j], float(best[j][1][-1]))
            out += [(a, j, at, s) for j, (at, s) in enumerate(best) if len(at)]
        return out, multiplied


def rows_of(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def searched(data: DataFrame, asked: DataFrame, key: str, largest: float, k: int, same: bool) -> DataFrame:
    """FOUND rows: the best of every part for the anchors that were sent to it. Both sides hold `key` and `part`."""

    def search(it: Batches) -> Batches:
        now, part = None, None
        held: list[tuple] = []
        waiting: list[tuple] = []

        def answers() -> Batches:
            nonlocal part
            if held and waiting:
                part = Part(*(np.concatenate(x) for x in zip(*held)), largest)
                held.clear()
            if part is not None and waiting:
                row, ids, labels, q, gap, low, high = (np.concatenate(x) for x in zip(*waiting))
                found, _ = part.search(q, gap, row, labels, low, high, k, same)
                if found:
                    size = [len(at) for _, _, at, _ in found]
                    a, j, at = np.repeat([f[0] for f in found], size), np.repeat([f[1] for f in found], size), np.concatenate([f[2] for f in found])
                    columns = [row[a], ids[a], j.astype(np.int32), part.row[at], part.ids[at], np.concatenate([f[3] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "anchor_id", "slot", "row", "id", "score"])
            waiting.clear()

        for b in it:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, [len(keys)]]) if len(keys) else np.array([0])
            row, ids, labels = (b.column(i).to_numpy() for i in (3, 4, 5))
            vectors, gaps = rows_of(b.column(6), "<i8", len(keys)), rows_of(b.column(7), "<f8", len(keys))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if tuple(keys[s, :2].tolist()) != now:
                    yield from answers()
                    now, part = tuple(keys[s, :2].tolist()), None
                    held.clear()
                if keys[s, 2] == 0:
                    held.append((row[s:e], ids[s:e], labels[s:e], vectors[s:e], gaps[s:e]))
                    continue
                for c in range(s, e, CHUNK):
                    x = slice(c, min(e, c + CHUNK))
                    low, high = (rows_of(b.column(i).slice(x.start, x.stop - x.start), "<i8", x.stop - x.start) for i in (8, 9))
                    waiting.append((row[x], ids[x], labels[x], vectors[x], gaps[x], low, high))
                    if sum(len(w[0]) for w in waiting) >= CHUNK:
                        yield from answers()
        yield from answers()

    common = ["row", "id", "label", "v", "gap"]
    key, none = [F.col(key).alias("key"), "part"], F.lit(b"")
    both = data.select(*key, F.lit(0).cast("long").alias("side"), *common, none.alias("low"), none.alias("high"))
    both = both.unionByName(asked.select(*key, F.lit(1).cast("long").alias("side"), *common, "low", "high"))
    parts = max(1, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "side", "row")
    return dealt.mapInArrow(tidy(search), FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of every anchor row and interval, with `rank` from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def interval_ends(score: Column, low: int, high: int) -> tuple[Column, Column]:
    """Least and largest integer scores n with low * score <= 100 n <= high * score, in decimals that can't overflow."""
    s = score.cast("decimal(20,0)")
    return F.ceil(s * low / 100).cast("long"), F.floor(s * high / 100).cast("long")


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `low` and `high` in percent of the positive's score."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), integers(F.col(vector_col)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("label IS NOT NULL AND v IS NOT NULL")
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(MOST)).alias("id"), "label", "v", "anchor"), "negatives-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dim, largest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.sqrt(square)), F.lit(0.0))).first()
    dim, largest = max(1, dim), largest * (1 + 1e-12)

    def padded(vectors: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(vectors), dim), np.int64)
        for to, v in zip(out, vectors):
            to[: len(v)] = v
        return out

    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("v").collect()]
    pivots = pivots_of(padded(sample) if sample else np.zeros((1, dim), np.int64), largest)

    def place(it: Batches) -> Batches:
        for b in it:
            v = padded(b.column(3).to_pylist())
            to = distances(augmented(v, largest), pivots)
            anchor = b.column(4).to_numpy(zero_copy_only=False)
            own = np.where(anchor[:, None], distances(anchored(v), pivots), 0.0)
            columns = [*b.columns[:3], pa.array([x.tobytes() for x in v], pa.binary()), b.column(4), pa.array(to.argmin(1)), pa.array([x.tobytes() for x in to], pa.binary()), pa.array(list(to), pa.list_(pa.float64())), pa.array([x.tobytes() if y else None for x, y in zip(own, anchor)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "label", "v", "anchor", "cell", "gap", "gaps", "anchor_gap"])

    placed = rows.mapInArrow(tidy(place), "row long, id long, label long, v binary, anchor boolean, cell long, gap binary, gaps array<double>, anchor_gap binary")
    placed = materialize(placed, "negatives-cells")
    anchors = placed.filter("anchor").select("row", "id", "label", "v", F.col("anchor_gap").alias("gap"))
    part = lambda parts: F.pmod(F.xxhash64("row"), parts)

    # Positives: by label.
    sizes = placed.groupBy("label").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("parts"))
    data = placed.join(sizes, "label").select("row", "id", "label", "v", "gap", part(F.col("parts")).alias("part"))
    open_low, open_high = (F.lit(np.array([x], "<i8").tobytes()) for x in (LEAST, MOST))
    asked = anchors.join(sizes, "label").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), open_low.alias("low"), open_high.alias("high"))
    found = best_of(searched(data, asked, "label", largest, positives, True), positives)
    ends = interval_ends(F.col("score"), low, high)
    found = materialize(found.select("anchor", "anchor_id", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), ends[0].alias("from"), ends[1].alias("to")), "positives")

    # Negatives: by cell. An interval that can't hold a score is left out of no list, so numbers stay positions.
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("gaps")[j]).alias(f"{n}{j}") for j in range(len(pivots)) for n, f in (("near", F.min), ("far", F.max)))).collect()  # a row per pivot
    number = np.array([c["cell"] for c in cells], np.int64)
    near, far = (np.array([[c[f"{n}{j}"] for j in range(len(pivots))] for c in cells]).reshape(len(cells), len(pivots)) for n in ("near", "far"))
    parts = {c["cell"]: -(-c["n"] // SHARD) for c in cells}
    count = F.element_at(F.array(*(F.lit(parts.get(c, 1)).cast("long") for c in range(len(pivots)))), (F.col("cell") + 1).cast("int"))
    listed = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "from", "to"))).alias("l"))  # at most `positives` each
    asked = anchors.join(listed, anchors["row"] == listed["anchor"]).select("row", "id", "label", "v", "gap", F.col("l.from").alias("froms"), F.col("l.to").alias("tos"))

    def aim(it: Batches) -> Batches:
        """An anchor for every cell whose bracket meets one of its intervals; shorter lists end with empty intervals."""
        for b in it:
            n = b.num_rows
            if not n:
                continue
            v, gap = rows_of(b.column(3), "<i8", n), rows_of(b.column(4), "<f8", n)
            lo, hi = np.full((n, positives), 1, np.int64), np.zeros((n, positives), np.int64)
            for i, (x, y) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist())):
                lo[i, : len(x)], hi[i, : len(y)] = x, y
            least, most = brackets((v.astype(float) ** 2).sum(1), largest, gap, near, far)
            meets = np.zeros(least.shape, bool)
            for j in range(positives):
                meets |= (lo[:, j] <= hi[:, j])[:, None] & (most >= lo[:, j, None]) & (least <= hi[:, j, None])
            a, c = np.nonzero(meets)
            for s in range(0, len(a), 10_000):
                at = pa.array(a[s : s + 10_000])
                ends = [pa.array([x.tobytes() for x in e[a[s : s + 10_000]]], pa.binary()) for e in (lo, hi)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(5)), *ends, pa.array(number[c[s : s + 10_000]])], names=["row", "id", "label", "v", "gap", "low", "high", "cell"])

    asked = asked.mapInArrow(tidy(aim), "row long, id long, label long, v binary, gap binary, low binary, high binary, cell long")
    asked = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("part"))
    data = placed.select("row", "id", "label", "v", "gap", "cell", part(count).alias("part"))
    mined = best_of(searched(data, asked, "cell", largest, negatives, False), negatives)
    mined = mined.select("anchor", (F.col("slot") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(mined, ["anchor", "nth"])
    known = lambda c: F.when(F.col(c) != MOST, F.col(c)).alias(c)  # noqa: E731  null ids were the largest
    return out.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
