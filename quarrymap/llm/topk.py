"""Exact top-k search (operator 5): dual-tree search over cover trees, by inner product.

1. Every row goes to the cell of its nearest pivot (pivots are spread over a bounded sample; every row is
   indexed). A cell is a ball: its pivot and the largest distance to it. Cells are cut into shards of about
   `SHARD` rows by id hash, so no cell, however large, is one task, and a data row is sent to one shard only.
2. Every query first searches one shard of its own cell. The kth score it finds there is a floor.
3. It is then sent to the shards of those cells whose ball may hold a score of at least its floor.
4. A shard builds a cover tree over its rows - each node's children cover it with half its radius, unless 24
   of them can't and it is small - and one over each batch of at most `CHUNK` queries (coherent, as they come
   ordered by own cell), and walks pairs of nodes, best bound first. With centres c, covering radii r,

       max <q, p>  <=  <cq, cp> + |cq| rp + |cp| rq + rq rp,

   so a pair whose bound is under the worst kth score (or floor) among its group of queries is pruned.

Bounds are doubles with slack; scores are exact integers (sums of products that doubles may not hold are formed in 64-bit
integers, and cut to their range beyond). The shards' top k of each query are merged at
the end; a task holds one shard and one batch of queries.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; rows of one id count once, with its least vector; a query without
candidates gives no rows; ties go to the smaller id; the input's other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm.common import Batches, int_products, materialize, tidy

SAMPLE, PIVOTS = 2048, 512  # sampled vectors; cells at most
SHARD, CHUNK, LEAF, QUERY_LEAF = 8_192, 4_096, 64, 24
WIDE, SHRINK = 16, 0.7
SCALE = 256
LEAST = int(np.iinfo(np.int64).min)  # no score


def components(embedding: Column) -> Column:
    """floor(SCALE * x) of every component as double; null if the vector takes no part."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def farthest_first(points: np.ndarray, count: int, radius: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (row numbers) until `count` or until all lie within `radius`; each row's centre and distance."""
    centres, owner = [0], np.zeros(len(points), np.int64)
    distance = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(centres) < count:
        far = int(distance.argmax())
        if distance[far] <= radius:
            break
        d = np.sqrt(((points - points[far]) ** 2).sum(1))
        near = d < distance
        owner[near], distance[near] = len(centres), d[near]
        centres.append(far)
    return np.array(centres), owner, distance


class Node:
    """A ball of rows: centre, covering radius, row numbers, and children with their balls as arrays."""

    __slots__ = ("centre", "norm", "radius", "rows", "children", "centres", "norms", "radii")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray, radius: float, leaf: int):
        self.centre, self.norm, self.radius, self.rows = centre, float(np.sqrt(centre @ centre)), radius, rows
        self.children: list[Node] = []
        if len(rows) > leaf and radius > 0:
            own = points[rows]
            centres, owner, distance = farthest_first(own, 24, radius / 2)
            if len(rows) <= WIDE * leaf and float(distance.max()) > SHRINK * radius:
                return  # children as wide as their parent prune nothing
            for k, c in enumerate(centres.tolist()):
                mine = owner == k
                self.children.append(Node(points, rows[mine], own[c], float(distance[mine].max()), leaf))
            self.centres, self.norms, self.radii = (np.array([getattr(x, a) for x in self.children]) for a in ("centre", "norm", "radius"))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    distance = np.sqrt(((points - points[0]) ** 2).sum(1))
    return Node(points, np.arange(len(points)), points[0], float(distance.max()), leaf)


def whole(v: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, cut to their range."""
    most = np.nextafter(2.0**63, 0)
    return np.clip(v, -most, most).astype(np.int64)


class Best:
    """The k best (score, id) of every query so far; scores under a query's floor are of no use."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n, LEAST) if floor is None else floor
        self.score = np.full((n, k), LEAST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[queries, -1], self.floor[queries])

    def offer(self, queries: np.ndarray, query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(query_ids[:, None] == ids, LEAST, scores)
        hit = (scores >= self.worst(queries)[:, None]).any(1) & (scores > LEAST).any(1)
        if not hit.any():
            return
        rows = queries[hit]
        s = np.concatenate([self.score[rows], scores[hit]], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, and can't overflow
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.where(self.score[rows] > LEAST, np.take_along_axis(i, order, 1), np.iinfo(np.int64).max)


def dual_search(query_root: Node, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, best: Best, root: Node | None = None) -> int:
    """Offer every pair that may matter; returns the number of node pairs pruned."""

    def bounds(node: Node, other: Node) -> np.ndarray:
        """Of each child of `node` with `other`."""
        b = node.centres @ other.centre + other.norm * node.radii + other.radius * (node.norms + node.radii)
        return b + 1e-6 * (1 + np.abs(b))

    top = lambda v: float(np.abs(v).max(initial=0))
    if top(queries) * top(points) * queries.shape[1] < 2**53:  # doubles hold every partial sum
        product = lambda q, p: (queries[q] @ points[p].T).astype(np.int64)
    else:
        whole_q, whole_p = whole(queries), whole(points)
        product = lambda q, p: int_products(whole_q[q], whole_p[p])
    pruned, n = 0, 1
    heap = [(-np.inf, 0, query_root, root or cover_tree(points))]
    while heap:
        negative, _, q, p = heapq.heappop(heap)
        worst = best.worst(q.rows).min()
        if -negative < worst:
            pruned += 1
            continue
        if not q.children and not p.children:
            best.offer(q.rows, query_ids[q.rows], product(q.rows, p.rows), ids[p.rows])
            continue
        split_q = bool(q.children) and (not p.children or q.radius >= p.radius)
        found = bounds(q, p) if split_q else bounds(p, q)
        some = np.flatnonzero(found >= worst).tolist()
        pruned += len(found) - len(some)
        for k in some:
            pair = (q.children[k], p) if split_q else (q, p.children[k])
            heapq.heappush(heap, (-found[k], n, *pair))
            n += 1
    return pruned


def searched(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every shard for the queries that were sent to it.

    data (cell, shard, id, v), asked (cell, shard, own, id, v, floor).
    """

    def search(it: Batches) -> Batches:
        key, root, points, ids = None, None, None, None
        held: list[tuple] = []
        waiting: list[tuple] = []

        def answers() -> Batches:
            nonlocal root, points, ids
            if root is None and held and waiting:
                ids, points = (np.concatenate(x) for x in zip(*held))
                root = cover_tree(points)
                held.clear()
            if root is not None and waiting:
                query_ids, queries, floor = (np.concatenate(x) for x in zip(*waiting))
                best = Best(len(query_ids), k, floor)
                dual_search(cover_tree(queries, QUERY_LEAF), queries, query_ids, points, ids, best, root)
                at = best.score > LEAST
                columns = np.broadcast_to(query_ids[:, None], at.shape)[at], best.id[at], best.score[at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
            waiting.clear()

        for b in it:
            keys = np.stack([b.column(n).to_numpy() for n in range(3)], 1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, [len(keys)]])
            row_ids, floors = b.column(3).to_numpy(), b.column(5).to_numpy()
            vectors = np.frombuffer(b"".join(b.column(4).to_pylist())).reshape(len(row_ids), -1)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if tuple(keys[a, :2].tolist()) != key:
                    yield from answers()
                    key, root = tuple(keys[a, :2].tolist()), None
                    held.clear()
                if keys[a, 2] == 0:
                    held.append((row_ids[a:z], vectors[a:z]))
                    continue
                for s in range(a, z, CHUNK):
                    part = slice(s, min(z, s + CHUNK))
                    waiting.append((row_ids[part], vectors[part], floors[part]))
                    if sum(len(w[0]) for w in waiting) >= CHUNK:
                        yield from answers()
        yield from answers()

    parts = max(1, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = data.select("cell", "shard", F.lit(0).alias("side"), F.lit(0).alias("own"), "id", "v", F.lit(0).cast("long").alias("floor"))
    both = both.unionByName(asked.select("cell", "shard", F.lit(1).alias("side"), "own", "id", "v", "floor"))
    dealt = both.repartition(parts, "cell", "shard").sortWithinPartitions("cell", "shard", "side", "own", "id")
    return dealt.select("cell", "shard", "side", "id", "v", "floor").mapInArrow(tidy(search), "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other rows."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), components(F.col(vector_col)).alias("v"), is_query.alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query"))
    rows = materialize(rows, "vectors")
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    dim, count = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()

    def padded(vectors: list[list[float]]) -> np.ndarray:
        out = np.zeros((len(vectors), max(1, dim)))
        for row, v in zip(out, vectors):
            row[: len(v)] = v
        return out

    pool = padded(sample) if sample else np.zeros((1, max(1, dim)))
    pivots = pool[farthest_first(pool, min(PIVOTS, max(1, count // SHARD)))[0]]

    def near(it: Batches) -> Batches:
        for b in it:
            v = padded(b.column(1).to_pylist())
            cell = ((pivots**2).sum(1) - 2 * (v @ pivots.T)).argmin(1)
            distance = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cell, pa.int32()), pa.array(distance, pa.float64()), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "query", "cell", "distance", "v"])

    placed = materialize(rows.mapInArrow(tidy(near), "id long, query boolean, cell int, distance double, v binary"), "cells")
    balls = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()}  # a row per pivot
    radii = np.array([balls[c]["radius"] if c in balls else -1.0 for c in range(len(pivots))])  # -1: no rows
    shards = F.element_at(F.array(*(F.lit(-(-balls[c]["n"] // SHARD) if c in balls else 1) for c in range(len(pivots)))), F.col("cell") + 1)
    norms = np.sqrt((pivots**2).sum(1))

    def aim(it: Batches) -> Batches:
        """A row per query and cell that may hold a score of its floor."""
        for b in it:
            v = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1)
            bound = v @ pivots.T + np.sqrt((v**2).sum(1))[:, None] * radii
            q, cell = np.nonzero((bound + 1e-6 * (1 + np.abs(bound)) >= b.column(3).to_numpy()[:, None]) & (radii >= 0))
            for k in range(0, len(q), 20_000):
                at = pa.array(q[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), b.column(3).take(at), pa.array(cell[k : k + 20_000], pa.int32())], names=["id", "v", "own", "floor", "cell"])

    shard = F.pmod(F.xxhash64("id"), shards).cast("int")
    data = placed.select("cell", shard.alias("shard"), "id", "v")
    queries = placed.filter("query").select("id", "v", F.col("cell").alias("own"))
    first = queries.select(F.col("own").alias("cell"), "own", "id", "v", F.lit(LEAST).alias("floor")).withColumn("shard", shard)
    floors = best_of(searched(data, first, k), k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    aimed = queries.join(floors, "id", "left").select("id", "v", "own", F.coalesce("floor", F.lit(LEAST)).alias("floor"))
    aimed = aimed.mapInArrow(tidy(aim), "id long, v binary, own int, floor long, cell int").withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    return best_of(searched(data, aimed, k), k).select("query_id", "rank", "vec_id", "score")
