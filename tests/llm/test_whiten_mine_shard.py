"""Operators 11, 12 and 13 against brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymap.llm import hard_negatives as mining
from quarrymap.llm import queries as registered
from quarrymap.llm import sharding, whitening
from quarrymap.llm.common import int_products
from tests.conftest import SF
from tests.llm.cases import documents, empty, rows

BAD = [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")] * 6, 1), (703, [float("inf")] * 6, 1)]
VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(spark, seed=3, n=300, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    found = [(k, (centres[k % 4] + 0.3 * rng.standard_normal(dim)).tolist(), int(rng.integers(0, 5))) for k in range(n)]
    hot = [(1000 + k, centres[0].tolist(), k % 3) for k in range(150)]  # a third of the rows
    found += hot + BAD + [(5, found[5][1], 2), (100, found[100][1], found[100][2]), (None, found[3][1], 0), (7000, found[8][1], None), (7001, found[9][1][:3], 1)]
    frame = spark.createDataFrame(found, VECTORS).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("x", F.lit(2))
    good = [(i, np.array([*np.floor(256 * np.array(v)), *[0] * (dim - len(v))]).astype(np.int64), y) for i, v, y in found if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return frame, good


def test_whitening_equals_brute_force(spark):
    frame, good = vectors(spark)
    got = whitening.whiten(frame).collect()
    fit = np.unique(np.array([v for _, v, _ in good]), axis=0)
    n, sums = len(fit), fit.sum(0)
    gap = fit - sums / n
    v = gap.T @ gap / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for k in range(4):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in got if r.component == k + 1)
        axis = u[:, k] * np.sign(u[np.abs(u[:, k]).argmax(), k])
        want = sorted((i is None, i or 0, int(((n * x - sums) ** 2).sum()), float((x - sums / n) @ axis / np.sqrt(e[k]))) for i, x, _ in good)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert np.allclose([m[3] for m in mine], [w[3] for w in want], atol=1e-9)
        assert all(abs(r.explained - e[k] / np.trace(v)) < 1e-9 for r in got if r.component == k + 1)


def test_whitening_blocks_of_pairs_and_odd_tables(spark, monkeypatch):
    frame, _ = vectors(spark)
    want = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(frame.filter("vec_id < 300")).collect()}
    monkeypatch.setattr(whitening, "PAIRS", 4)  # 21 pairs in six aggregations
    got = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(frame.filter("vec_id < 300")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert whitening.whiten(frame.limit(0)).count() == 0 and whitening.whiten(frame.filter("vec_id >= 1000 AND vec_id < 2000")).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")  # one dimension without variance
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    for scale in (1e5, 1e14):  # in decimals; beyond them
        large = spark.createDataFrame([(k, [scale * k, float(k * k)]) for k in range(60)] + [(60, [29.5 * scale, 1.0])], "vec_id long, embedding array<double>")
        x = [(int(256 * scale) * k, 256 * k * k) for k in range(60)] + [(int(256 * 29.5 * scale), 256)]
        s = [sum(c) for c in zip(*x)]
        exact = [sum((61 * c - t) ** 2 for c, t in zip(v, s)) for v in x]
        got = {r.vec_id: r.deviation for r in whitening.whiten(large).filter("component = 1").collect()}
        assert got == {k: d if d < 1 << 63 else None for k, d in enumerate(exact)} and None in got.values() and any(got.values())


def brute_negatives(good, anchors, positives=5, negatives=5):
    out = []
    for a, (i, q, y) in enumerate(good):
        if i is None or i % anchors:
            continue
        scored = sorted((-int(q @ p), j is None, j or 0, b) for b, (j, p, _) in enumerate(good) if b != a)
        for s, _, _, b in [t for t in scored if good[t[3]][2] == y][:positives]:
            kept = [t for t in scored if good[t[3]][2] != y and 80 * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(i, good[b][0], n + 1, good[c][0], -s, -t) for n, (t, _, _, c) in enumerate(kept)]
    return sorted(out, key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    frame, good = vectors(spark)
    good = [g for g in good if g[2] is not None]
    mined = lambda f: sorted(map(tuple, mining.hard_negatives(f, F.col("vec_id") % 20 == 0, F.col("label")).collect()), key=str)
    want = brute_negatives(good, 20)
    assert mined(frame) == want and len(want) > 100
    for name, value in (("SHARD", 40), ("CHUNK", 3), ("BLOCK", 8)):
        monkeypatch.setattr(mining, name, value)
    assert mined(frame) == want
    assert mined(frame.limit(0)) == [] and mined(frame.filter("vec_id = 20")) == []


def test_pivots_spare_products():
    rng = np.random.default_rng(5)
    points = np.floor(256 * np.concatenate([c + 0.02 * rng.standard_normal((400, 8)) for c in 3 * rng.standard_normal((6, 8))])).astype(np.int64)
    largest = float(np.sqrt((points**2).sum(1).max()))
    pivots = mining.pivots_of(points[::10], largest)
    part = mining.Part(np.arange(len(points)), np.arange(len(points)), np.zeros(len(points), int), points, mining.distances(mining.augmented(points, largest), pivots), largest)
    q = points[::50]
    best = -np.sort(-(q @ points.T), axis=1)[:, 5:6]
    found, multiplied = part.search(q, mining.distances(mining.anchored(q), pivots), np.arange(0, len(points), 50), np.zeros(len(q), int), best * 9 // 10, best, 5, True)
    assert multiplied < 0.7 * len(q) * len(points)
    scores = q @ points.T
    for a, _, at, s in found:
        inside = np.sort(scores[a][(scores[a] >= best[a] * 9 // 10) & (scores[a] <= best[a]) & (np.arange(len(points)) != 50 * a)])[::-1][:5]
        assert s.tolist() == inside.tolist() and scores[a][part.row[at]].tolist() == s.tolist()


def test_products_are_exact():
    big = np.array([[10**8 + 7, 3], [-(10**8), 1]])
    assert int_products(big, big).tolist() == [[int(x @ y) for y in big.astype(object)] for x in big.astype(object)]
    huge = np.array([[2**33, 1]])
    assert int_products(huge, huge).tolist() == [[2**63 - 1]]


def test_hard_negatives_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(registered.ORACLES["op12_hard_negatives"]).fetchall()
    assert sorted(map(tuple, registered.op12_hard_negatives(spark, SF).collect())) == sorted(want)


def brute_tree(items, dims, shards):
    """Leaf of each item (keys, size, dimensions) by sorting: the plain form of the operator without slack."""
    whole = [(min(x[2][d] for x in items), max(x[2][d] for x in items)) for d in range(dims)]
    leaf = {}

    def cut(some, first, leaves):
        if leaves == 1 or not some:
            leaf.update({x[0]: first for x in some})
            return
        span = [(max(x[2][d] for x in some) - min(x[2][d] for x in some)) / max(1, whole[d][1] - whole[d][0]) for d in range(dims)]
        d = max(range(dims), key=lambda k: (span[k], -k))
        some = sorted(some, key=lambda x: (x[2][d], *x[0]))
        goal, total, n = sum(x[1] for x in some) * (leaves // 2) / leaves, 0, 0
        while total + some[n][1] < goal:
            total, n = total + some[n][1], n + 1
        n += goal - total >= total + some[n][1] - goal
        cut(some[:n], first, leaves // 2)
        cut(some[n:], first + leaves // 2, leaves - leaves // 2)

    cut(items, 0, shards)
    return leaf


@pytest.mark.parametrize("buckets", [4, 4096])
def test_tree_equals_sorting(spark, monkeypatch, buckets):
    monkeypatch.setattr(sharding, "BUCKETS", buckets)
    rng = np.random.default_rng(9)
    items = [((int(h), k), int(rng.integers(17, 400)), (int(rng.integers(0, 3)), int(rng.integers(0, 50)))) for k, h in enumerate(rng.integers(0, 1 << 32, 90))]
    items += [((777, 500 + k), 60, (1, 7)) for k in range(50)]  # copies, a third of the rows
    frame = spark.createDataFrame([(h, r, s, *d) for (h, r), s, d in items], "hash long, row long, size long, d0 long, d1 long")
    got = {(r.hash, r.row): r.shard for r in sharding.grow(frame, ["d0", "d1"], 7, slack=0.0).collect()}
    assert got == brute_tree(items, 2, 7)


def test_shards_of_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    got = sharding.shard_documents(frame, shards=6).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    held = [[r for r in got if r.shard == k] for k in range(6)]
    sizes, largest = [sum(r["size"] for r in h) for h in held], max(t[1] for t in texts)
    assert max(sizes) - min(sizes) <= largest and all(sorted(r.slot for r in h) == list(range(len(h))) for h in held)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_of_odd_rows(spark):
    got = sharding.shard_documents(documents(spark), shards=4).collect()
    assert len(got) == len(rows()) and sum(r["size"] == 16 and r.text_crc32 == 0 for r in got) == 3
    for k in range(4):
        mine = sorted(r.slot for r in got if r.shard == k)
        assert mine == list(range(len(mine)))
    assert sharding.shard_documents(empty(spark), shards=4).count() == 0
    bare = documents(spark).select("doc_id", "text").limit(2)  # fewer rows than shards, no metadata
    assert len({(r.shard, r.slot) for r in sharding.shard_documents(bare, shards=4).collect()}) == 2
    one = spark.createDataFrame([(k, "same words", "en", "s", 10) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard_documents(one, shards=8).collect()  # one group of copies fills every shard
    assert sorted((r.shard, r.slot) for r in got) == [(k, n) for k in range(8) for n in range(5)]


def test_copies_stay_together(spark):
    texts = [f"text number {k} " + "x" * (k % 50) for k in range(400)]
    twice = [(k, t, "en" if k % 3 else "de", f"src{k % 5}", len(t)) for k, t in enumerate(texts + texts[::-1])]
    frame = spark.createDataFrame(twice, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard_documents(frame, shards=4).collect()
    homes = {}
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 3  # one at most where a cut has to fall
