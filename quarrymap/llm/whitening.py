"""Embedding whitening (operator 11): covariance by upper-triangle column aggregates, decomposed with LAPACK.

1. Components become integers x = floor(SCALE * c); each distinct x vector is in the fit list once.
2. One aggregation over the list gives n, every dimension's sum S and its least and largest value.
3. SQL expressions are generated for the centred columns, and for the sum of the products of every pair (i <= j);
   one aggregation computes them all, up to `PAIRS` at a time (64 dimensions make 2,080; beyond `PAIRS`, as
   for 1,536 dimensions, blocks of pairs are one aggregation each). Only sums leave the executors.
4. The driver assembles the covariance (its size depends on the dimensions alone) and decomposes it with LAPACK
   (numpy.linalg.eigh). Eigenvectors are signed so that their largest entry is positive.
5. Each row is projected by one generated expression per component, centred first and divided by sqrt(e).

The sum over dimensions of (n x - S)^2 is exact: in long arithmetic where least and largest values prove that
it fits, else in decimals of 38 digits; null where it doesn't fit a long.

Defined cases: vectors that are null or hold null or non-finite entries take no part, in the fit nor in the result;
shorter vectors count as padded with zeros; rows that repeat, or have a null id, are rows of the result each, but their
vector counts once in the fit; components without variance (eigenvalue under the rounding error of the largest)
are left out, so a list of one vector, or an empty table, gives no rows; the input's other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import materialize

SCALE = 256
PAIRS = 4096  # sums of products in one aggregation
COMPONENTS = 4


def integers(embedding: Column) -> Column:
    """floor(SCALE * x) of every entry as long; null if the vector takes no part."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def entry(vector: str, i: int) -> str:
    """SQL of entry i, zero past the vector's end."""
    return f"coalesce(get({vector}, {i}), 0L)"


def centred(dim: int, mean: np.ndarray) -> list[str]:
    return [f"CAST({entry('x', i)} AS DOUBLE) - {number(mean[i])} AS c{i}" for i in range(dim)]


def number(x: float) -> str:
    """A double literal of SQL that reads back exactly."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def covariance(fit: DataFrame, dim: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Of the vectors `x` of the list: generated sums of centred products over n."""
    columns = fit.selectExpr(*centred(dim, mean))
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    out = np.zeros((dim, dim))
    for k in range(0, len(pairs), PAIRS):
        some = pairs[k : k + PAIRS]
        sums = columns.selectExpr("array(" + ", ".join(f"sum(c{i} * c{j})" for i, j in some) + ") AS sums").first()["sums"]
        for (i, j), s in zip(some, sums):
            out[i, j] = out[j, i] = s / n
    return out


def decompose(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as columns; at most `most`, those with variance."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values.max(), 0.0) * len(v) * np.finfo(float).eps]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else np.ones(0)
    return values[order], vectors * sign


def deviation(dim: int, n: int, sums: list[int], least: list[int], largest: list[int]) -> str:
    """SQL of the exact sum over dimensions of (n x - S)^2 as long."""
    bound = sum(max(abs(n * int(a) - int(s)), abs(n * int(b) - int(s))) ** 2 for s, a, b in zip(sums, least, largest))
    if bound < 1 << 62:
        terms = [f"({n}L * {entry('x', i)} - {int(sums[i])}L) * ({n}L * {entry('x', i)} - {int(sums[i])}L)" for i in range(dim)]
        return " + ".join(terms)
    if max(max(abs(n * int(a) - int(s)), abs(n * int(b) - int(s))) for s, a, b in zip(sums, least, largest)) >= 10**18:
        # One entry may square past every decimal: what doesn't fit a long anyway is null.
        gap = lambda i: f"(CAST({n} AS DECIMAL(19,0)) * CAST({entry('x', i)} AS DECIMAL(19,0)) - CAST('{int(sums[i])}' AS DECIMAL(38,0)))"
        small = " AND ".join(f"abs{gap(i)} < 4000000000" for i in range(dim))
        square = " + ".join(f"CAST({gap(i)} AS DECIMAL(10,0)) * CAST({gap(i)} AS DECIMAL(10,0))" for i in range(dim))
        return f"CASE WHEN {small} THEN try_cast({square} AS BIGINT) END"
    gap = lambda i: f"CAST(({n}L * {entry('x', i)} - {int(sums[i])}L) AS DECIMAL(18,0))"
    return "try_cast(" + " + ".join(f"{gap(i)} * {gap(i)}" for i in range(dim)) + " AS BIGINT)"


def whiten(df: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = df.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    dim = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    rows = rows.select("id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))).alias("x"))
    rows = materialize(rows, "whitening-rows")
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    named = [f"{f}({entry('x', i)}{kind})" for f, kind in (("sum", "::DECIMAL(20,0)"), ("min", ""), ("max", "")) for i in range(dim)]
    n, *found = fit.selectExpr("count(*)", *named).first()
    sums, least, largest = ([int(v or 0) for v in found[k * dim : (k + 1) * dim]] for k in range(3))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not dim:
        return df.sparkSession.createDataFrame([], schema)
    mean = np.array([s / n for s in sums])
    v = covariance(fit, dim, n, mean)
    values, vectors = decompose(v, most)
    total = float(np.trace(v))
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)

    def projected(frame: DataFrame, *keep: str) -> DataFrame:
        out = frame.selectExpr(*keep, *centred(dim, mean))
        whitened = [" + ".join(f"c{i} * {number(vectors[i, k] / np.sqrt(values[k]))}" for i in range(dim)) for k in range(len(values))]
        return out.selectExpr(*keep, *(f"{w} AS w{k}" for k, w in enumerate(whitened)))

    # The whitened columns' own covariance, centred before multiplying.
    w = projected(fit)
    means = w.selectExpr(*(f"avg(w{k})" for k in range(len(values)))).first()
    pairs = [(a, b) for a in range(len(values)) for b in range(a, len(values))]
    products = w.selectExpr(*(f"avg((w{a} - {number(means[a])}) * (w{b} - {number(means[b])}))" for a, b in pairs)).first()
    error = max(abs(p - (a == b)) for (a, b), p in zip(pairs, products))
    out = projected(rows.selectExpr("id", "x", f"{deviation(dim, n, sums, least, largest)} AS deviation"), "id", "deviation")
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(float(e / total)).alias("explained")) for k, e in enumerate(values)))).alias("c")
    out = out.select("id", "deviation", each)
    return out.select(F.col("id").alias(id_col), "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
