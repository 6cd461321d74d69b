"""Whitening of embeddings by upper-triangle column aggregates.

Components are scaled to integers, x = floor(256 * c). The fit list holds every distinct x vector once; one aggregation gives
its size and sums, and a second one, generated as Spark SQL, sums the centred products of every pair of dimensions in the
upper triangle. Only these D * (D + 1) / 2 numbers reach the driver, where LAPACK decomposes the covariance; the projection
of the rows is a generated expression again, so rows are never shuffled but for the distinct of the fit list, which
aggregates before its shuffle. Beyond TILE dimensions the triangle is dealt out in tiles, whose number of expressions is fixed.

Defined results: the dimension is the most frequent length of the vectors (the greater of ties, empty ones aside), and rows of
another length are left out like those that lack entries; an entry beyond a long's range stops at its end; ``deviation`` is
null where it does not fit a long; a component without variance has null ``whitened`` and no part in ``identity_error``, which is
null if there is none with variance; ``explained`` is null where there is no variance at all; rows without an id and repeated rows
stay; vectors of fewer entries than components have fewer components; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collected, materialize

SCALE, COMPONENTS = 256, 4
#: Dimensions of which all pairs are summed at once.
TILE = 64
#: Variances below this share of the greatest count as none.
LEAST_VARIANCE = 1e-12


def integers(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry as array<long>; null if the vector is null or holds null or non-finite entries."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")))


def dimension(rows: DataFrame, column: str = "x") -> int:
    """The most frequent length of the vectors, the greater of ties; 0 if there is none."""
    first = rows.groupBy(F.size(column).alias("d")).count().where("d > 0").orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return first["d"] if first else 0


def balanced(terms: list[str], join: Callable[[str, str], str]) -> str:
    """``terms`` joined as a balanced tree, so that many dimensions make no deep expression."""
    while len(terms) > 1:
        terms = [join(*terms[i : i + 2]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def total(terms: list[str]) -> str:
    return balanced(terms, lambda a, b: f"({a} + {b})")


def covariance(fit: DataFrame, mean: list[float], n: int) -> np.ndarray:
    """Covariance, divisor ``n``, of ``fit`` (column x), centred before multiplying."""
    d = len(mean)
    out = np.zeros((d, d))
    if d <= TILE:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        centred = fit.selectExpr(*[f"x[{i}] - {m!r}D AS d{i}" for i, m in enumerate(mean)])
        row = collected(centred.selectExpr(*[f"sum(d{i} * d{j}) AS c{i}_{j}" for i, j in pairs]))
        out[tuple(zip(*pairs, strict=True))] = [c[0].as_py() for c in row.columns]
    else:
        tiles = -(-d // TILE)
        grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(tiles) for b in range(a, tiles)])
        means = F.array(*map(F.lit, mean))
        centred = fit.select(F.concat(F.zip_with("x", means, lambda x, m: x - m), F.array(*[F.lit(0.0)] * (tiles * TILE - d))).alias("d"))
        dealt = centred.select("d", F.inline(grid)).select("a", "b", *[F.get("d", F.col(t) * TILE + i).alias(f"{t}{i}") for t in "ab" for i in range(TILE)])
        table = collected(dealt.groupBy("a", "b").agg(*[F.expr(f"sum(a{i} * b{j})").alias(f"c{i}_{j}") for i in range(TILE) for j in range(TILE)]))
        whole = np.zeros((tiles * TILE, tiles * TILE))
        for a, b, *sums in zip(*[c.to_pylist() for c in table.columns], strict=True):
            whole[a * TILE : (a + 1) * TILE, b * TILE : (b + 1) * TILE] = np.reshape(sums, (TILE, TILE))
        out = whole[:d, :d]
    return (np.triu(out) + np.triu(out, 1).T) / n


def decomposed(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; the greatest entry of each is positive."""
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors.T[::-1]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values[::-1], vectors * signs[:, None]


def whitened(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    scaled = rows.select(F.col(row_id).cast("long").alias("vec_id"), integers(vector).alias("x")).where("x is not null")
    every = materialize(scaled.select("x").distinct(), "distinct")
    d = dimension(every)
    fit, kept = every.where(F.size("x") == d), scaled.where(F.size("x") == d)
    sums = collected(fit.selectExpr("count(*) AS n", *[f"sum(cast(x[{i}] AS decimal(20, 0))) AS s{i}" for i in range(d)])).to_pylist()[0]
    n, s = sums["n"], [int(sums[f"s{i}"] or 0) for i in range(d)]
    if not n or not d:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    mean = [v / n for v in s]
    values, vectors = decomposed(covariance(fit, mean, n))
    trace = float(values.sum())
    used = [k for k in range(min(components, d)) if values[k] > LEAST_VARIANCE * values[0] and values[k] > 0]
    centred = [f"x[{i}] - {m!r}D AS d{i}" for i, m in enumerate(mean)]
    score = {k: total([f"d{i} * {float(v)!r}D" for i, v in enumerate(vectors[k] / np.sqrt(values[k]))]) for k in used}
    error = None
    if used:
        pairs = [(k, m) for i, k in enumerate(used) for m in used[i:]]
        found = fit.selectExpr(*centred).selectExpr(*[f"{score[k]} AS w{k}" for k in used]).selectExpr(*[f"covar_pop(w{k}, w{m})" for k, m in pairs]).first()
        error = max(abs(v - (k == m)) for v, (k, m) in zip(found, pairs, strict=True))
    fits = all(-(1 << 63) <= v < 1 << 63 for v in s)
    square = [f"try_multiply(try_subtract(try_multiply(x[{i}], {n}L), {v}L), try_subtract(try_multiply(x[{i}], {n}L), {v}L))" for i, v in enumerate(s)]
    deviation = balanced(square, lambda a, b: f"try_add({a}, {b})") if fits else "cast(null AS long)"
    one = [f"struct({k + 1} AS component, {score.get(k, 'cast(null AS double)')} AS whitened, {repr(float(values[k] / trace)) + 'D' if trace > 0 else 'cast(null AS double)'} AS explained)" for k in range(min(components, d))]
    out = kept.selectExpr("vec_id", "x", *centred).selectExpr("vec_id", f"{deviation} AS deviation", f"array({', '.join(one)}) AS each").selectExpr("vec_id", "deviation", "inline(each)")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
