"""Signed feature hashing of words and word pairs, and the cosine of such vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..session import estimated_bytes
from .text import let


def tokens(text: Column) -> Column:
    """Words without punctuation, then adjacent pairs joined by an underscore."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+"), lambda w: w != "")

    def with_pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b)))

    return let(words, with_pairs)


def token_hash(token: Column) -> Column:
    """31 * h + code point over the characters, modulo 2 ** 32."""
    points = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def feature_hash(text: Column, dim: int = V.EMBEDDING_DIM) -> Column:
    """array<double> of length ``dim``, scaled to length 1 and rounded to five digits; zeros if there is no token."""
    signed = F.transform(F.transform(tokens(text), token_hash), lambda h: F.struct((h % dim).cast("int").alias("at"), F.when(F.shiftright(h, 8) % 2 == 1, 1.0).otherwise(-1.0).alias("sign")))

    def cells(s: Column) -> Column:
        """Sums of the cells that the text's tokens touch."""
        at = F.array_distinct(F.transform(s, lambda x: x["at"]))
        return F.map_from_entries(F.transform(at, lambda i: F.struct(i, F.aggregate(s, F.lit(0.0), lambda total, x: total + F.when(x["at"] == i, x["sign"]).otherwise(0.0)))))

    def scaled(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(x["norm"] > 1e-9, F.round(F.coalesce(F.try_element_at(x["cells"], i), F.lit(0.0)) / x["norm"], 5)).otherwise(0.0))

    norm = lambda c: F.sqrt(F.aggregate(F.map_values(c), F.lit(0.0), lambda total, x: total + x * x))
    return let(let(signed, cells), lambda c: let(F.struct(c.alias("cells"), norm(c).alias("norm")), scaled))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product within [-1, 1]; 0 for missing, empty or unequally long vectors."""
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(0.0)


def sparse_cosine(slots: Column, b: Column) -> Column:
    """:func:`cosine` of a vector's non-zero slots (array of struct at, v, ascending) and another of the same length; nothing but zeros is left out of the sum."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(slots, F.lit(0.0), lambda total, x: total + x["v"] * F.get(b, x["at"]))))


def embedding_text(subject: Column, predicate: Column, scope: Column) -> Column:
    return F.concat_ws(" ", subject, predicate, F.coalesce(scope, F.lit("")))


#: Queries in a block; parts of all rows at least, and bytes of rows (by Spark's estimate) in a part; rows that are multiplied at once.
BLOCK, PARTS, PART_BYTES, STEP = 2048, 32, 16 << 20, 4096
#: Products that numpy adds in another order differ from :func:`dot` by far less; the wider limit takes in what rounding to 5 digits may tie.
MARGIN = 2e-5


def _vectors(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows padded with zeros, and their lengths, 0 for a missing vector. A missing entry counts as NaN, which :func:`cosine` scores alike."""
    kept = [[] if x is None else np.array(x, float) for x in vectors]
    size = np.array([len(x) for x in kept], np.int64)
    out = np.zeros((len(kept), max(size.max(initial=0), 1)))
    for row, x in zip(out, kept, strict=True):
        row[: len(x)] = x
    return out, size


def _near(k: int):
    """For cogroups of rows (vec_id, v) and queries (query, q): the rows that can be among the ``k`` nearest of each query."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, own = rows.column("vec_id"), queries.column("query")
        q, of_q = _vectors(queries.column("q").to_pylist())
        best = np.full((len(q), 0), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        limit = np.full(len(q), -np.inf)
        mine, row_ids = np.array(own.to_pylist(), object), np.array(ids.to_pylist(), object)
        for start in range(0, rows.num_rows, STEP):
            v, of_v = _vectors(rows.column("v").slice(start, STEP).to_pylist())
            width = max(q.shape[1], v.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
            with np.errstate(all="ignore"):
                score = a @ b.T
            score = np.where(np.isnan(score), 1.0, np.clip(score, -1.0, 1.0))  # as greatest and least have it
            score[of_q[:, None] != of_v[None, :]] = 0.0
            score[mine[:, None] == row_ids[None, start : start + STEP]] = -np.inf
            top = np.concatenate([best, score], axis=1)
            best = -np.partition(-top, k - 1, axis=1)[:, :k] if top.shape[1] > k else top
            if best.shape[1] >= k:
                limit = np.maximum(limit, best.min(axis=1) - MARGIN)
            x, y = np.nonzero((score >= limit[:, None]) & (score > -np.inf))
            found.append((x, y + start, score[x, y]))
        x, y, near = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        keep = near >= limit[x]
        x, y = pa.array(x[keep].astype(np.int64)), pa.array(y[keep].astype(np.int64))
        return pa.table({"query": own.take(x), "q": queries.column("q").take(x), "vec_id": ids.take(y), "v": rows.column("v").take(y)})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, vec_id, score, rank: the ``k`` nearest of all ``rows`` (vec_id, v) for each of ``queries`` (query, q), itself left out.

    Exact: rows are dealt to parts by their id, queries to blocks, and each part meets each block in one product of matrices, which picks
    what can be among the ``k`` first of the part; these few are scored by :func:`cosine` and ranked. Rounded to 5 digits; ties go to
    the smaller id.
    """
    n = queries.count() // BLOCK + 1
    parts = max(PARTS, estimated_bytes(rows) // PART_BYTES)
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    asked = queries.select("query", "q", F.pmod(F.hash("query"), F.lit(n)).alias("block"), every(parts, "part"))
    # Equal vectors have equal scores: k + 1 ids of each are enough, since one may be the query's own.
    first = rows.where("vec_id is not null").select("vec_id", "v", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id")).alias("_d")).where(F.col("_d") <= k + 1)
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).where(F.col("_n") <= k)
    held = first.select("vec_id", "v", F.pmod(F.hash("vec_id"), F.lit(parts)).alias("part"), every(n, "block"))
    types = {f.name: f.dataType.simpleString() for f in (*queries.schema, *rows.schema)}
    pairs = held.groupBy("part", "block").cogroup(asked.where("query is not null").groupBy("part", "block")).applyInArrow(_near(k), ", ".join(f"{c} {types[c]}" for c in ("query", "q", "vec_id", "v")))
    scored = pairs.select("query", "vec_id", F.round(cosine(F.col("q"), F.col("v")), 5).alias("score"))
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
