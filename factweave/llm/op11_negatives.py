"""Hard-negative mining by a two-dimensional block matrix multiply.

Rows are dealt out by range of (label, id) and packed into blocks of ROWS rows and chunks of dimensions; anchors likewise into
blocks of ANCHORS. Anchor chunks are copied along the columns of a grid, row chunks along its lines; each cell multiplies its chunks
to partial tiles of long scores, and a shuffle adds the partials of a tile. A tile is reduced where it is added: first, over
the tiles whose label ranges meet, to the best rows of an anchor's own label, which after their merge give each anchor's
positives and so the window of each pair; then, over all tiles but those of one label, to the best rows of another label in each
window. So every score is made once, but for blocks on a border of labels, and only heads of tiles are shuffled again.

No tile outgrows ANCHORS * ROWS scores and at most MOST_CHUNKS partials meet in a group, whatever the dimension. Ranges split hot labels.

Defined results: rows without an id take no part; a row that repeats an id is a row of its own, but no other row of itself, and an
anchor that is repeated gives its results again; the dimension is the most frequent length of the vectors (the greater of
ties), rows of another length take no part, as they lack entries; components so large that scores would not fit a long stop
at +-2^26 (dimensions up to 1,024; fewer bits beyond); a window of a negative positive score is empty; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, collected, materialize, release
from .op13_whitening import dimension, integers

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Anchors and rows of a tile, dimensions of a chunk, and chunks at most (then they are wider).
ANCHORS, ROWS, CHUNK, MOST_CHUNKS = 128, 4096, 32, 8
#: Blocks of a line, and of a column, of a grid cell.
CELL = 8
_BLOCK = "block long, k int, lo long, hi long, ids binary, labels binary, width int, m binary"
_NONE = np.iinfo(np.int64).min


def _packed(rows: DataFrame, size: int, d: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` rows (vec_id, label, x), sorted by label and id in each partition, in chunks of dimensions."""
    chunk = max(CHUNK, -(-d // MOST_CHUNKS))
    limit = 1 << min(26, (62 - max(d, 1).bit_length()) // 2)

    def pack(batches):
        place, held, n, nth = TaskContext.get().partitionId() << 32, [], 0, 0

        def blocks(table):
            nonlocal nth
            ids, labels = (table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("x").chunks]).reshape(len(ids), d).clip(-limit, limit)
            kind = next(t for t in (np.int16, np.int32) if t is np.int32 or np.abs(x).max(initial=0) < 1 << 15)
            for k, at in enumerate(range(0, d, chunk)):
                part = x[:, at : at + chunk].astype(kind)
                own = (ids.tobytes(), labels.tobytes()) if k == 0 else (None, None)  # once a block
                yield place + nth, k, labels[0], labels[-1], *own, part.itemsize, part.tobytes()
            nth += 1

        def out(tuples):
            columns = zip(*tuples, strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "k", "lo", "hi", "ids", "labels", "width", "m"])

        for b in batches:
            held.append(b)
            n += len(b)
            if n >= size:
                table = pa.Table.from_batches(held)
                while n >= size:
                    yield out(blocks(table.slice(0, size)))
                    table, n = table.slice(size), n - size
                held = table.to_batches()
        if n:
            yield out(blocks(pa.Table.from_batches(held)))

    return materialize(rows.mapInArrow(pack, _BLOCK), name)


def _matrix(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"i{width}").reshape(rows, -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in longs; in doubles on the way where these are exact."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _partials(batches):
    for x in batches:
        for r in x.to_pylist():
            rows, anchors = r["n_b"], r["n_a"]
            tile = product(_matrix(r["a_m"], r["a_width"], anchors), _matrix(r["b_m"], r["b_width"], rows))
            small = tile.astype(np.int32)
            kept = small if (small == tile).all() else tile  # what the shuffle carries; sums are longs
            values = [r["i"], r["j"], r["a_ids"], r["a_labels"], r["b_ids"], r["b_labels"], r["windows"], kept.itemsize, kept.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PARTIAL.types, strict=True)], schema=_PARTIAL)


_WINDOWS = pa.list_(pa.struct([("row", pa.int32()), ("place", pa.int32()), ("positive", pa.int64()), ("score", pa.int64())]))
_PARTIAL = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("a_ids", pa.binary()), ("a_labels", pa.binary()), ("b_ids", pa.binary()), ("b_labels", pa.binary()), ("windows", _WINDOWS), ("width", pa.int32()), ("tile", pa.binary())])
_PARTIAL_SQL = "i long, j long, a_ids binary, a_labels binary, b_ids binary, b_labels binary, windows array<struct<row int, place int, positive long, score long>>, width int, tile binary"
_HEADS = pa.schema([("i", pa.int64()), ("row", pa.int32()), ("anchor", pa.int64()), ("place", pa.int32()), ("positive", pa.int64()), ("bound", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_HEADS_SQL = "i long, row int, anchor long, place int, positive long, bound long, id long, score long"


def best_of_label(tile, a_ids, a_labels, b_ids, b_labels, k: int) -> list[tuple]:
    """row, anchor, null, null, null, id, score of the ``k`` best rows of each anchor's own label, itself left out; rows are sorted by label and id."""
    out = []
    for row, (anchor, label) in enumerate(zip(a_ids.tolist(), a_labels.tolist(), strict=True)):
        at = np.arange(np.searchsorted(b_labels, label), np.searchsorted(b_labels, label, "right"))
        at = at[b_ids[at] != anchor]
        at = at[np.argsort(-tile[row, at], kind="stable")[:k]]
        out += [(row, anchor, None, None, None, i, s) for i, s in zip(b_ids[at].tolist(), tile[row, at].tolist(), strict=True)]
    return out


def best_in_windows(tile, a_ids, a_labels, b_ids, b_labels, windows, k: int, low: int, high: int) -> list[tuple]:
    """row, anchor, place, positive, bound, id, score of the ``k`` best rows of another label in each window: percent of the positive's score."""
    by_id = np.argsort(b_ids, kind="stable")
    ids, scores = b_ids[by_id], tile[:, by_id]
    scores = np.where(a_labels[:, None] == b_labels[by_id], _NONE + 1, scores)
    rows = sorted({w["row"] for w in windows})
    order = dict(zip(rows, np.argsort(-scores[rows], axis=1, kind="stable"), strict=True))
    out = []
    for w in windows:
        row, positive = w["row"], w["score"]
        if positive < 0:
            continue
        at = order[row]
        falling = scores[row, at]
        first = np.searchsorted(-falling, -(high * positive // 100))
        take = slice(first, min(first + k, np.searchsorted(-falling, (-low * positive) // 100, "right")))
        out += [(row, int(a_ids[row]), w["place"], w["positive"], positive, i, s) for i, s in zip(ids[at[take]].tolist(), falling[take].tolist(), strict=True)]
    return out


def _reduced(head):
    """The function for a group of partial tiles: their sum, then ``head`` of it."""

    def reduce(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        own = next(p for p in parts if p["a_ids"] is not None)
        ids = [np.frombuffer(own[c], np.int64) for c in ("a_ids", "a_labels", "b_ids", "b_labels")]
        tile = np.zeros((len(ids[0]), len(ids[2])), np.int64)
        for p in parts:
            tile += np.frombuffer(p["tile"], f"i{p['width']}").reshape(tile.shape)
        found = head(tile, *ids, own["windows"])
        columns = [[own["i"]] * len(found), *(zip(*found, strict=True) if found else [[]] * 7)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _HEADS.types, strict=True)], schema=_HEADS)

    return reduce


def _tiles(anchors: DataFrame, rows: DataFrame, meets: str, head) -> DataFrame:
    """Heads of the tiles of ``anchors`` (blocks, with windows) and ``rows`` (blocks) whose label ranges satisfy ``meets``."""
    lines, columns = (-(-x.agg(F.count_distinct("block")).first()[0] // CELL) or 1 for x in (anchors, rows))

    def side(x: DataFrame, name: str, own: str, n: int, other: str, copies: int) -> DataFrame:
        dealt = x.select(*[F.col(c).alias(f"{name}_{c}") for c in x.columns]).withColumn(own, F.pmod(F.xxhash64(f"{name}_block"), F.lit(n)))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumnRenamed(f"{name}_k", "k")

    a, b = side(anchors, "a", "line", lines, "column", columns), side(rows, "b", "column", columns, "line", lines)
    cells = a.join(b, ["line", "column", "k"]).where(meets)
    ready = cells.select(
        F.col("a_block").alias("i"), F.col("b_block").alias("j"), "a_ids", "a_labels", "b_ids", "b_labels", F.col("a_windows").alias("windows"), F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"), "a_width", "b_width", "a_m", "b_m"
    )
    return ready.mapInArrow(_partials, _PARTIAL_SQL).groupBy("i", "j").applyInArrow(_reduced(head), _HEADS_SQL)


def hard_negatives(
    rows: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label and the vector).

    ``low`` and ``high``: the window's ends, in percent of the positive's score.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scaled = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(vector).alias("x")).where("vec_id is not null and label is not null and x is not null")
    d = dimension(scaled)
    valid = scaled.where(F.size("x") == d)
    order = ["label", "vec_id"]
    blocks = _packed(valid.repartitionByRange(*order).sortWithinPartitions(*order), ROWS, d, "blocks")
    own = valid.where(is_anchor)
    few = -(-own.count() // (ANCHORS * CELL)) or 1
    lines = _packed(own.repartitionByRange(*order).coalesce(few).sortWithinPartitions(*order), ANCHORS, d, "anchors")

    def counted(x: DataFrame) -> DataFrame:
        """With the number of rows of each block, which only its first chunk tells."""
        chunk = max(CHUNK, -(-d // MOST_CHUNKS))
        wide = F.least(F.lit(chunk), F.lit(d) - F.col("k") * chunk)
        return x.withColumn("n", (F.octet_length("m") / (F.col("width") * wide)).cast("int"))

    blocks_n, lines_n = counted(blocks), counted(lines)
    nothing = F.lit(None).cast("array<struct<row int, place int, positive long, score long>>")
    same = _tiles(lines_n.withColumn("windows", nothing), blocks_n, "a_lo <= b_hi and b_lo <= a_hi", lambda t, ai, al, bi, bl, _: best_of_label(t, ai, al, bi, bl, positives))
    of_anchor = Window.partitionBy("i", "row").orderBy(F.col("score").desc(), "id")
    best = same.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= positives)
    windows = materialize(best.groupBy("i").agg(F.collect_list(F.struct("row", "place", F.col("id").alias("positive"), "score")).alias("windows")), "windows")  # ANCHORS * positives at most
    windowed = lines_n.join(windows, lines_n.block == windows.i).select(*lines_n.columns, F.when(F.col("k") == 0, F.col("windows")).alias("windows"))
    other = _tiles(windowed, blocks_n, "not (a_lo = a_hi and b_lo = b_hi and a_lo = b_lo)", lambda t, ai, al, bi, bl, w: best_in_windows(t, ai, al, bi, bl, w, negatives, low, high))
    of_pair = Window.partitionBy("i", "row", "place").orderBy(F.col("score").desc(), "id")
    ranked = materialize(other.withColumn("rank", F.row_number().over(of_pair)).where(F.col("rank") <= negatives), "negatives")
    release(blocks, lines, windows)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("bound").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))))


SQL = {
    "op11_negatives": f"""
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
rows AS (SELECT * FROM valid WHERE len(x) = (SELECT d FROM (SELECT len(x) AS d, count(*) AS n FROM valid WHERE len(x) > 0 GROUP BY 1) ORDER BY n DESC, d DESC LIMIT 1)),
scores AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
WHERE rank <= {NEGATIVES}""",
}
