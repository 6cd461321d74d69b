"""Quality classifier: ordinal cumulative-link regression over hashed text.

A document's rating is a grade from 0 to 2, one point for good quality and one for not being toxic. Its text becomes
binary hashed features: each distinct word under two independent hashes (so that no chance collision carries a word's
full weight), and steps of the shares of token shapes, repeated words and repeated lines. One weight vector is shared by all
grades; ordered thresholds turn its sum into P(grade >= k) = sigmoid(score - threshold_k), hence the expected grade and the tail
probability by which documents are selected.

Fitting takes about ``SAMPLE`` labelled documents, chosen by a hash of the id (the documented bound of what reaches the
driver); features are computed on the executors. Features enter by a score test, which keeps the noise of many thousand
chance words out of the sums; their weights are fitted by full-batch Adam on the driver. The weight vector has
2 ** BITS entries, which bounds the broadcast.

Defined results: documents without a word get tail probability 0 and are not kept; without any label every other
document is kept with tail probability 1; if no feature passes the test, nothing tells documents apart and all with words
are kept; repeated labels of an id count once, with the lower quality and the higher
toxicity; labels with nulls are not used; repeated rows get equal results; further columns are kept by :func:`graded`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents

SAMPLE = 16_000
BITS = 20
LEAST_DOCS, LEAST_Z = 3, 4.5
STEPS, RATE, DECAY = 300, 0.08, 2e-4
TAIL_GRADE = 2
#: The limit of the tail probability loses about this share of the best-rated documents of the sample, and lies within the bounds.
BEST_LOSS, LOWEST_LIMIT, HIGHEST_LIMIT = 0.004, 0.5, 0.9
MOST_CACHED = 200_000
_MASK = (1 << BITS) - 1
_LEVELS = (1 / 256, 1 / 64, 1 / 16, 1 / 4, 1 / 2, 3 / 4)
_LETTERS = re.compile(r"[^\W\d_]+")


def _buckets(name: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(name)
    return h & _MASK, (h >> 32) & _MASK


def _shape(token: str, word: str) -> str:
    """Case of a token's letters and the symbols after them."""
    tail = "".join("0" if c.isdigit() else c for c in token[-3:] if not c.isalpha())
    case = "-" if not word else "A" if len(word) > 1 and word.isupper() else "a"
    return f"\0{case}{tail}"


class Features:
    """Text -> sorted distinct feature numbers; tokens are cached up to a bound."""

    def __init__(self):
        self.cache: dict[str, tuple[int, int, str]] = {}

    def _token(self, t: str) -> tuple[int, int, str]:
        word = t if t.isalpha() else "".join(_LETTERS.findall(t))
        out = self.cache[t] = (*_buckets(word.lower() or t), _shape(t, word))
        return out

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.split()
        if not tokens:
            return np.zeros(0, np.int32)
        cache, n = self.cache, len(tokens)
        if len(cache) > MOST_CACHED:
            cache.clear()
        counts = Counter(tokens)
        out: set[int] = set()
        shapes: dict[str, int] = {}
        for t, k in counts.items():
            a, b, shape = cache.get(t) or self._token(t)
            out.add(a)
            out.add(b)
            shapes[shape] = shapes.get(shape, 0) + k
        shares = [(name, k / n) for name, k in shapes.items()]
        shares.append(("\0same", sum(map(str.__eq__, tokens, tokens[1:])) / n))
        shares.append(("\0again", 1 - len(counts) / n if n >= 20 else 0.0))
        shares.append(("\0most", max(counts.values()) / n if n >= 20 else 0.0))
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        shares.append(("\0lines", 1 - len(set(lines)) / len(lines)))
        for name, share in shares:
            for i, level in enumerate(_LEVELS):
                if share < level:
                    break
                out.update(_buckets(f"{name}\0{i}"))
        for i in range(n.bit_length()):
            out.update(_buckets(f"\0length\0{i}"))
        return np.fromiter(out, np.int32, len(out))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than there are grades
    limit: float = LOWEST_LIMIT

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each score."""
        return _sigmoid(score[:, None] - self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3) -> Model:
    """Maximum likelihood of the cumulative-link model with a small L2 penalty."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    docs_with = np.bincount(flat, minlength=1 << BITS)
    excess = np.bincount(flat, np.repeat(grades - grades.mean(), lengths), 1 << BITS)
    z = np.abs(excess) / np.sqrt(np.maximum(docs_with, 1) * max(grades.var(), 1e-9))
    kept = (docs_with >= LEAST_DOCS) & (z >= LEAST_Z)
    place = np.cumsum(kept) - 1
    doc = np.repeat(np.arange(len(rows)), lengths)[kept[flat]]
    feature = place[flat[kept[flat]]]
    size, n = int(kept.sum()), len(rows)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    w, theta = np.zeros(size), -np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(len(theta)))
    m1, m2 = np.zeros(size + len(theta)), np.zeros(size + len(theta))
    # Each grade's documents weigh alike in part, so that the rare low grades count.
    weight = np.array([np.sqrt(n / max((grades == g).sum(), 1)) for g in range(n_grades)])[grades]
    weight /= weight.sum()
    ends = np.arange(n_grades - 1)
    for step in range(1, STEPS + 1):
        s = np.bincount(doc, w[feature], n)
        at = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - theta), np.zeros((n, 1))], 1)
        low, high = at[np.arange(n), grades], at[np.arange(n), grades + 1]
        p = np.maximum(low - high, 1e-9)
        up = weight * (1 - low - high)
        slope = at[:, 1:-1] * (1 - at[:, 1:-1]) / p[:, None] * weight[:, None]
        g_theta = -(slope * (grades[:, None] == ends + 1)).sum(0) + (slope * (grades[:, None] == ends)).sum(0)
        grad = np.concatenate([np.bincount(feature, up[doc], size) - DECAY * w, g_theta])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
        w += move[:size]
        theta = np.maximum.accumulate(theta + move[size:])
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    model = Model(weights, theta)
    best = model.tails(np.bincount(doc, w[feature], n))[grades == n_grades - 1, -1]
    if not size:
        model.limit = 0.0
    elif len(best):
        model.limit = float(np.clip(np.quantile(best, BEST_LOSS), LOWEST_LIMIT, HIGHEST_LIMIT))
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a sample of the labelled documents; None if there are none."""
    bounded_batches(docs.sparkSession)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((F.min("quality") + 1 - F.max("toxic")).alias("grade"))
    total = rated.count()
    if not total:
        return None
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(2)), 11) / float(1 << 53)
    picked = rated.where((unit < sample / total) & F.col("grade").between(0, 2)).select(F.col("doc_id").alias("_fw_id"), "grade")

    def run(batches):
        features = Features()
        for b in batches:
            rows = [features(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), b.column(1)], names=["features", "grade"])

    # The sample is bounded by its parameter: about 16 bytes an id.
    joined = docs.where("text is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("_fw_id")).select("text", F.col("grade").cast("int"))
    got = joined.mapInArrow(run, "features array<int>, grade int").toArrow()
    if not len(got):
        return None
    column = got.column("features").combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    return fit([flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], got.column("grade").to_numpy())


def graded(docs: DataFrame, model: Model | None, limit: float | None = None, grade: int = TAIL_GRADE) -> DataFrame:
    """``docs`` with expected_grade, p_tail (that of ``grade`` or better) and kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    limit = (LOWEST_LIMIT if model is None else model.limit) if limit is None else limit

    def run(batches):
        m, features = shared.value, Features()
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            some = np.array([not (x == "" or x.isspace()) for x in texts], bool)
            if m is None:
                tails = np.ones((len(texts), grade))
            else:
                tails = m.tails(np.array([float(m.weights[features(x)].sum(dtype=np.float64)) for x in texts]))
            tails = tails * some[:, None]
            tail = tails[:, grade - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(1)), pa.array(tail), pa.array((tail >= limit) & some)], names=["_fw_row", "expected_grade", "p_tail", "kept"])

    new = ("expected_grade", "p_tail", "kept")
    packed = docs.select(F.struct("*").alias("_fw_row"), F.col("text").cast("string").alias("_fw_text"))
    made = packed.mapInArrow(run, f"_fw_row {packed.schema['_fw_row'].dataType.simpleString()}, expected_grade double, p_tail double, kept boolean")
    return made.select(*[f"_fw_row.{c}" for c in docs.columns if c not in new], *new)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return graded(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
