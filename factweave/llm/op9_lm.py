"""Language-model scoring by a weighted backoff automaton.

Training counts every word and every longer n-gram up to ``order`` of every training document. Longer n-grams seen at least
``LEAST_COUNT`` times, whatever the corpus, are the model's arcs, with absolute discounting; each context that has arcs has a
failure weight, the mass that discounting leaves, normalised. All of them are rows of tables, keyed by a 64-bit hash;
none is dropped for the corpus' size, so the tables grow with it.

A path's score is a sum over the text's n-grams: a word gives log p(w) and its failure weight; an arc gives what it
changes against failing, log p(w | context) - failure weight - log p(w | shorter context), and its own failure weight. So the
model can be read in two parts without changing the sum. The hot part, n-grams of at least HOT_SHARE of all tokens and so at
most 1 / HOT_SHARE of each length, is an automaton that is broadcast with the whole model's weights: a state is the longest
suffix that is a context, a missing arc follows the state's failure arc. Each text's other distinct n-grams are joined to the
tables in one shuffle by n-gram, pre-aggregated by text.

A bitmap of fixed 2 ** BITMAP_BITS bits spares n-grams that are in no table that shuffle; a false hit costs a row, never
a result, and with far more n-grams than bits all are shuffled. N-grams and words are told apart by 64-bit hashes: of n
different ones, n ** 2 / 2 ** 65 pairs are expected to share one.

Defined results: a null or empty text is the end token alone; with an empty training part every probability is 1;
repeated rows are scored and counted each; the score of a text does not depend on the others in its batch; further
columns are ignored; an empty table gives an empty result. Rows without an id belong to the fold of crc32('').
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, collected, documents, materialize, release, remainder, row_key, utf8

FOLDS, HELD_OUT = 7, 2
ORDER = 2
LEAST_COUNT = 2
HOT_SHARE = 2e-7
SEED, BITMAP_BITS = 42, 27
DISCOUNT = 0.5
END = b"\n"  # no word holds white space
END_HASH = np.uint64(xxhash.xxh64_intdigest(END, SEED))
MOST_PARTIAL = 1_000_000


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and the end."""
    out = text.lower().split()
    out.append(END)
    return out


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, one text after the other, and the number of each text's tokens."""
    parts = []
    for x in texts:
        t = tokens(x)
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, t, repeat(SEED)), np.uint64, len(t)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.fromiter(map(len, parts), np.int64, len(parts))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hashed(x: np.ndarray, seed) -> np.ndarray:
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (np.asarray(seed, np.uint64) + (p5 + np.uint64(8))) ^ (_rotated(x * p2, 31) * p1)
    h = _rotated(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(x, y) of longs, as unsigned."""
    return _hashed(y, _hashed(x, np.full(1, SEED, np.uint64)))


def longer(keys: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of one token more, by their last token, and which of them there are: none goes on after an end.

    ``keys``, ``valid``: of the shorter ones. A key joins those of the n-gram's context and suffix.
    """
    out, there = np.zeros_like(keys), np.zeros_like(valid)
    out[1:] = joined(keys[:-1], keys[1:])
    there[1:] = valid[1:] & valid[:-1] & (h[:-1] != END_HASH)
    return out, there


@dataclass
class Automaton:
    """Hot words by hash, and the arcs between states by number of state and word; state 0 is the root."""

    word: np.ndarray  # hashes, ascending
    logs: np.ndarray  # log10 of each word's smoothed probability
    start: np.ndarray  # the state after a word seen at the root
    arc: np.ndarray  # state * number of words + word, ascending
    value: np.ndarray  # log10 probability of each arc
    after: np.ndarray  # the state behind each arc
    fail: np.ndarray
    weight: np.ndarray
    depth: int  # most words of a state

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Number of each word; -1 for words that aren't hot."""
        return places(self.word, h)

    def arcs(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Place of each arc, or -1."""
        return np.where((ids >= 0) & (state > 0), places(self.arc, state * max(len(self.word), 1) + ids), -1)

    def states(self, ids: np.ndarray) -> np.ndarray:
        """The state before each token of a run of texts, each closed by the end, which leads to the root.

        A state is the longest suffix that is a context, so those of one more word follow from those of one less.
        """
        state = np.where(ids >= 0, self.start[ids], 0) if len(self.start) else np.zeros(len(ids), np.int64)
        for _ in range(self.depth - 1):
            arc = self.arcs(np.concatenate([[0], state[:-1]]), ids)
            state = np.where(arc >= 0, self.after[arc], state) if len(self.after) else state
        return np.concatenate([[0], state[:-1]])

    def traverse(self, ids: np.ndarray) -> np.ndarray:
        """What each token adds: failure weights until the state has the arc, then the arc; at the root the word."""
        out, state, open_ = np.zeros(len(ids)), self.states(ids), np.arange(len(ids))
        while len(open_):
            s, w = state[open_], ids[open_]
            arc = self.arcs(s, w)
            hit, root = arc >= 0, s == 0
            out[open_[hit]] += self.value[arc[hit]]
            last = open_[root & ~hit & (w >= 0)]
            out[last] += self.logs[ids[last]]
            open_ = open_[~hit & ~root]
            out[open_] += self.weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return out


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the ascending table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    """The automaton of hot n-grams, and the table of all others: key, c (of words only), value, bo."""

    cold: DataFrame
    bits: np.ndarray  # bitmap of the cold keys of n-grams
    total: int
    distinct: int
    hot: Automaton
    order: int

    def log_unigram(self, c: float) -> float:
        return math.log10((c + 1) / (self.total + self.distinct + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cold"}


def hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[k >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) == 1


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the column key, as 64-bit words; at most 2 ** (BITMAP_BITS - 6) rows reach the driver."""
    bit = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    got = collected(keys.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("one")).groupBy("at").agg(F.bit_or("one").alias("bits")))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def count_grams(texts: DataFrame, parts_of) -> DataFrame:
    """x, y, n: exact counts of the n-grams that ``parts_of(hashes)`` gives by context and suffix, as arrays x, y, n; of words (y = 0) all, of others those of at least LEAST_COUNT.

    A task counts its own texts first, in bounded memory, so a hot n-gram is shuffled once a task.
    """

    def summed(x, y, n):
        key = joined(x, y)
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = order[starts]
        return x[first], y[first], np.add.reduceat(n[order], starts)

    def run(batches):
        held: list[tuple] = []
        fresh = 0

        def merged():
            return summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

        def given(x, y, n):
            for at in range(0, len(x), 1 << 18):
                s = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(x[s].view(np.int64)), pa.array(y[s].view(np.int64)), pa.array(n[s])], names=["x", "y", "n"])

        for b in batches:
            x, y, n = parts_of(hashed(b.column(0).to_pylist())[0])
            if len(x):
                held.append((x, y, n))
                fresh += len(x)
            if fresh > MOST_PARTIAL:
                held, fresh = [merged()], 0
                if len(held[0][0]) > MOST_PARTIAL:
                    yield from given(*held[0])
                    held = []
        if held:
            yield from given(*merged())

    return texts.mapInArrow(run, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_COUNT) | (F.col("y") == 0))


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Fit on all of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(utf8(text).alias("data"))

    def words_and_pairs(h: np.ndarray):
        word, n = np.unique(h, return_counts=True)
        at = np.flatnonzero(h[:-1] != END_HASH)
        return np.concatenate([word, h[at]]), np.concatenate([np.zeros(len(word), np.uint64), h[at + 1]]), np.concatenate([n, np.ones(len(at), np.int64)])

    counted = materialize(count_grams(texts, words_and_pairs), "grams")
    words = counted.where("y = 0").select(F.col("x").alias("key"), F.col("n").alias("c"))
    row = collected(words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"))).to_pylist()[0]
    total, distinct = int(row["n"]), int(row["v"])
    least = max(HOT_SHARE * total, LEAST_COUNT)
    shorter = words.select("key", "c", ((F.col("c") + 1) / F.lit(float(total + distinct + 1))).alias("p"))
    pairs, levels, contexts, made = counted.where("y <> 0"), [], [], [counted]
    for n in range(2, order + 1):
        if n > 2:
            pairs = materialize(count_grams(texts, _longest_of(spark, shorter, n)), f"grams{n}")
        of_suffix, of_context = shorter.select(F.col("key").alias("y"), F.col("p").alias("lower")), shorter.select(F.col("key").alias("x"), "c")
        with_lower = materialize(pairs.join(of_suffix, "y"), f"lower{n}")
        sums = with_lower.groupBy("x").agg(F.sum(F.col("n") - DISCOUNT).alias("held"), F.sum("lower").alias("low"))
        left, rest = (F.greatest(1 - c, F.lit(1e-12)) for c in (F.col("held") / F.col("c"), F.col("low")))
        context = materialize(of_context.join(sums, "x").select("x", "c", F.log10(left / rest).alias("bo")), f"contexts{n}")
        p, hot = (F.col("n") - DISCOUNT) / F.col("c"), F.col("n") >= least
        level = with_lower.join(context, "x").select(
            F.xxhash64("x", "y").alias("key"), F.col("n").alias("c"), p.alias("p"), (F.log10(p) - F.col("bo") - F.log10("lower")).alias("value"), F.when(hot, F.col("x")).alias("x"), F.when(hot, F.col("y")).alias("y")
        )
        levels.append(materialize(level, f"level{n}"))
        contexts.append(context.select(F.col("x").alias("key"), "c", "bo"))
        release(with_lower, *([pairs] if n > 2 else []))
        made += [context, levels[-1]]
        shorter = levels[-1]
    # At most 1 / HOT_SHARE rows of each length.
    is_hot = F.col("c") >= least
    hot = [collected(t.where(is_hot).select(*columns)) for t, columns in zip([words, *levels], [("key", "c"), *[("key", "p", "x", "y")] * len(levels)], strict=True)]
    weights = [collected(t.where(is_hot).select("key", "bo")) for t in contexts]
    none = F.lit(None)
    cold = words.select("key", "c", none.cast("double").alias("value")).where(~is_hot).join(contexts[0].select("key", "bo"), "key", "left")
    for t, own in zip(levels, [*contexts[1:], None], strict=True):
        rest = t.where(~is_hot).select("key", none.cast("long").alias("c"), "value")
        cold = cold.unionByName(rest.withColumn("bo", none.cast("double")) if own is None else rest.join(own.select("key", "bo"), "key", "left"))
    cold = materialize(cold, "cold")
    release(*made)
    return Model(cold, bitmap(cold.where("c is null")), total, distinct, _automaton(hot, weights, total, distinct), order)


def _longest_of(spark: SparkSession, shorter: DataFrame, n: int):
    """The parts of n-grams of length ``n`` of which both parts were seen twice, as far as a bitmap tells."""
    seen = spark.sparkContext.broadcast(bitmap(shorter))

    def parts_of(h: np.ndarray):
        keys, valid = h, np.ones(len(h), bool)
        for _ in range(n - 2):
            keys, valid = longer(keys, valid, h)
        valid &= hits(seen.value, keys)
        at = np.flatnonzero(valid[1:] & valid[:-1] & (h[:-1] != END_HASH))
        return keys[at], keys[at + 1], np.ones(len(at), np.int64)

    return parts_of


def _automaton(hot: list[pa.Table], weights: list[pa.Table], total: int, distinct: int) -> Automaton:
    """States are the hot n-grams that are contexts, with their failure weights; parts of a hot n-gram are hot themselves."""

    def read(t: pa.Table) -> dict[str, np.ndarray]:
        order = np.argsort(t.column("key").to_numpy().view(np.uint64))
        out = {c: t.column(c).to_numpy()[order] for c in t.column_names}
        return out | {c: out[c].astype(np.int64).view(np.uint64) for c in ("key", "x", "y") if c in out}

    tables = [read(t) for t in hot]
    for t, w in zip(tables, [*map(read, weights), None], strict=True):
        t["bo"] = np.full(len(t["key"]), np.nan)  # no context
        if w is not None and len(t["key"]):
            t["bo"][places(t["key"], w["key"])] = w["bo"]
    word, *longer_ = tables
    width = max(len(word["key"]), 1)
    fail, weight, arcs, values, after = [np.zeros(1, np.int64)], [np.zeros(1)], [], [], []
    known, number, last = word, np.zeros(len(word["key"]), np.int64), np.arange(len(word["key"]))
    states = 1

    def numbered(t, suffix_state):
        """The state of each n-gram: its own if it is a context, else that of its suffix."""
        nonlocal states
        own = ~np.isnan(t["bo"])
        out = suffix_state.copy()
        out[own] = states + np.arange(own.sum())
        states += int(own.sum())
        fail.append(suffix_state[own])
        weight.append(t["bo"][own])
        return out

    number = start = numbered(word, number)
    for t in longer_:
        x, y = places(known["key"], t["x"]), places(known["key"], t["y"])
        context, last = number[x], last[y]
        number = numbered(t, number[y])
        arcs.append(context * width + last)
        values.append(np.log10(t["p"].astype(np.float64)))
        after.append(number)
        known = t
    arc = np.concatenate(arcs) if arcs else np.zeros(0, np.int64)
    order = np.argsort(arc)
    value, behind = (np.concatenate(c)[order] if arcs else np.zeros(0, k) for c, k in ((values, np.float64), (after, np.int64)))
    return Automaton(word["key"], np.log10((word["c"].astype(np.float64) + 1) / (total + distinct + 1)), start, arc[order], value, behind, np.concatenate(fail), np.concatenate(weight), len(longer_))


def score(docs: DataFrame, model: Model, held_out: Column, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    part = pa.struct([("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def run(batches):
        """A row with the automaton's sums for each text, and a row for each n-gram of it that isn't in the automaton."""
        m = shared.value
        for b in batches:
            h, size = hashed(b.column(2).to_pylist())
            text_of, ids = np.repeat(np.arange(len(size)), size), m.hot.ids(h)
            hot = np.flatnonzero(ids >= 0)
            sums = [np.bincount(text_of[at], w, len(size)) for at, w in ((hot, None), (hot, m.hot.logs[ids[hot]]), (slice(None), m.hot.traverse(ids)))]
            loose = [(h[ids < 0], text_of[ids < 0])]
            keys, valid = h, np.ones(len(h), bool)
            for _ in range(m.order - 1):
                keys, valid = longer(keys, valid, h)
                at = np.flatnonzero(valid & hits(m.bits, keys))
                loose.append((keys[at], text_of[at]))
            own = pa.StructArray.from_arrays([pa.array(size), pa.array(sums[0].astype(np.int64)), *(pa.array(x.astype(np.float64)) for x in sums[1:])], fields=list(part))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(1), pa.array(np.zeros(len(size), bool)), own], names=names)
            key, of = (np.concatenate(c) for c in zip(*loose, strict=True))
            word = np.arange(len(key)) < len(loose[0][0])
            order = np.argsort(of, kind="stable")
            for at in range(0, len(order), 1 << 18):
                o = order[at : at + (1 << 18)]
                t = pa.array(of[o])
                yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), pa.array(key[o].view(np.int64)), pa.array(word[o]), pa.nulls(len(o), part)], names=names)

    names = ["doc_id", "k", "key", "word", "own"]
    row = [F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", text).alias("k")]
    rows = docs.select(*row, utf8(text).alias("data")).mapInArrow(run, "doc_id long, k long, key long, word boolean, own struct<tokens:bigint,known:bigint,base:double,model:double>")
    c, zero = F.coalesce("c", F.lit(0)), F.lit(0.0)
    base = F.when(F.col("word"), F.log10((c + 1) / F.lit(float(model.total + model.distinct + 1)))).otherwise(zero)
    found = rows.join(model.cold, "key", "left").select(
        "doc_id", "k", "own", base.alias("base"), (base + F.coalesce("value", zero) + F.coalesce("bo", zero)).alias("model"), (F.col("word") & (c > 0)).cast("long").alias("known"),
    )
    sums = materialize(
        found.groupBy("doc_id", "k").agg(
            F.count("own").alias("copies"), F.sum("own.tokens").alias("n_tokens"), (F.sum("known") + F.sum("own.known")).alias("n_known"),
            (F.sum("base") + F.sum("own.base")).alias("base_score"), (F.sum("model") + F.sum("own.model")).alias("score"),
        ), "scores",
    )
    # Rows equal in id and text were summed together: each has its share.
    each = sums.select(F.col("doc_id").alias("id"), F.col("k").alias("of"), *[(F.col(x) / F.col("copies")).cast(kind).alias(x) for x, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))])
    picked = docs.select(*row, held_out.alias("held_out"))
    return picked.join(each, (F.col("k") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = remainder("doc_id", FOLDS) == HELD_OUT
    model = train(docs.where(~held))
    out = score(docs, model, held)
    release(model.cold)
    return out
