"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of whole documents in a task's partition. Its words become symbols: those of the benchmark's vocabulary a number each, all
others a break. Stretches between breaks that are shorter than the shortest phrase can hold none and are left out; the rest is
indexed: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix whose bits are ranked by popcounts, and the position of
every SAMPLE-th symbol. All phrases are searched backwards at once, a symbol a step; the occurrences found are located by walking
back to a sampled position, and overlapping ones merge to removal spans. Documents are read once and not shuffled; a shard
ends at SHARD symbols, so its memory does not grow with the corpus.

Phrases are windows of WINDOW words of an item, or the whole item if it has fewer. They are broadcast, in parts of at most PART_BYTES of
benchmark text; a benchmark of several parts has the documents read once a part and their spans merged by document.

Defined results: a null or empty text, or one without a word, has no words, no hits and no items; items without words
match nothing; items without an id cause hits, but are not listed among the items; items of equal text are listed both; repeated rows are rows of
their own, as are documents without an id; an empty table gives an empty result, an empty benchmark no hits; further columns are ignored by :func:`located` and kept by
:func:`without_passages`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, collected, documents, materialize, utf8

WINDOW = 10
#: Symbols of a shard, bytes of the documents that it holds, words between sampled positions, bytes cut into words at once.
SHARD, SHARD_BYTES, SAMPLE, PIECE = 1 << 20, 32 << 20, 8, 1 << 20
#: Benchmark text broadcast at once.
PART_BYTES = 4 << 20
#: Words are runs of digits, letters and all beyond ASCII; A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of UTF-8 bytes, in lists of a piece each."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _TABLE[data[end]] != 32:
            end += 1
        yield data[at:end].translate(_TABLE).split()
        at = end


class Phrases:
    """The distinct windows of items as rows of symbols, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.symbol.setdefault(w, len(self.symbol) + 1) for part in words(text) for w in part]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).update([] if item is None else [item])
        self.owners = list(owners.values())
        self.length = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)  # from the right, so that searches go along a row
        for n, p in enumerate(owners):
            self.rows[n, : len(p)] = p[::-1]
        self.least = int(self.length.min(initial=window))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of symbols; each 0 is a break of its own, so no comparison goes beyond one. Ends with a break."""
    n, breaks = len(s), s == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, s + int(breaks.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1

    def starts(sorted_keys: np.ndarray) -> np.ndarray:
        """The place of the first of each run of equals."""
        new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    rank[order] = starts(rank[order])
    while True:
        tied = np.bincount(rank, minlength=n)[rank] > 1  # only these are sorted on
        open_ = np.flatnonzero(tied)
        if not len(open_):
            order[rank] = np.arange(n)
            return order
        key = rank[open_] * np.int64(n + 1) + rank[open_ + step]  # equals reach no break before ``step``, so this is inside
        by = np.argsort(key, kind="stable")
        sorted_ = open_[by]
        group = rank[sorted_]
        base = group - starts(group)
        rank[sorted_] = base + starts(key[by])
        step *= 2


class Wavelet:
    """Wavelet matrix of symbols: a bit vector a level, ranked by the counts before each 64 bits and a popcount."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols).bit_length())
        self.levels = []
        for at in range(self.bits - 1, -1, -1):
            bit = (s >> at) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.r_[packed, np.zeros(8 + -len(packed) % 8, np.uint8)].view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)]
            self.levels.append((packed, before, len(s) - int(bit.sum())))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.start = self._down(np.zeros(symbols + 1, np.int64), np.arange(symbols + 1))

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for n, level in enumerate(self.levels):
            ones = self._ones(level, at)
            at = np.where((symbol >> (self.bits - 1 - n)) & 1, level[2] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before the places ``at``."""
        return self._down(at, symbol) - self.start[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each stands before."""
        symbol = np.zeros(len(at), np.int64)
        for level in self.levels:
            word = level[0][at >> 6] >> (at & 63).astype(np.uint64)
            bit = (word & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            symbol = symbol * 2 + bit
            at = np.where(bit, level[2] + ones, at - ones)
        return symbol, at - self.start[symbol]


class Index:
    """FM-index of symbols; 0 breaks, and the last symbol is one."""

    def __init__(self, s: np.ndarray, symbols: int):
        sa = suffix_array(s)
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=symbols + 1))]
        self.bwt = Wavelet(s[sa - 1], symbols)
        # Nothing is walked across a break, so what follows one is sampled as well.
        self.sampled = (sa % SAMPLE == 0) | (s[sa - 1] == 0)
        self.position = sa[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern, given from its last symbol to its first."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.sampled), np.int64)
        for step in range(rows.shape[1]):
            on = np.flatnonzero((step < length) & (low < high))
            symbol = rows[on, step]
            low[on], high[on] = self.before[symbol] + self.bwt.rank(symbol, low[on]), self.before[symbol] + self.bwt.rank(symbol, high[on])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of suffixes."""
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            symbol, rank = self.bwt.read(at[walking])
            at[walking] = self.before[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.position[self.nth[at]] + steps


def occurrences(texts: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, word and phrase of every occurrence in the ``texts`` of a shard, given as symbols."""
    parts, text_of, word_of = [], [], []
    for n, s in enumerate(texts):
        known = np.flatnonzero(np.diff(np.r_[False, s > 0, False].view(np.int8)))
        for start, end in known.reshape(-1, 2)[np.diff(known)[::2] >= phrases.least].tolist():
            parts += [s[start:end], np.zeros(1, s.dtype)]
            text_of.append(np.full(end - start + 1, n))
            word_of.append(np.arange(start, end + 1))
    none = np.zeros(0, np.int64)
    if not parts or not len(phrases.rows):
        return none, none, none
    index = Index(np.concatenate(parts).astype(np.int64), len(phrases.symbol))
    low, high = index.search(phrases.rows, phrases.length)
    found = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(found)), found)
    at = index.locate(np.repeat(low - np.r_[0, np.cumsum(found)[:-1]], found) + np.arange(found.sum()))
    return np.concatenate(text_of)[at], np.concatenate(word_of)[at], phrase


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans [start, end) that overlap or touch as one."""
    if not len(start):
        return []
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.r_[True, start[1:] > end[:-1]]
    return list(zip(start[new].tolist(), end[np.r_[new[1:], True]].tolist(), strict=True))


def shards(batches, phrases: Phrases, most: int):
    """Shards of batches whose first column is a text's bytes: the other columns, and each row's number of words, spans of words hit and ids of items. Ends a shard at ``most`` symbols."""
    held, texts, size, n_bytes = [], [], 0, 0

    def flush():
        text, word, phrase = occurrences(texts, phrases)
        by = np.argsort(text, kind="stable")
        text, word, phrase = text[by], word[by], phrase[by]
        edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        spans, items = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            spans.append(merged(word[a:b], word[a:b] + phrases.length[phrase[a:b]]))
            items.append(sorted(set().union(*(phrases.owners[p] for p in np.unique(phrase[a:b]).tolist()))))
        return pa.Table.from_batches(held), [len(t) for t in texts], spans, items

    for batch in batches:
        rest, first = batch.select(batch.schema.names[1:]), 0
        for at, data in enumerate(batch.column(0)):  # a batch may be larger than a shard
            data = data.as_py()
            s = [np.fromiter(map(phrases.symbol.get, w, repeat(0)), np.int32, len(w)) for w in words(data)]
            texts.append(np.concatenate(s) if s else np.zeros(0, np.int32))
            size, n_bytes = size + int(np.count_nonzero(texts[-1])), n_bytes + len(data) + texts[-1].nbytes
            if size >= most or n_bytes >= SHARD_BYTES:
                held.append(rest.slice(first, at + 1 - first))
                yield flush()
                held, texts, size, n_bytes, first = [], [], 0, 0, at + 1
        held.append(rest.slice(first))
    if texts:
        yield flush()


_FOUND = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string())}
_FOUND_SQL = "n_words long, spans array<struct<start long, end long>>, items array<string>"


def _with_phrases(docs: DataFrame, text: str, keep: Column, phrases: Phrases) -> DataFrame:
    """kept (what ``keep`` gives), n_words, spans, items of the documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(phrases)
    rows, most = docs.select(utf8(text).alias("data"), keep.alias("kept")), SHARD

    def run(batches):
        for table, n_words, spans, items in shards(batches, shared.value, most):
            spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
            for name, values in zip(_FOUND, (n_words, spans, items), strict=True):
                table = table.append_column(name, pa.array(values, _FOUND[name]))
            yield from table.to_batches(max_chunksize=512)

    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, {_FOUND_SQL}")


def union_of(spans: Column) -> Column:
    """Spans [start, end) that overlap or touch as one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, add)


def located(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: Column | None = None, text: str = "text", part_bytes: int | None = None) -> DataFrame:
    """kept, n_words, spans, items of every document; ``keep`` is doc_id unless given. Spans are of words, merged; items are sorted as strings."""
    bounded_batches(docs.sparkSession)
    keep = F.col("doc_id") if keep is None else keep
    part_bytes = part_bytes or PART_BYTES
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("data"))
    n_bytes = bench.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = 1 if n_bytes <= part_bytes else -(-2 * n_bytes // part_bytes)

    def phrases(part: int) -> Phrases:
        own = collected(bench.where(F.pmod(F.xxhash64("item_id", "data"), F.lit(parts)) == part))
        return Phrases(list(zip(own["item_id"].to_pylist(), own["data"].to_pylist(), strict=True)), window)

    if parts == 1:
        return _with_phrases(docs, text, keep, phrases(0))
    key = F.xxhash64(keep.alias("key"), F.col(text))
    hits = []
    for part in range(parts):  # each is written, so that a task holds one part's phrases
        found = _with_phrases(docs, text, key, phrases(part)).where("size(spans) > 0").distinct()
        hits.append(materialize(found, "hits"))
    every = hits[0]
    for h in hits[1:]:
        every = every.union(h)
    whole = every.groupBy("kept").agg(union_of(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a part at most
    plain = _with_phrases(docs, text, F.struct(keep.alias("kept"), key.alias("key")), Phrases([])).select("kept.*", "n_words")
    joined = plain.join(whole.withColumnRenamed("kept", "key"), "key", "left")
    return joined.select("kept", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", "array<struct<start:bigint,end:bigint>>"), ("items", "array<string>"))])


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text's bytes without the words of ``spans`` (merged, in order) and what stands between them."""
    out, at, inside, following = [], 0, None, iter(spans)
    span = next(following, None)
    for n, m in enumerate(_WORD.finditer(data)):
        if span is None:
            break
        if n == span[0]:
            inside = m.start()
        if n == span[1] - 1:
            out.append(data[at:inside])
            at, span = m.end(), next(following, None)
    return b"".join([*out, data[at:]])


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their own columns, their texts without the words of benchmark passages."""
    found = located(docs, benchmark, window, keep=F.struct("*")).select("kept", "spans", utf8("kept.text").alias("data"))

    def run(batches):
        for b in batches:
            texts = [cut(d, [(s["start"], s["end"]) for s in spans]).decode() if spans else None for d, spans in zip(b.column("data").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(texts, pa.string())], names=["kept", "clean"])

    cleaned = found.mapInArrow(run, f"kept {found.schema['kept'].dataType.simpleString()}, clean string")
    return cleaned.select(*[F.coalesce("clean", "kept.text").alias(c) if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract of what :func:`located` finds."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("kept").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(located(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op12_decontaminate": f"""
WITH items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW})::BIGINT AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS phrase FROM items, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM docs, (SELECT DISTINCT n FROM windows) l, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT r, i, p.n, item_id FROM places p JOIN windows v ON p.phrase = v.phrase AND p.n = v.n),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(n)) t(k) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN listed USING (r)""",
}
