"""Language identification of mixed-language text by spans.

A word's script (Unicode ranges) narrows the languages to those that learned that script. The candidates are scored by
character n-grams of the word (one to three, word edges included, add-one smoothed log-probabilities), and a Viterbi
pass over the words, with a penalty for each switch of language, labels spans. The document's language is the one whose
spans hold most letters; the score is its share of all letters.

Learning: :func:`learn` counts hashed n-grams per language over a bounded sample of labelled documents
(``per_language`` documents, chosen by a hash of the id so that no language crowds out another), as a DataFrame
aggregation. Every language is learned. The model is a table of buckets by languages: 2 ** BUCKET_BITS buckets, fewer where
that many languages would take more than MOST_CELLS cells, so what is broadcast is at most 64 MB up to 16,000 languages.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and when nothing could be learned; words
without letters take no part; ties go to the language that sorts first; further columns are ignored; an empty table
gives an empty result. Rows without an id belong to the fold of crc32('').
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, documents, remainder

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE = 3000
BUCKET_BITS, LEAST_BITS = 16, 10
SWITCH = 12.0
NGRAMS = (1, 2, 3)
MOST_CELLS = 1 << 24
MOST_CACHED = 200_000
UNKNOWN = "und"

# First and last code point of the scripts, from the Unicode block charts.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x137F), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
]
_STARTS = np.array([a for _, a, _ in sorted(SCRIPTS, key=lambda x: x[1])])
_SORTED = sorted(SCRIPTS, key=lambda x: x[1])
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def bucket_bits(languages: int) -> int:
    """Bits of a bucket's number, so that buckets by languages are at most MOST_CELLS, or 2 ** LEAST_BITS buckets."""
    return max(min(BUCKET_BITS, (MOST_CELLS // max(languages, 1)).bit_length() - 1), LEAST_BITS)


def script(word: str) -> str:
    """Script of the first letter; ``Other`` outside the ranges."""
    c = ord(word[0])
    if c <= 0x024F:
        return "Latin"
    i = int(np.searchsorted(_STARTS, c, "right")) - 1
    return _SORTED[i][0] if i >= 0 and c <= _SORTED[i][2] else "Other"


def letters(token: str) -> str:
    """The letters of a token (Unicode category L), lower-cased."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def grams(words: list[str], bits: int = BUCKET_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: buckets of the words' character n-grams by rolling hash, and the word of each, in order.

    Words are letters only, so the edge marks, which count as characters, can't be mistaken; every word has an n-gram of
    each length up to three.
    """
    code = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == ord("<")) - 1
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(code) - n + 1] * _PRIME + code[n - 1 :]
        if n in NGRAMS:
            own = word[: len(h)] == word[n - 1 :]
            out.append((((h[own] + np.uint64(n)) * _MIX >> np.uint64(64 - bits)).astype(np.int64), word[: len(h)][own]))
    return out


class Model:
    """Log-probabilities by bucket and language, and the scripts each language learned."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray], switch: float = SWITCH):
        self.langs, self.scripts, self.switch = langs, scripts, switch
        self.bits = len(counts).bit_length() - 1
        self.table = (np.log(counts + 0.5) - np.log(counts.sum(0, keepdims=True) + 0.5 * len(counts))).astype(np.float32)
        self.cache: dict[str, int] | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """Per word and language, the mean log-probability of the n-grams by the number of letters; far lower outside its script."""
        total, number = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        for bucket, word in grams(words, self.bits):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            total += np.add.reduceat(self.table[bucket], starts, axis=0, dtype=np.float64)
            number += np.diff(starts, append=len(word))
        out = total / number[:, None] * np.minimum(np.fromiter(map(len, words), np.int64, len(words)) + 1, 12)[:, None]
        for i, kind in enumerate(map(script, words)):
            allowed = self.scripts.get(kind)
            if allowed is not None and not allowed.all():
                out[i] = np.where(allowed, out[i], out[i].min() - 40.0)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first token, past the last token, language) for the spans of a text, tokens being split at white space."""
        at, path, _ = self._path(text.split())
        out: list[list] = []
        for i, l in zip(at, path, strict=True):
            if out and out[-1][2] == self.langs[l]:
                out[-1][1] = int(i) + 1
            else:
                out.append([int(i), int(i) + 1, self.langs[l]])
        return [tuple(x) for x in out]

    def _path(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the tokens with letters, their languages, their numbers of letters."""
        rows = self._rows(tokens)
        at = np.flatnonzero(rows >= 0)
        rows = rows[at]
        return at, viterbi(self.scores[rows], self.switch) if len(rows) else rows, self.sizes[rows] if len(rows) else rows

    def prepare(self, tokens: set[str]) -> None:
        """Score the tokens that the cache lacks, all at once. The cache is emptied when it grows beyond its bound."""
        if self.cache is None or len(self.cache) > MOST_CACHED:
            self.cache, self.scores, self.sizes = {}, np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        new = [t for t in tokens if t not in self.cache]
        words = [letters(t) for t in new]
        with_letters = [i for i, w in enumerate(words) if w]
        self.cache.update(dict.fromkeys(new, -1))
        if with_letters:
            self.cache.update(zip((new[i] for i in with_letters), range(len(self.sizes), len(self.sizes) + len(with_letters)), strict=True))
            own = [words[i] for i in with_letters]
            self.scores = np.concatenate([self.scores, self.score(own)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, own), np.int64, len(own))])

    def _rows(self, tokens: list[str]) -> np.ndarray:
        if self.cache is None or not self.cache.keys() >= set(tokens):
            self.prepare(set(tokens))
        return np.fromiter(map(self.cache.__getitem__, tokens), np.int64, len(tokens))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text of a batch."""
        tokens = [(t or "").split() if self.langs else [] for t in texts]
        self.prepare(set().union(*tokens))
        return [self._predict(x) for x in tokens]

    def _predict(self, tokens: list[str]) -> tuple[str, float]:
        at, path, sizes = self._path(tokens)
        if not len(at):
            return UNKNOWN, 0.0
        held = np.bincount(path, weights=sizes, minlength=len(self.langs))
        best = int(held.argmax())
        return self.langs[best], float(held[best] / held.sum())


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word under a penalty for each switch.

    The language of the best total is the path if no stretch gains more than the penalty in another one, since a path that
    uses it pays a switch for each such stretch, and if the best other language of each word, taken together, gains no more
    either, since a path that never uses it pays one switch at least. That is one pass of running sums, and covers almost
    every text; the others take the full pass.
    """
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.zeros((n + 1, k))
    over = scores - scores[:, [best]]
    np.cumsum(over, axis=0, out=gain[1:])
    over[:, best] = -np.inf
    if (gain - np.minimum.accumulate(gain, 0)).max() <= switch and (k == 1 or over.max(1).sum() <= switch):
        return np.full(n, best)
    back, own = [], range(k)
    v = [0.0] * k
    for row in scores.tolist():
        top = max(v)
        low, first = top - switch, v.index(top)
        back.append([j if v[j] >= low else first for j in own])
        v = [(v[j] if v[j] >= low else low) + row[j] for j in own]
    path = np.empty(n, np.int64)
    at = v.index(max(v))
    for i in range(n - 1, -1, -1):
        path[i] = at
        at = back[i][at]
    return path


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, switch: float = SWITCH) -> Model:
    """Fit on about ``per_language`` documents of each language of ``labelled`` (doc_id, text, lang)."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    known = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), {}, switch)
    share = spark.createDataFrame([(l, min(1.0, per_language / sizes[l])) for l in langs], "lang string, share double")
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "lang"), 11) / float(1 << 53)
    sample = known.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("lang", "text")
    number = {l: i for i, l in enumerate(langs)}
    bits = bucket_bits(len(langs))

    def count(batches):
        counts: dict[int, np.ndarray] = {}
        seen: dict[tuple[int, str], int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = number[lang]
                words = [w for w in map(letters, text.split()) if w]
                if words:
                    own = counts.setdefault(at, np.zeros(1 << bits, np.int64))
                    for bucket, _ in grams(words, bits):
                        own += np.bincount(bucket, minlength=1 << bits)
                for w in words:
                    kind = script(w)
                    seen[at, kind] = seen.get((at, kind), 0) + len(w)
        for at, own in counts.items():
            bucket = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), at)), pa.array(bucket), pa.nulls(len(bucket), pa.string()), pa.array(own[bucket])], names=["lang", "bucket", "script", "n"])
        yield arrow_rows({"lang": pa.int64(), "bucket": pa.int64(), "script": pa.string(), "n": pa.int64()}, {"lang": [k[0] for k in seen], "bucket": [0] * len(seen), "script": [k[1] for k in seen], "n": list(seen.values())})

    # At most languages x (buckets + scripts) rows.
    table = sample.mapInArrow(count, "lang long, bucket long, script string, n long").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << bits, len(langs)))
    own = table[table.script.isna()]
    counts[own.bucket.to_numpy(), own.lang.to_numpy()] = own.n
    kinds = table[table.script.notna()]
    total = kinds.groupby("lang").n.sum()
    scripts: dict[str, np.ndarray] = {}
    for r in kinds.itertuples():
        if r.n >= 0.01 * total[r.lang]:  # a stray foreign word doesn't make a script the language's own
            scripts.setdefault(r.script, np.zeros(len(langs), bool))[r.lang] = True
    return Model(langs, counts, scripts, switch)


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}

    def run(batches):
        m = shared.value
        for b in batches:
            found = m.predict(b.column(2).to_pylist())
            yield arrow_rows(kinds, {"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = remainder("doc_id", FOLDS) == HELD_OUT
    return identify(docs, learn(docs.where(~held)), held)
