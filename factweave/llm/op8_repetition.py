"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes over a text's word hashes find the n-grams that occur twice or more; the
characters inside their later occurrences are counted once each, however many windows cover them, and set against the
characters of all words. Duplicated lines are measured in the same way. The limits have the form of
the published repetition rules for web text but are wider (see LIMITS), and apply from ``MIN_WORDS`` words on; shorter texts fail the base rule anyway.

Defined results: null, empty and blank texts have no words, fail the base rule and are not kept; a text's own repeats
count, repeats across rows do not; very long texts are hashed whole; an empty table gives an empty result; further
columns are ignored by the query and kept by :func:`with_repetition`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, utf8

#: n-gram length -> largest share of word characters inside later occurrences of n-grams of that length. Wider than the
#: published limits, which reject short clean texts whose first line comes back once.
LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_LIMIT, LEAST_LINES = 0.30, 3
LINE_CHAR_LIMIT = 0.20
MIN_WORDS = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = b"#*$%&|<>"
_LONGEST = max(LIMITS)


def _windows(key: np.ndarray) -> np.ndarray:
    """Whether each window's key occurs twice or more."""
    ordered = np.sort(key)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(repeated):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
    return repeated[at] == key


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Whether each word lies in one of the windows of n words that begin at ``starts``."""
    edge = np.zeros(words + 1, np.int64)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _later(key: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Starts of the repeated windows without the first of each."""
    starts = np.flatnonzero(twice)
    _, first = np.unique(key[starts], return_index=True)
    later = np.ones(len(starts), bool)
    later[first] = False
    return starts[later]


def _lengths(words: list[bytes], text: bytes) -> np.ndarray:
    """Code points of each word."""
    if not text.isascii():
        words = b" ".join(words).decode("utf-8", "replace").split(" ")
    return np.fromiter(map(len, words), np.int64, len(words))


def measure(text: bytes) -> dict:
    """All counts and shares of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    chars = _lengths(words, text) if n else np.zeros(0, np.int64)
    total = int(chars.sum())
    out = {"n_words": n, "word_chars": total, "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0}
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_chars = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                out["n_dup_lines"] += 1
                dup_chars += int(_lengths(x.split(), x).sum())
            seen.add(x)
    shares = dict.fromkeys(LIMITS, 0.0)
    if n > 3:
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        own = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        kinds = len(ids)
        pair = own[:-1] * kinds + own[1:]
        if kinds > 2_000_000:  # keeps the triples' keys exact within 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        twice = _windows(pair[:-1] * kinds + own[2:])
        if twice.any():
            out["n_repeat_words"] = int(_covered(np.flatnonzero(twice), 3, n).sum())
            h = word = _mixed(own)
            for k in range(2, min(_LONGEST, n) + 1):
                h = h[:-1] * _BASE + word[k - 1 :]
                if k in shares:
                    twice = _windows(h)
                    if not twice.any():  # no longer n-gram repeats either
                        break
                    shares[k] = float(chars[_covered(_later(h, twice), k, n)].sum() / total)
    out["dup_line_share"] = out["n_dup_lines"] / max(len(lines), 1)
    out["dup_line_chars"] = dup_chars / max(total, 1)
    out["shares"] = shares
    out["base_failed"] = n < MIN_WORDS or 100 * out["n_repeat_words"] > 50 * n
    failed = [f"dup_{k}gram" for k, most in LIMITS.items() if shares[k] > most]
    failed += ["dup_lines"] * (out["n_dup_lines"] >= LEAST_LINES and out["dup_line_share"] > LINE_LIMIT) + ["dup_line_chars"] * (out["dup_line_chars"] > LINE_CHAR_LIMIT)
    out["failed"] = failed
    out["kept"] = not out["base_failed"] and not failed
    return out


def _mixed(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's word numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xBF58476D1CE4E5B9)


_FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "failed": pa.list_(pa.string()), "dup_line_share": pa.float64(), "dup_line_chars": pa.float64(),
    **{f"dup_{k}gram": pa.float64() for k in LIMITS},
}
_DDL = ", ".join(f"{k} {({'int64': 'long', 'bool': 'boolean', 'double': 'double'}).get(str(v), 'array<string>')}" for k, v in _FIELDS.items())


def with_repetition(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of :func:`measure`; columns of these names are replaced."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            rows = [measure(x) for x in b.column("_fw_data").to_pylist()]
            rows = [r | {f"dup_{k}gram": v for k, v in r["shares"].items()} for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("_fw_row"), *(pa.array([r[k] for r in rows], t) for k, t in _FIELDS.items())], names=["_fw_row", *_FIELDS])

    packed = df.select(F.struct(*[c for c in df.columns if c != text] or [F.lit(0).alias("_fw_none")]).alias("_fw_row"), utf8(text).alias("_fw_data"))
    kind = packed.schema["_fw_row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"_fw_row {kind}, {_DDL}")
    return out.select(*[f"_fw_row.{c}" for c in df.columns if c not in _FIELDS and c != text], *_FIELDS)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_repetition(documents(spark, sf_dir).select("doc_id", "text"))
