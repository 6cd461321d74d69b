"""Removal of repeated passages by content-defined chunks of lines.

A text is cut into lines, and lines into sentences, so that a passage set in one line has several units too. A rolling
hash over the hashes of the last ``WINDOW`` units decides by one bit whether a chunk ends after a unit. Both outcomes of the
bit are used, as two complementary chunkings: whatever stands before or after a passage, its boundaries inside stay, and
what one chunking cuts into single units the other holds together. The boundary chunks of a passage still depend on its
neighbours, so the shortest run of two and more units from each unit on, the shortest up to each unit, and each unit of at
least ``least_alone`` words are chunks too: those within a passage cover it, so every repeated run is found whole. A chunk
has at least ``least_words`` words or runs over a line break; chunks of several lines may be as short as they like.

Chunks are counted over the whole corpus by 64-bit hash. Of those that occur again, each document takes as few as cover its
repeated units, long chunks before short ones; their bytes are fetched and compared with the first occurrence (by id,
then text, then position), and all but the first are cut out. A removed unit has an equal one earlier in the order, so by
induction the first occurrence of every passage stays. A hash shared by different chunks can only leave text in.

Scale: hashes, not texts, are aggregated; hot hashes meet in partial aggregates and in joins that Spark can split. Each text
is shuffled twice, to fetch bytes and to be cut, at every size; nothing is gathered on the driver. Rows are told apart by id
and a hash of id and text together.

Defined results: null texts stay null; a text that is removed whole stays as an empty text; repeated rows (same id and
text) are one document and keep or lose the same units; rows without an id come first in the order; empty tables give
empty results; the document's own columns are kept, ``n_chars``, if there is one, is brought up to date.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, hash_joins, materialize, release, row_key

WINDOW = 2
LEAST_WORDS, LEAST_ALONE = 10, 25
_END = re.compile(r"(?<=[.!?]) |\n")
_AFTER = re.compile(r"(?<=[.!?\n]) ")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WIDE = 1 << 31


def _split(text: str, pattern: re.Pattern, ends: tuple[str, ...]) -> list[str]:
    """``pattern.split(text)``, where the pattern's one-character matches are the last characters of ``ends``."""
    if "\0" in text:
        return pattern.split(text)
    for end in ends:
        text = text.replace(end, end[:-1] + "\0")
    return text.split("\0")


def units(text: str) -> list[tuple[int, int, int]]:
    """(first, past the last, past the white space after it) character of each line or sentence; blank ones join the one before."""
    out: list[tuple[int, int, int]] = []
    at = stop = 0
    for part in _split(text, _END, (". ", "! ", "? ", "\n")):
        stop += len(part)
        after = min(stop + 1, len(text))
        if part.strip():
            out.append((at, stop, after))
            at = after
        elif out:
            out[-1] = (*out[-1][:2], after)
            at = after
        # leading blanks stay with the first unit
        stop = after
    return out


def pieces(text: str) -> tuple[list[str], list[bool]]:
    """The units' texts, as :func:`units` cuts them, and whether each begins a line."""
    out: list[str] = []
    opens: list[bool] = []
    new = True
    for x in _split(text.replace("\n", "\n "), _AFTER, (". ", "! ", "? ", "\n ")):
        unit = x.strip()
        if unit:
            out.append(unit)
            opens.append(new)
            new = False
        if x[-1:] == "\n":
            new = True
    return out, opens


def chunks(texts: list[tuple[list[str], list[bool]]], least_words: int = LEAST_WORDS, least_alone: int = LEAST_ALONE) -> tuple[np.ndarray, ...]:
    """Hash, text, first unit and past the last unit of every chunk of the texts (:func:`pieces` of each), computed for all at once."""
    size = np.fromiter((len(p) for p, _ in texts), np.int64, len(texts))
    n = int(size.sum())
    if not n:
        return (np.zeros(0, np.int64),) * 4
    every = list(chain.from_iterable(p for p, _ in texts))
    h = np.fromiter(map(xxhash.xxh64_intdigest, every), np.uint64, n)
    words = np.concatenate([[0], np.cumsum(np.fromiter(map(str.count, every, repeat(" ")), np.int64, n) + 1)])
    opens = np.fromiter(chain.from_iterable(o for _, o in texts), bool, n)
    of = np.repeat(np.arange(len(texts)), size)
    at, begin, end = np.arange(n), np.repeat(np.cumsum(size) - size, size), np.repeat(np.cumsum(size), size)

    # The next unit after each, and the last up to each, that begins a line.
    following = np.concatenate([np.minimum.accumulate(np.where(opens, at, n)[::-1])[::-1][1:], [n]])
    latest = np.maximum.accumulate(np.where(opens, at, 0))
    spans = [(at * _WIDE + at + 1)[np.diff(words) >= least_alone]]
    stop, start = np.maximum(np.searchsorted(words, words[:-1] + least_words), at + 2), np.minimum(np.searchsorted(words, words[1:] - least_words, side="right") - 1, at - 1)
    spans += [(at * _WIDE + stop)[stop <= end], (start * _WIDE + at + 1)[start >= begin]]
    by_line, from_line = following + 1, latest - 1  # over a line break, where that is shorter
    spans += [(at * _WIDE + by_line)[(by_line < stop) & (by_line <= end)], (from_line * _WIDE + at + 1)[(from_line > start) & (from_line >= begin)]]

    roll = h.copy()
    for k in range(1, WINDOW):
        roll[k:] = np.where(at[k:] - begin[k:] >= k, roll[k:] * np.uint64(31) + h[:-k], roll[k:])
    bit = (roll ^ (roll >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1
    lines = np.concatenate([[0], np.cumsum(opens)])
    for side in (bit, ~bit):
        ends = np.flatnonzero(side | (at + 1 == end)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        several = (ends - starts >= 2) & ((words[ends] - words[starts] >= least_words) | (lines[ends] - lines[starts + 1] > 0))
        spans.append(starts[several] * _WIDE + ends[several])
    span = np.sort(np.concatenate(spans))
    span = span[np.concatenate([[True], span[1:] != span[:-1]])] if len(span) else span
    a, b = span // _WIDE, span % _WIDE

    power = np.cumprod(np.full(n, _BASE, np.uint64))
    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE, np.uint64))])
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * power)])
    value = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)
    return (value ^ (value >> np.uint64(32))).view(np.int64), of[a], a - begin[a], b - begin[a]


def cover(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """As few of the spans (first, past the last, hash) as cover all their units."""
    out: list[tuple[int, int, int]] = []
    best, reached = None, -1
    for span in sorted(spans):
        if best is not None and span[0] > reached:  # nothing that touches what is covered goes further than the best
            out.append(best)
            reached, best = best[1], None
        if span[1] > (reached if best is None else best[1]):
            best = span
            if span[0] > reached:
                reached = span[0]
    if best is not None:
        out.append(best)
    return out


def without(text: str, spans: list[int]) -> tuple[str, int]:
    """The text without the units of the chunks at ``spans`` (first * 2 ** 31 + past the last), and the number of units removed."""
    at = units(text)
    gone = np.zeros(len(at) + 1, bool)
    for s in spans:
        gone[s // _WIDE : s % _WIDE] = True
    kept = [i for i in range(len(at)) if not gone[i]]
    if len(kept) == len(at):
        return text, 0
    lead = text[: at[0][0]] if kept and kept[0] == 0 else ""
    out = lead + "".join(text[at[i][0] : at[i][2]] for i in kept)
    return (out.rstrip("\n ") if gone[len(at) - 1] else out), len(at) - len(kept)


def repeated(docs: DataFrame, least_words: int = LEAST_WORDS, least_alone: int = LEAST_ALONE) -> DataFrame:
    """h, doc_id, k, span, near: every occurrence of a chunk whose hash occurs again, and whether the first is in a row of this id."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            h, of, first, last = chunks([pieces(x) for x in b.column(2).to_pylist()], least_words, least_alone)
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(row), b.column(1).take(row), pa.array(first * _WIDE + last)], names=["h", "k", "doc_id", "span"])

    picked = docs.where("text is not null").select(row_key().alias("k"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every = materialize(picked.mapInArrow(run, "h long, k long, doc_id long, span long"), "chunks")
    ident = F.coalesce("doc_id", F.lit(-(1 << 63)))
    # Of all chunks, numbers alone are aggregated; places are compared only where the first document is known.
    again = materialize(every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("least")).where("n > 1").select("h", "least"), "again")
    with hash_joins(docs.sparkSession):
        out = materialize(every.join(again, "h").select("h", "doc_id", "k", "span", (ident == F.col("least")).alias("near")), "repeated")
    release(every, again)
    return out


def firsts(found: DataFrame) -> DataFrame:
    """h, doc_id, k, span: of the rows of :func:`repeated`, the first of each hash by id, then key, then position."""
    return found.where("near").groupBy("h").agg(F.min(F.struct("doc_id", "k", "span")).alias("least")).select("h", "least.*")


def covering(docs: pa.Array, spans: pa.Array, first: pa.Array, h: pa.Array) -> tuple[list[int], list[int], list[int]]:
    """Document number, hash and span of the chunks that :func:`cover` picks in each document among its spans that are not ``first``.

    A first occurrence stands among the spans twice, with and without the mark. Spans inside others are left out beforehand.
    """
    doc, span, own, value = (x.to_numpy(zero_copy_only=False) for x in (docs, spans, first, h))
    of, at, chunk = [], [], []
    order = np.lexsort((~own, span, doc))
    doc, span, own, value = doc[order], span[order], own[order], value[order]
    twin = np.concatenate([[False], (doc[1:] == doc[:-1]) & (span[1:] == span[:-1]) & own[:-1]]) if len(doc) else own
    left = ~own & ~twin
    doc, span, value = doc[left], span[left], value[left]
    a, b = span // _WIDE, span % _WIDE
    order = np.lexsort((-b, a, doc))
    reach = doc[order] * _WIDE + b[order]
    furthest = np.maximum.accumulate(reach)
    order = order[np.concatenate([[True], reach[1:] > furthest[:-1]])] if len(reach) else order
    doc, a, b, value = doc[order], a[order].tolist(), b[order].tolist(), value[order].tolist()
    ends = np.flatnonzero(np.concatenate([doc[1:] != doc[:-1], [True]])) + 1 if len(doc) else doc
    start = 0
    for end in ends.tolist():
        picked = cover(list(zip(a[start:end], b[start:end], value[start:end], strict=True)))
        of += [int(doc[start])] * len(picked)
        at += [x * _WIDE + y for x, y, _ in picked]
        chunk += [v for _, _, v in picked]
        start = end
    return of, chunk, at


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, least_alone: int = LEAST_ALONE) -> DataFrame:
    """``docs`` with its columns, the repeated passages cut out of ``text``, and removed_units, removed_chars."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = repeated(docs, least_words, least_alone)
    first = materialize(firsts(found), "firsts")
    by_row = (F.col("doc_id").alias("id"), F.col("k").alias("of"))
    marks = F.collect_set(F.struct("h", "span", "first")).alias("spans")
    places = found.select("h", "doc_id", "k", "span", F.lit(False).alias("first")).union(first.select("*", F.lit(True)))

    def pick(batches):
        for b in batches:
            each = b.column(2).flatten()
            n = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            of, h, span = covering(pa.array(np.repeat(np.arange(len(n)), n)), each.field("span"), each.field("first"), each.field("h"))
            row = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(0).take(row), b.column(1).take(row), pa.array(span, pa.int64())], names=["h", "doc_id", "k", "span"])

    chosen = materialize(places.groupBy(*by_row).agg(marks).mapInArrow(pick, "h long, doc_id long, k long, span long"), "chosen")
    release(found)
    # Of the first occurrences, those count that a chosen chunk may equal.
    met = first.join(chosen.select("h").distinct(), "h", "left_semi")
    per_doc = chosen.select("*", F.lit(False).alias("first")).union(met.select("*", F.lit(True))).groupBy(*by_row).agg(marks)

    same_row = (F.col("k") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    packed = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("_fw_row"))

    def fetch(batches):
        """The bytes of the marked chunks."""
        for b in batches:
            out: list[tuple] = []
            marks = b.column(3)
            flat = marks.flatten()
            h, span, first = (flat.field(i).to_pylist() for i in range(3))
            ends = marks.offsets.to_numpy() - marks.offsets[0].as_py()
            for i, text in enumerate(b.column(2).to_pylist()):
                own, _ = pieces(text)
                out += [(i, h[j], span[j], first[j], "\n".join(own[span[j] // _WIDE : span[j] % _WIDE]).encode()) for j in range(ends[i], ends[i + 1])]
            row, *cols = list(zip(*out, strict=True)) or [()] * 5
            row = pa.array(row, pa.int64())
            kinds = zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *(pa.array(c, t) for c, t in kinds)], names=["doc_id", "k", "h", "span", "first", "bytes"])

    # A few numbers a text are hashed beside the texts, which then need no sort.
    whole = packed.where("text is not null").join(per_doc.hint("shuffle_hash"), same_row).select("doc_id", "k", "text", "spans")
    with hash_joins(spark):
        fetched = materialize(whole.mapInArrow(fetch, "doc_id long, k long, h long, span long, first boolean, bytes binary"), "bytes")
    release(chosen, first)
    original = fetched.where("first").select("h", "bytes")
    same = fetched.where("not first").join(original, ["h", "bytes"], "left_semi")
    with hash_joins(spark):
        spans = materialize(same.groupBy(*by_row).agg(F.collect_set("span").alias("spans")), "same")
    release(fetched)

    def cut(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [(x, 0) if x is None or not spans else without(x, spans) for x, spans in zip(texts, b.column(2).to_pylist(), strict=True)]
            gone = [len(x or "") - len(r[0] or "") for x, r in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array(gone, pa.int64())], names=["_fw_row", "text", "removed_units", "removed_chars"])

    row = packed.schema["_fw_row"].dataType.simpleString()
    joined = packed.join(spans.hint("shuffle_hash"), same_row, "left").select("_fw_row", "text", "spans")
    out = joined.mapInArrow(cut, f"_fw_row {row}, text string, removed_units long, removed_chars long")
    n_chars = F.when(F.col("removed_units") > 0, F.length("text").cast("long")).otherwise(F.col("_fw_row.n_chars")) if "n_chars" in docs.columns else None
    new = ("removed_units", "removed_chars")
    columns = [F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col("_fw_row").getField(c).alias(c) for c in docs.columns if c not in new]
    return out.select(*columns, *new)


def op3_linechunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
