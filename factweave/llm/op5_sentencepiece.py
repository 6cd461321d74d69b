"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The model file is read directly (protobuf wire format). A unigram model's scores are log-probabilities and are used as
they are; the pieces of a BPE model carry merge ranks instead, which are turned into log scores by Zipf's law,
log(1 / (rank + 2)) - log(H), whitespace runs (rank -1e9) by their length among the best. The trie over UTF-8 bytes is built
once per worker as a double array (base, check). White space markers join each word to the space before it; as no piece
continues past a marker, the best path of a text is the best paths of its words one after another. These are kept in a
bounded cache; the words of a batch that it lacks go through the trie and the Viterbi pass together, as numpy arrays. Characters that no piece covers become byte pieces.

Defined results: a null or empty text has no tokens; text is not normalised beyond the model's own rules (identity, a
dummy prefix, spaces as markers) and a marker character in the text itself goes to byte pieces, so decoding gives the
text back exactly with models that have byte pieces and keep spaces; ties go to the longer last piece;
runs without white space of any length are encoded whole; further columns are ignored by the query and kept by
:func:`with_tokens`.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MOST_CACHED = 400_000
LONGEST_TOGETHER = 48  # bytes; longer stretches are encoded one by one
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            c = data[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces (text, score, kind) and the settings that matter of a serialised SentencePiece model."""
    pieces, settings = [], {"type": 1, "dummy_prefix": True, "squeeze": True}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
        elif number == 2:
            settings["type"] = dict(_fields(value)).get(3, 1)
        elif number == 3:
            f = dict(_fields(value))
            settings |= {"dummy_prefix": bool(f.get(3, 1)), "squeeze": bool(f.get(4, 1))}
            if f.get(2):
                raise ValueError("models with a character map aren't supported")
    return pieces, settings


def log_scores(pieces: list[tuple[str, float, int]], model_type: int) -> list[float]:
    """Log-probabilities of the pieces; from ranks by Zipf's law for BPE."""
    if model_type == 1:
        return [s for _, s, _ in pieces]
    ranked = [-s for _, s, k in pieces if k == NORMAL and s > -1e8]
    h = math.log(sum(1 / (r + 2) for r in ranked) or 1.0)
    return [(-h if s <= -1e8 else -math.log(-s + 2) - h) if k == NORMAL else 0.0 for _, s, k in pieces]


class DoubleArray:
    """Trie over byte strings: child of state s by byte b is base[s] + b + 1 if check[...] == s; the value sits at base[s]."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        n = 1 << 16
        self.base, self.check = [0] * n, [-1] * n
        self.check[0] = -2
        free = 1
        todo = [(0, 0, len(keys), 0)]  # state, first and past the last key, depth
        while todo:
            state, lo, hi, depth = todo.pop()
            children = []  # label, first, past the last; label 0 is the end of a key
            i = lo
            while i < hi:
                label = keys[i][0][depth] + 1 if depth < len(keys[i][0]) else 0
                j = i
                while j < hi and (keys[j][0][depth] + 1 if depth < len(keys[j][0]) else 0) == label:
                    j += 1
                children.append((label, i, j))
                i = j
            while free < len(self.check) and self.check[free] != -1:
                free += 1
            at = max(free - children[0][0], 1)
            while True:
                if at + 257 >= len(self.check):
                    self.base += [0] * len(self.base)
                    self.check += [-1] * len(self.check)
                if all(self.check[at + label] == -1 for label, _, _ in children):
                    break
                at += 1
            self.base[state] = at
            for label, i, j in children:
                self.check[at + label] = state
                if label:
                    todo.append((at + label, i, j, depth + 1))
                else:
                    self.base[at] = -1 - keys[i][1]

    def matches(self, data: bytes, at: int):
        """(end, value) of every key that starts at ``at``."""
        base, check, state = self.base, self.check, 0
        for i in range(at, len(data)):
            state, was = base[state] + data[i] + 1, state
            if check[state] != was:
                return
            leaf = base[state]
            if check[leaf] == state:
                yield i + 1, -1 - base[leaf]


#: Stands for a marker character of the text's own, in the list of stretches.
LITERAL = "\0" + MARK


class Encoder:
    def __init__(self, data: bytes):
        self.pieces, self.settings = read_model(data)
        scores = log_scores(self.pieces, self.settings["type"])
        usable = [(p.encode(), i) for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER) and p]
        self.scores = scores
        self.trie = DoubleArray(usable)
        self.unknown_score = min((scores[i] for _, i in usable), default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.words_apart = not any(k in (NORMAL, USER) and MARK in p.lstrip(MARK) for p, _, k in self.pieces)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        self.cache: dict[str, list[int]] = {}
        self.fixed = {LITERAL: [self.bytes[c] for c in MARK.encode()]} if self.bytes else {}
        self.base, self.check = np.array(self.trie.base, np.int32), np.array(self.trie.check, np.int32)
        self.score_of = np.array(scores)

    def best_many(self, texts: list[str]) -> list[list[int]]:
        """``best`` of each text, all at once for those that are short."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[list[int] | None] = [None if len(b) <= LONGEST_TOGETHER else self.best(t) for b, t in zip(raw, texts, strict=True)]
        todo = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(raw[i]))
        for at in range(0, len(todo), 20_000):  # alike lengths together
            part = todo[at : at + 20_000]
            for i, ids in zip(part, self._together([raw[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _together(self, raw: list[bytes]) -> list[list[int]]:
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        longest = int(n.max(initial=0))
        data = np.frombuffer(b"".join(b.ljust(longest, b"\0") for b in raw), np.uint8).reshape(len(raw), longest).astype(np.int32)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        top = np.full((len(raw), longest + 1), -np.inf)
        top[:, 0] = 0.0
        start, piece_at = np.zeros((len(raw), longest + 1), np.int32), np.full((len(raw), longest + 1), -1, np.int32)
        base, check = self.base, self.check
        for at in range(longest):
            here = np.flatnonzero((n > at) & (top[:, at] > -np.inf))
            if not len(here):
                continue
            whole = np.zeros(len(raw), bool)
            rows, state = here, np.zeros(len(here), np.int32)
            for k in range(at, longest):
                inside = n[rows] > k
                rows, state = rows[inside], state[inside]
                after = base[state] + data[rows, k] + 1
                ok = check[after] == state
                rows, state = rows[ok], after[ok]
                if not len(rows):
                    break
                leaf = base[state]
                ends = check[leaf] == state
                r = rows[ends]
                if len(r):
                    piece = -1 - base[leaf[ends]]
                    whole[r[width[r, at] == k + 1 - at]] = True
                    s = top[r, at] + self.score_of[piece]
                    better = s > top[r, k + 1]
                    r = r[better]
                    top[r, k + 1], start[r, k + 1], piece_at[r, k + 1] = s[better], at, piece[better]
            r = here[~whole[here]]
            end = at + width[r, at]
            s = top[r, at] + self.unknown_score
            better = s > top[r, end]
            r, end = r[better], end[better]
            top[r, end], start[r, end], piece_at[r, end] = s[better], at, -1
        out = []
        for b, starts, pieces in zip(raw, start.tolist(), piece_at.tolist(), strict=True):
            at, ids = len(b), []
            while at:
                piece = pieces[at]
                if piece >= 0:
                    ids.append(piece)
                elif self.bytes:
                    ids += [self.bytes[c] for c in reversed(b[starts[at] : at])]
                else:
                    ids.append(self.unknown)
                at = starts[at]
            ids.reverse()
            out.append(ids)
        return out

    def best(self, text: str) -> list[int]:
        """Ids on the path of the highest total score, by one pass over the bytes."""
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        top: list[float] = [-math.inf] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        top[0] = 0.0
        scores, base, check, lowest = self.scores, self.trie.base, self.trie.check, self.unknown_score
        at = 0
        while at < n:
            first, here = data[at], top[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            state, whole = 0, False
            for i in range(at, n):
                was = state
                state = base[state] + data[i] + 1
                if check[state] != was:
                    break
                leaf = base[state]
                if check[leaf] == state:
                    piece = -1 - base[leaf]
                    end = i + 1
                    whole = whole or end == at + width
                    s = here + scores[piece]
                    if s > top[end]:
                        top[end], back[end] = s, (at, piece)
            if not whole and here + lowest > top[at + width]:
                top[at + width], back[at + width] = here + lowest, (at, -1)
            at += width
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[c] for c in reversed(data[start:at])]
            else:
                out.append(self.unknown)
            at = start
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; what the cache lacks is encoded together."""
        cut = [self._stretches(t) for t in texts]
        cache = self.cache
        if len(cache) > MOST_CACHED:
            cache.clear()
        cache.update(self.fixed)
        new = [x for x in set(chain.from_iterable(cut)) if x not in cache]
        cache.update(zip(new, self.best_many(new), strict=True))
        out = [list(chain.from_iterable(map(cache.__getitem__, x))) for x in cut]
        for x in new:
            if len(x) > 64:
                del cache[x]
        return out

    def _stretches(self, text: str) -> list[str]:
        """The text with markers, cut where no piece crosses. A marker of the text's own is a stretch that begins with NUL."""
        if not text:
            return []
        if self.settings["squeeze"]:
            text = " ".join(x for x in text.split(" ") if x)
        if MARK in text and self.bytes:
            first, *rest = text.split(MARK)
            out = self._cut(first, self.settings["dummy_prefix"]) if first else []
            for part in rest:
                out.append(LITERAL)
                out += self._cut(part, False)
            return out
        return self._cut(text, self.settings["dummy_prefix"])

    def _cut(self, text: str, prefix: bool) -> list[str]:
        if not self.words_apart:
            return [(MARK if prefix else "") + text.replace(" ", MARK)]
        parts = text.split(" ")
        if prefix and "" not in parts:
            return [MARK + x for x in parts]
        out, run = [], MARK if prefix else ""
        if not prefix and parts[0]:
            out.append(parts[0])
        elif prefix and parts[0]:
            out.append(run + parts[0])
            run = ""
        for part in parts[1:]:  # a run of spaces is one stretch with the word after it
            run += MARK
            if part:
                out.append(run + part)
                run = ""
        if run:
            out.append(run)
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.settings["dummy_prefix"] and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as f:
        return Encoder(f.read())


def load(path: str = MODEL) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def _ship(spark: SparkSession, path: str) -> str:
    """Send the model file to every executor, so that it need not lie on each machine."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def with_tokens(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with token_ids, n_tokens and round_trip (whether decoding gives the text back)."""
    spark = df.sparkSession
    bounded_batches(spark)
    name = _ship(spark, model)

    def run(batches):
        e = _encoder(name)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids = e.encode_batch(texts)
            same = [e.decode(i) == x for i, x in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())], names=["_fw_row", "token_ids", "n_tokens", "round_trip"])

    new = ("token_ids", "n_tokens", "round_trip")
    packed = df.select(F.struct("*").alias("_fw_row"), F.col(text).cast("string").alias("_fw_text"))
    made = packed.mapInArrow(run, f"_fw_row {packed.schema['_fw_row'].dataType.simpleString()}, token_ids array<int>, n_tokens long, round_trip boolean")
    return made.select(*[f"_fw_row.{c}" for c in df.columns if c not in new], *new)


def decoded(df: DataFrame, ids: str = "token_ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the text that ``ids`` decode to; null stays null."""
    spark = df.sparkSession
    bounded_batches(spark)
    name = _ship(spark, model)

    def run(batches):
        e = _encoder(name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else e.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["_fw_row", out])

    packed = df.select(F.struct("*").alias("_fw_row"), F.col(ids).alias("_fw_ids"))
    made = packed.mapInArrow(run, f"_fw_row {packed.schema['_fw_row'].dataType.simpleString()}, {out} string")
    return made.select(*[f"_fw_row.{c}" for c in df.columns if c != out], out)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
