"""The best unrelated facts of the predicates that hold most signatures, by products of matrices over blocks.

The score of two facts of unrelated subjects is that of their predicates plus the dot product of their embeddings. Targets are
dealt to parts of a bounded size, by time where only earlier facts count, and each part meets the items that can be before its
targets as a stream in the order of ties, a slab at a time. A slab is sorted by its more frequent slots and cut into tiles; the
largest and smallest value of each slot in a tile bound every dot product with it, so a target meets only tiles that can beat its
eighth best so far: wide ones first, then the small ones in them. Scores are added up as the plans do. The result is exact. Work
is at worst that of all pairs of a predicate; memory is that of a part and a slab.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import bind

#: Targets in a part and items in a slab; items in a tile and tiles in a wide one; targets and pairs that are worked on at once; targets that are worth a part;
#: wide tiles of a part's first slab that give its targets their limits.
TARGETS, SLAB, TILE, WIDE, STEP, PAIRS, FEWEST, FIRST = 1 << 17, 1 << 17, 16, 8, 1 << 13, 1 << 18, 512, 4
#: Bounds in single precision differ from exact ones by far less.
MARGIN = 1e-5


def _slots(nz: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row, slot and value of each non-zero slot."""
    lists = nz.combine_chunks() if isinstance(nz, pa.ChunkedArray) else nz
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, place, flat.field("at").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False)


def _order(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Rows by base, largest value and the signs of their slots, the most frequent slot first, so that neighbours have most in common."""
    sign = (x > 0).astype(np.uint64) * np.uint64(2) + (x < 0).astype(np.uint64)
    by_count = np.argsort(-(sign > 0).sum(axis=0), kind="stable")
    keys = []
    for start in range(0, len(by_count), 32):
        key = np.zeros(len(x), np.uint64)
        for c in by_count[start : start + 32]:
            key = (key << np.uint64(2)) | sign[:, c]
        keys.append(~key)
    return np.lexsort((*reversed(keys), x.max(axis=1), -base))


def _extremes(high: np.ndarray, low: np.ndarray, base: np.ndarray, seq: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The greatest and least of each ``size`` rows."""
    rows = lambda x: x.reshape(-1, size, *x.shape[1:])
    return rows(high).max(axis=1), rows(low).min(axis=1), rows(base).max(axis=1), rows(seq).min(axis=1)


class _Tiles:
    """Least and greatest values of the items in tiles, as their middle and half their distance, with the largest base and the smallest seq."""

    def __init__(self, high: np.ndarray, low: np.ndarray, base: np.ndarray, seq: np.ndarray):
        self.high, self.low = high, low
        self.middle, self.reach = ((high + low) / 2).astype(np.float32), ((high - low) / 2).astype(np.float32)
        self.base, self.seq = base, seq


class _Part:
    """The targets of a part with the ``k`` best items of what they have met."""

    def __init__(self, targets: pa.Table, k: int, incremental: bool):
        n = targets.num_rows
        self.k, self.incremental, self.seen, self.targets = k, incremental, 0, targets.column("id")
        row, place, at, v = _slots(targets.column("nz"))
        self.dense = np.zeros((n, V.EMBEDDING_DIM), np.float32)
        self.dense[row, at] = v
        self.at, self.v = np.zeros((n, place.max(initial=-1) + 1), np.int16), np.zeros((n, place.max(initial=-1) + 1))
        self.at[row, place], self.v[row, place] = at, v
        self.seq = pc.fill_null(targets.column("seq"), 0).to_numpy()
        self.docs = pc.unique(targets.column("doc"))
        self.doc = pc.index_in(targets.column("doc"), value_set=self.docs).to_numpy()
        self.limit = np.maximum(pc.fill_null(targets.column("score"), 0.0).to_numpy(), V.LEAST_PAIR_SCORE)
        self.best, self.age = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self.ids, self.seqs = np.full((n, k), None, object), np.full((n, k), None, object)

    def meet(self, items: pa.Table) -> None:
        """Compare with a slab, whose items come after all that were met before."""
        n = items.num_rows
        row, _, at, v = _slots(items.column("nz"))
        x, base = np.zeros((n, V.EMBEDDING_DIM)), items.column("score").to_numpy()
        x[row, at] = v
        self.order = _order(x, base)
        full = -n % (TILE * WIDE)  # the last tile is filled up with rows that are no items
        x, self.base = np.pad(x[self.order], ((0, full), (0, 0))), np.pad(base[self.order], (0, full), constant_values=-np.inf)
        self.i_seq = np.pad(pc.fill_null(items.column("seq"), 0).to_numpy()[self.order], (0, full), constant_values=np.iinfo(np.int64).max)
        self.i_doc = np.pad(pc.fill_null(pc.index_in(items.column("doc"), value_set=self.docs), -1).to_numpy()[self.order], (0, full))
        fine = _Tiles(*_extremes(x, x, self.base, self.i_seq, TILE))
        self.x = np.ascontiguousarray(x.reshape(-1, TILE, V.EMBEDDING_DIM).transpose(0, 2, 1)).reshape(-1, TILE)  # a row a tile and slot
        del x
        coarse = _Tiles(*_extremes(fine.high, fine.low, fine.base, fine.seq, WIDE))
        for start in range(0, len(self.dense), STEP):
            own = np.arange(start, min(start + STEP, len(self.dense)))
            bound = self._bounds(own, coarse, slice(None))
            # The tiles that may hold a target's best give it a limit, which spares it most others.
            for _ in range(1 if self.seen else FIRST):
                top = bound.argmax(axis=1)
                first = np.flatnonzero(bound[np.arange(len(own)), top] >= self.limit[own])
                self._compare(own[first], top[first][:, None] * WIDE + np.arange(WIDE)[None, :])
                bound[np.arange(len(own)), top] = -np.inf
            met, size = [], 0
            for tile in np.flatnonzero((bound >= self.limit[own][:, None]).any(axis=0)):
                t = own[bound[:, tile] >= self.limit[own]]
                t, at = np.nonzero(self._bounds(t, fine, slice(tile * WIDE, (tile + 1) * WIDE)) >= self.limit[t][:, None]), t
                met.append((at[t[0]], (tile * WIDE + t[1])[:, None]))
                size += len(t[0])
                if size * TILE >= PAIRS:
                    self._compare(*map(np.concatenate, zip(*met, strict=True)))
                    met, size = [], 0
            if met:
                self._compare(*map(np.concatenate, zip(*met, strict=True)))
        new = np.nonzero(self.age >= self.seen)
        picked = pa.array(self.age[new] - self.seen)
        self.ids[new], self.seqs[new] = items.column("id").take(picked).to_pylist(), items.column("seq").take(picked).to_pylist()
        self.seen += n

    def _bounds(self, t: np.ndarray, tiles: _Tiles, of: slice) -> np.ndarray:
        """The score that no item of a tile exceeds, for each target and tile; none that counts where all items are too late."""
        dense = self.dense[t]
        out = dense @ tiles.middle[of].T + np.abs(dense) @ tiles.reach[of].T
        out = tiles.base[of][None, :] + V.PAIR_SCORES["cosine"] * (np.maximum(out, 0) + MARGIN)
        if self.incremental:
            out[tiles.seq[of][None, :] >= self.seq[t][:, None]] = -np.inf
        return out

    def _compare(self, t: np.ndarray, tiles: np.ndarray) -> None:
        """Each target with the items of its row of tiles."""
        size = tiles.shape[1] * TILE
        step = max(PAIRS // size, 1)
        for n in range(0, len(t), step):
            own, of = t[n : n + step], tiles[n : n + step]
            close = np.zeros((*of.shape, TILE))
            for j in range(self.at.shape[1]):  # in the order of the target's slots, as in embed.sparse_cosine
                close += self.v[own, j][:, None, None] * self.x[of * V.EMBEDDING_DIM + self.at[own, j][:, None]]
            item = (of[:, :, None] * TILE + np.arange(TILE)).reshape(-1, size)
            close = np.clip(close, -1.0, 1.0).reshape(-1, size)
            score = self.base[item] + np.where(close > 0, close * V.PAIR_SCORES["cosine"], 0.0)
            real = score >= self.limit[own][:, None]
            row, column = np.nonzero(real)
            at = item[row, column]
            apart = self.doc[own[row]] != self.i_doc[at]
            if self.incremental:
                apart &= self.i_seq[at] < self.seq[own[row]]
            real[row, column] = apart
            if size > 2 * TILE:  # no more than the first k of these are of use
                score[~real] = -np.inf
                real &= score >= np.partition(score, size - self.k, axis=1)[:, size - self.k][:, None]
            row, column = np.nonzero(real)
            self._keep(own[row], self.seen + self.order[item[row, column]], score[row, column])

    def _keep(self, t: np.ndarray, age: np.ndarray, score: np.ndarray) -> None:
        """Merge scored items into the best of their targets; ties go to the earlier."""
        k, last = self.k, self.best[t, -1]
        keep = (score >= self.limit[t]) & ((score > last) | ((score == last) & (age < self.age[t, -1])))
        t, age, score = t[keep], age[keep], score[keep]
        if not len(t):
            return
        own = np.unique(t)
        t, age, score = np.concatenate([t, np.repeat(own, k)]), np.concatenate([age, self.age[own].ravel()]), np.concatenate([score, self.best[own].ravel()])
        ids, seqs = np.full(len(t), None, object), np.full(len(t), None, object)
        ids[-len(own) * k :], seqs[-len(own) * k :] = self.ids[own].ravel(), self.seqs[own].ravel()
        order = np.lexsort((age, -score, t))
        starts = np.flatnonzero(np.diff(t[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        first = order[rank < k]
        for mine, fresh in ((self.best, score), (self.age, age), (self.ids, ids), (self.seqs, seqs)):
            mine[own] = fresh[first].reshape(-1, k)
        self.limit[own] = np.maximum(self.limit[own], self.best[own, -1])

    def found(self) -> pa.RecordBatch:
        t, rank = np.nonzero(self.best > -np.inf)
        columns = [self.targets.take(pa.array(t)).combine_chunks(), pa.array(self.ids[t, rank], pa.string()), pa.array(self.seqs[t, rank], pa.int64()), pa.array(self.best[t, rank])]
        return pa.RecordBatch.from_arrays(columns, ["target", "candidate", "c_seq", "score"])


def _searched(k: int, incremental: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of parts, each the targets and then the items in the order of ties: the ``k`` best items of each target."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, waiting, rows = None, None, [], 0

        def flush(targets: bool) -> None:
            nonlocal part, waiting, rows
            if waiting and targets:
                part = _Part(pa.Table.from_batches(waiting), k, incremental)
            elif waiting and part is not None:
                part.meet(pa.Table.from_batches(waiting))
            waiting, rows = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            p, number, item = batch.column("p").dictionary_encode(), batch.column("part").to_numpy(), batch.column("item").to_numpy(zero_copy_only=False)
            changed = (np.diff(p.indices.to_numpy()) != 0) | (np.diff(number) != 0) | (np.diff(item.astype(np.int8)) != 0)
            ends = [*(np.flatnonzero(changed) + 1), batch.num_rows]
            for start, end in zip([0, *ends], ends, strict=False):
                now = (p[start].as_py(), int(number[start]), bool(item[start]))
                if now != key:
                    flush(key is not None and not key[2])
                    if part is not None and now[:2] != key[:2]:
                        yield part.found()
                        part = None
                    key = now
                waiting.append(batch.slice(start, end - start))
                rows += end - start
                if key[2] and rows >= SLAB:
                    flush(False)
        flush(key is not None and not key[2])
        if part is not None:
            yield part.found()

    return run


def block_search(targets: DataFrame, items: DataFrame, fields: DataFrame, k: int, incremental: bool, score: Callable[..., Column]) -> DataFrame:
    """target, candidate, c_seq, score: the ``k`` best ``items`` of other documents for each target by the score of unrelated subjects.

    ``targets``: target, p, nz, doc, seq, least (a score that candidates have to reach, or null). ``items``: p, nz, id, doc, seq. ``fields``: x, y, the predicates
    whose items (y) a predicate's targets (x) meet. ``score``: of (a_s, a_p, b_s, b_p, cosine). ``incremental``: only items of a smaller seq count.
    """
    known = "doc is not null and seq is not null" if incremental else "doc is not null"
    targets, items = targets.where(known), items.where(known)
    n = targets.count()
    parts = max(-(-n // TARGETS), min(2 * targets.sparkSession.sparkContext.defaultParallelism, n // FEWEST), 1)
    # Time is cut where each predicate's targets fall into equal shares; a share is a part, or several are where the predicate has few.
    cuts = F.percentile_approx("seq", [i / parts for i in range(1, parts)], 10_000) if incremental and parts > 1 else F.array().cast("array<bigint>")
    shares = targets.groupBy(F.col("p").alias("x")).agg(cuts.alias("cuts"), F.ceil(F.count(F.lit(1)) * parts / F.lit(n)).cast("int").alias("parts"))
    share = F.floor(F.size(F.filter("cuts", lambda c: c <= F.col("seq"))) * F.col("parts") / F.lit(parts)).cast("int") if incremental else F.pmod(F.hash("id"), F.col("parts"))
    shape = ["p", "part", "item", "seq", "id", "doc", "score", "nz"]
    own = targets.select("p", F.col("seq").cast("long").alias("seq"), F.col("target").alias("id"), "doc", F.col("least").alias("score"), "nz").join(F.broadcast(shares), F.col("p") == F.col("x"))
    own = own.withColumns({"part": share, "item": F.lit(False)}).select(*shape)
    base = score(F.lit("a"), F.col("x"), F.lit("b"), F.col("y"), F.lit(0.0))
    met = F.broadcast(fields.select("x", "y", base.alias("score")).join(shares, "x"))
    held = items.select(F.col("p").alias("y"), F.col("seq").cast("long").alias("seq"), "id", "doc", "nz").join(met, "y")
    # A later target is in the same part or one after.
    numbers = F.sequence(share if incremental else F.lit(0), F.col("parts") - 1)
    held = bind(held, numbers=numbers).withColumns({"part": F.explode("numbers"), "p": F.col("x"), "item": F.lit(True)}).select(*shape)
    stream = own.unionByName(held).repartition(4 * parts, "p", "part").sortWithinPartitions("p", "part", "item", "seq", "id")
    return stream.mapInArrow(_searched(k, incremental), "target string, candidate string, c_seq long, score double")
