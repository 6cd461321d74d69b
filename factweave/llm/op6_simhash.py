"""SimHash near-duplicate groups by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its sixteen 4-bit segments. The Manhattan distance of two such vectors is
a lower bound of the Hamming distance of the fingerprints, so fingerprints that link lie within distance 2 on an
integer grid. The range join meets in the middle: each fingerprint goes to its own cell and to the cells one step away,
and any two points at distance 2 or less share one. Cells are aggregated to count, least and greatest fingerprint
before anything is shuffled, so a cell with two members is its pair, verified by one XOR.

Cells with three and more members never list their pairs. Their members go on to a finer grid: segments of two bits, then of
one. On that last grid the distances are equal and a cell holds at most 65 distinct fingerprints, each within one bit of it;
they are linked to the least of them, which joins the same groups as all their pairs. So work is linear in the number of
fingerprints, however they crowd.

Components come from minimum-label propagation with pointer jumping over distinct fingerprints; each round is a table
in the shared folder. Exact copies are one fingerprint throughout and are not expanded.

The pipeline's stage asks for five-word shingles and a similarity of 0.8, at which SimHashes differ in about ten bits: no grid
of this kind is that wide. :func:`similar` takes the grid join's links as candidates, adds those of a banded minimum hash, and
verifies every one on the whole sets. Pairs that never meet so are found by a prefix join, which misses none: in one order of all
shingles, frequent ones last, sets that are similar enough share one of their first ones. It looks at sets of different groups only.

Defined results: null and empty texts and texts of white space have fingerprint zero and link like others; rows without an
id get the component of their group, which is null if no row of the group has an id; repeated rows are in one group;
an empty table gives an empty result; further columns are ignored by :func:`groups` and kept by :func:`one_per_group`.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .common import bounded_batches, collected, documents, materialize, release, row_key, utf8

SHINGLE, SEED, DISTANCE = 3, 42, 2
SALTS = 16
#: Bits of a segment on the first grid, and on those for members of crowded cells.
WIDTHS = (4, 2, 1)
#: The pipeline's stage: near copies by word shingles.
STAGE_SHINGLE, STAGE_LEAST, BANDS, ROWS = 5, 0.8, 20, 5
#: Frequent shingles come last in the order of the prefix join: up to FREQUENT of those of about SAMPLE texts. Any order gives the same links.
SAMPLE, FREQUENT = 20_000, 1 << 18
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ROW = (np.arange(8) * 256).astype(np.int64)
_PLACE = (np.arange(8)[:, None] * 8 + np.arange(8)).astype(np.uint64)


def gram_hashes(data: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of UTF-8 bytes, repeats included; of all words together, if they are fewer."""
    words = data.lower().split()  # bytes: A-Z only, and exactly the white space 09-0D and 20
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(words) - shingle + 1)


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: bit set if set in over half of them."""
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8) + _ROW
        counts += np.bincount(part.ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ _BITS
    return int(((2 * ones > len(h)).astype(np.uint64) << _PLACE).sum())


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of UTF-8 bytes."""
    return majority(gram_hashes(data, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, k, fp (the fingerprint's 64 bits as a long)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, shingle, seed) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "k", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("k"), utf8("text").alias("data")).mapInArrow(run, "doc_id long, k long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _counts(x: Column, width: int) -> Column:
    """Bit counts of the segments of ``width`` bits, one in each ``width`` bits of a long. In two halves, so that nothing overflows."""
    if width == 1:
        return x

    def half(v: Column) -> Column:
        v = v.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(0x55555555))
        return v if width == 2 else v.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(v, 2).bitwiseAND(F.lit(0x33333333))

    low, high = half(x.bitwiseAND(F.lit(0xFFFFFFFF))), half(F.shiftrightunsigned(x, 32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _cells(fps: DataFrame, width: int) -> DataFrame:
    """cell, fp: the grid cell of the fingerprint's embedding and those one step away."""
    p = F.col("p")
    steps = [p]
    for at in range(0, 64, width):
        mask = ((1 << width) - 1) << at
        count, rest = F.shiftrightunsigned(p, at).bitwiseAND(F.lit((1 << width) - 1)), p.bitwiseAND(F.lit(_signed(~mask & ((1 << 64) - 1))))
        steps += [F.when(count < width, rest.bitwiseOR(F.shiftleft(count + 1, at))), F.when(count > 0, rest.bitwiseOR(F.shiftleft(count - 1, at)))]
    return fps.select("fp", _counts(F.col("fp"), width).alias("p")).select("fp", F.explode(F.array(*steps)).alias("cell")).where("cell is not null")


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints ``fps`` (column fp) that join the same groups as all pairs within two bits."""
    crowd, found = fps, []
    close = f"bit_count(a ^ b) <= {DISTANCE}"
    for width in WIDTHS[:-1]:
        cells = _cells(crowd, width)
        shared = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), f"cells{width}")
        found.append(shared.where("n = 2").where(close).select("a", "b"))
        crowd = materialize(cells.join(shared.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct(), f"crowd{width}")
    last = _cells(crowd, WIDTHS[-1]).groupBy("cell").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # at most 65 in each
    stars = last.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").where(close)
    out = stars
    for f in found:
        out = out.union(f)
    return out.distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """fp, least: the least ``first`` of the component, for every fp that ``edges`` (a, b) name. ``nodes``: fp, first."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    own = F.struct(F.col("first"), F.col("fp").alias("root"))
    linked = nodes.join(both.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi")
    table = label = materialize(linked.select("fp", own.alias("label")), "label")
    while True:
        seen = both.join(label, both.b == label.fp).groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("seen"))
        least = label.join(seen, "fp").select("fp", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        least = materialize(least, "label")
        # A root may be the label of very many: both sides of the jump are salted.
        roots = least.select("label").distinct().select(F.col("label.root").alias("fp")).distinct()
        jump = least.join(roots, "fp", "left_semi").select(F.col("fp").alias("root"), F.col("label").alias("to"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        salted = least.select("*", F.col("label.root").alias("root"), F.pmod(F.hash("fp"), F.lit(SALTS)).alias("salt"))
        after = salted.join(jump, ["root", "salt"]).select("fp", F.least("label", "to").alias("label"), "was")
        after = materialize(after, "label")
        release(table, least)
        table, label = after, after.select("fp", "label")
        if after.where("label.root <> was.root").isEmpty():
            return label.select("fp", F.col("label.first").alias("least"))


def _order() -> Column:
    """Rows by id, then text; those without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")


def groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, k, fp, component of every document; component is the first row (doc_id, k) reachable over links."""
    each = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min(_order()).alias("first")), "distinct")
    least = components(links(distinct.select("fp")), distinct)
    by_fp = materialize(distinct.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("component")), "by_fp")
    return each.join(by_fp, "fp").select("doc_id", "k", "fp", "component")


def _first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The documents, with their own columns, whose row (doc_id, k) is the first of its ``component``; rows that repeat it leave one.

    Rows without an id stay.
    """
    keep = grouped.where("doc_id = component.doc_id and k = component.k").select(F.col("doc_id").alias("_fw_id"), F.col("k").alias("_fw_of")).distinct()
    names = docs.columns
    keyed = docs.where("doc_id is not null").withColumn("_fw_key", row_key())
    stay = keyed.join(keep, (F.col("_fw_key") == F.col("_fw_of")) & (keyed.doc_id.cast("long") == F.col("_fw_id"))).dropDuplicates(["_fw_id", "_fw_key"])
    return stay.select(*[keyed[c] for c in names]).unionByName(docs.where("doc_id is null"))


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The documents, with their own columns, of which one of each group stays: that with the smallest id, then key of id and text.

    Rows that repeat the staying row's id and text are one document and leave one row; rows without an id stay.
    """
    return _first_rows(docs, groups(docs, shingle, seed))


def bands(values: np.ndarray) -> list[int]:
    """A key of each band of ROWS minimum hashes of the shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1 << 12):
        x = values[at : at + (1 << 12), None] * _ODD
        low = np.minimum(low, ((x ^ (x >> np.uint64(32))) * _ODD).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(low.reshape(BANDS, ROWS))]


def frequent(data: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that several texts of a sample hold, by rising number of texts."""
    every = max(1, data.count() // SAMPLE)
    part = data.where(F.pmod(F.xxhash64("data"), F.lit(every)) == 0).dropDuplicates(["data"]).select("data")

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(gram_hashes(x, shingle)).view(np.int64))], names=["token"])

    counts = part.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = collected(counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token"))
    return top["token"].to_numpy()[::-1].copy().view(np.uint64)


def prefix(values: np.ndarray, least: float, late: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted), of which a set with a similarity of ``least`` to it holds one; none if no other set can have it.

    The order is that of the values, but those in ``late`` (sorted) come last, by ``ranks``.
    """
    n = len(values)
    if n < least * (n + 1) - 1e-9:
        return values[:0]
    at = np.minimum(np.searchsorted(late, values), max(len(late) - 1, 0))
    last = late[at] == values if len(late) else np.zeros(n, bool)
    return np.concatenate([values[~last], values[last][np.argsort(ranks[at[last]])]])[: n - int(np.ceil(least * n - 1e-9)) + 1]


def apart(sets: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of ``sets`` (fp, comp, n, prefix) of different groups (comp) that may be similar, and all that are.

    A shingle's sets are joined with those outside its largest group, so copies and chains of one group cost nothing here. A pair's
    common prefix shingles and what is left behind the last of them bound what it can share.
    """
    held = sets.select("fp", "comp", "n", F.posexplode("prefix").alias("at", "token"))
    mixed = materialize(held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "mixed")
    members = materialize(held.join(mixed, "token", "left_semi"), "members")
    main = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
    of = materialize(members.join(main, "token"), "of")
    one = of.where("comp <> main").select("token", F.col("fp").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    two = of.select("token", F.col("fp").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"), (F.col("comp") == F.col("main")).alias("inmost"))
    met = one.join(two, "token").where("ca <> cb and (inmost or a < b)").where(F.least("na", "nb") >= F.lit(least - 1e-9) * F.greatest("na", "nb"))
    behind, first = F.least(F.expr("na - pa"), F.expr("nb - pb")) - 1, F.ceil(F.greatest("na", "nb") * F.lit(least) - 1e-9) - 1
    facts = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), behind.alias("behind"), first.alias("first"), ((F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - 1e-6).alias("need"))
    pairs = facts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("behind").alias("behind"), F.first("first").alias("first"), F.first("need").alias("need"))
    out = materialize(pairs.where(F.col("shared") + F.least("behind", "first") >= F.col("need")).select("a", "b"), "apart")
    release(mixed, members, of)
    return out


def similar(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """doc_id, k, fp, component: rows by key, and the component of those whose shingle sets have a Jaccard similarity of ``least`` or more.

    Candidates are the grid join's links between SimHashes, and sets that share a band of minimum hashes; each meets one centre
    of its SimHash or of its band's bucket, another in each band, so work is linear in a group. What these leave in different
    groups meets in the prefix join of :func:`apart`, so groups are those of all pairs. Every link is verified on the whole sets;
    rows of equal sets (fp) are one node.
    """
    bounded_batches(docs.sparkSession)
    data = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("data"))
    order = frequent(data, shingle)
    late = np.sort(order)
    ranks = np.argsort(order)  # order[ranks] is sorted, so ranks[i] is the place of late[i]

    def sign(batches):
        for b in batches:
            hashes = [gram_hashes(x, shingle) for x in b.column(2).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            fp = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64())
            sim = pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64))
            n, first = pa.array([len(x) for x in sets], pa.int32()), [prefix(x, least, late, ranks).view(np.int64) for x in sets]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([bands(x) for x in sets], first)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, sim, n, *lists], names=["k", "doc_id", "fp", "sim", "n", "bands", "prefix"])

    signed = materialize(data.mapInArrow(sign, "k long, doc_id long, fp long, sim long, n int, bands array<long>, prefix array<long>"), "signed")
    nodes = materialize(signed.groupBy("fp").agg(F.min(_order()).alias("first"), *[F.first(c).alias(c) for c in ("sim", "n", "bands", "prefix")]), "nodes")

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    by_sim = materialize(nodes.groupBy("sim").agg(F.min("fp").alias("centre")), "by_sim")
    one, two = by_sim.select(F.col("sim").alias("a"), F.col("centre").alias("x")), by_sim.select(F.col("sim").alias("b"), F.col("centre").alias("y"))
    of_grid = links(by_sim.select(F.col("sim").alias("fp"))).join(one, "a").join(two, "b").select(*pair("x", "y"))
    of_sim = nodes.select("fp", "sim").join(by_sim, "sim").where("fp <> centre").select(*pair("fp", "centre"))
    member = nodes.select("fp", F.explode("bands").alias("band"))
    turn = F.struct(F.xxhash64("fp", "band").alias("turn"), "fp")
    centre = member.groupBy("band").agg(F.min(turn)["fp"].alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "centre")
    of_band = member.join(centre, "band").where("fp <> centre").select(*pair("fp", "centre"))
    pairs = materialize(of_grid.union(of_sim).union(of_band).distinct(), "candidates")

    def verify(batches):
        for b in batches:
            keep, texts = [], [b.column(i).to_pylist() for i in (2, 3)]
            sets = {x: np.unique(gram_hashes(x, shingle)) for x in {*texts[0], *texts[1]}}
            for x, y in zip(*texts, strict=True):
                x, y = sets[x], sets[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        one = nodes.join(wanted, "fp", "left_semi").select("fp", F.col("first.k").alias("k"))
        texts = materialize(data.join(one, "k").dropDuplicates(["fp"]).select("fp", "data"), "texts")
        left, right = texts.select(F.col("fp").alias("a"), F.col("data").alias("x")), texts.select(F.col("fp").alias("b"), F.col("data").alias("y"))
        edges = materialize(spread(pairs).join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
        release(pairs, texts)
        return edges

    edges = verified(pairs)
    found = components(edges, nodes.select("fp", "first"))
    sets = nodes.where("size(prefix) > 0").join(found, "fp", "left").select("fp", F.coalesce("least", "first")["k"].alias("comp"), "n", "prefix")
    more = verified(apart(sets, least))
    if not more.isEmpty():
        found = components(edges.union(more), nodes.select("fp", "first"))
    by_fp = nodes.join(found, "fp", "left").select("fp", F.coalesce("least", "first").alias("component"))
    return signed.select("doc_id", "k", "fp").join(by_fp, "fp")


def one_of_similar(docs: DataFrame, shingle: int = STAGE_SHINGLE, least: float = STAGE_LEAST) -> DataFrame:
    """The documents, with their own columns, of which one of each group of :func:`similar` texts stays, as in :func:`one_per_group`."""
    return _first_rows(docs, similar(docs, shingle, least))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component.doc_id").alias("component_id"))
