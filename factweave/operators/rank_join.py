"""The best pairs of equal predicate without comparing all of them: a rank join over impact-ordered posting lists.

Within a predicate the score of two facts of unrelated subjects depends on the dot product of their embeddings alone. Slots
of many embeddings (those of the predicate's own words, of common scopes) are told apart as frequent; the others are rare. A
posting list holds the facts with one rare signed slot, or none asked for (slot -1), that also have the same values there and
at all frequent slots: facts of a list that share nothing else with a target have the same score with it, the list's bound,
so their order is that of ties. A target meets

1. the heads of its best lists by bound, and the facts with which it shares two rare signed slots, of those embeddings that can beat the eighth best of these heads;
   the eighth best of both is its threshold;
2. the heads of the other lists whose bound beats the threshold;
3. the rest of those lists whose first unseen fact could still beat the eighth.

A fact that shares two rare slots is met in 1; any other scores no more than the bound of the list of the slot it shares, or of the
list without, so what is never met can't be among the best. The result is exact, whatever the sizes of heads and
probes; they decide only how many pairs are compared. The second part of 1 compares embeddings, each two once, however many
facts and targets have them. In the worst case (rare slots that come in pairs with very many different embeddings) it still compares all these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..session import dropped, written

#: Facts of a list's head, and eligible facts after which no more lists are probed for the threshold.
HEAD, PROBE = 16, 32
#: A slot is frequent if so many times the mean number of embeddings have it.
FREQUENT = 2.0
_GROUP = ["a", "t_doc", "t_seq"]


def _key(x: Column) -> Column:
    """A signed slot as a number."""
    return x["at"] * 2 + (x["v"] > 0).cast("int")


def frequent_slots(signatures: DataFrame) -> DataFrame:
    """p, frequent: the frequent slots of each predicate."""
    counts = signatures.select("p", F.explode("nz").alias("x")).groupBy("p", F.col("x.at").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.groupBy("p").agg((F.sum("n") / V.EMBEDDING_DIM).alias("mean"))
    return counts.join(mean, "p").where(F.col("n") > FREQUENT * F.col("mean")).groupBy("p").agg(F.array_sort(F.collect_list("at")).alias("frequent"))


def _parts(signed: DataFrame, frequent: DataFrame) -> DataFrame:
    """With ``common`` and ``rare``, the frequent and other non-zero slots."""
    held = lambda x: F.array_contains(F.coalesce("frequent", F.array().cast("array<int>")), x["at"])
    both = signed.join(frequent, "p", "left")
    return both.withColumns({"common": F.filter("nz", held), "rare": F.filter("nz", lambda x: ~held(x))}).drop("frequent")


def posting_entries(items: DataFrame) -> DataFrame:
    """A row for each list that a fact is in: list, slot, and what makes the list. ``items``: with common and rare."""
    slots = F.concat(F.array(F.struct(F.lit(-1).alias("slot"), F.lit(0.0).alias("v"))), F.transform("rare", lambda x: F.struct(_key(x).alias("slot"), x["v"].alias("v"))))
    return items.withColumn("e", F.explode(slots)).select("*", "e.slot", "e.v", F.xxhash64("p", "e.slot", "e.v", "common").alias("list")).drop("e")


def posting_lists(entries: DataFrame) -> DataFrame:
    """list, p, slot, at (slot -> value of all that its facts share), heads in the order of ties, and whether there are more facts."""
    order = Window.partitionBy("list").orderBy("seq", "id")
    first = entries.withColumn("n", F.row_number().over(order)).where(F.col("n") <= HEAD + 1)
    fact = F.struct("n", "seq", "id", "doc", "s", "nz")
    packed = first.groupBy("list", "p", "slot", "v", "common").agg(F.array_sort(F.collect_list(fact)).alias("heads"))
    own = F.when(F.col("slot") < 0, F.array().cast("array<struct<at:int,v:double>>")).otherwise(F.array(F.struct(F.shiftright("slot", 1).alias("at"), F.col("v").alias("v"))))
    return packed.select("list", "p", "slot", F.map_from_entries(F.concat("common", own)).alias("at"), F.slice("heads", 1, HEAD).alias("heads"), (F.size("heads") > HEAD).alias("more"))


def _dot(nz: Column, at: Column) -> Column:
    """Dot product over the non-zero slots of ``nz`` in order, as in ``embed.sparse_cosine``."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(nz, F.lit(0.0), lambda total, x: total + x["v"] * F.coalesce(F.try_element_at(at, x["at"]), F.lit(0.0)))))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each target, with their rank; a candidate found twice counts once."""
    ranked = Window.partitionBy(*_GROUP).orderBy(F.col("score").desc(), "seq", "id")
    once = scored.select(*_GROUP, "id", "seq", "score").repartition(*_GROUP).dropDuplicates([*_GROUP, "id"])
    return once.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _kind(p: str, nz: str) -> Column:
    """A predicate and an embedding as a number."""
    return F.xxhash64(p, nz)


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def twofold_kinds(targets: DataFrame, items: DataFrame, score: Callable[..., Column]) -> DataFrame:
    """kind, item_kind, bound, first: the embeddings of one predicate that share two rare signed slots, with the score of unrelated facts and the item's first fact.

    Dealt to a fixed number of partitions, since the tables are small and what they make is not.
    """
    parts = _partitions(targets)
    a = targets.select(_kind("p", "nz").alias("kind"), "p", F.col("nz").alias("a_nz"), "rare").dropDuplicates(["kind"])
    b = items.groupBy(_kind("p", "nz").alias("item_kind"), "p").agg(F.first("nz").alias("b_nz"), F.first("rare").alias("rare"), F.min(F.struct("seq", "id")).alias("first"))
    keys = F.array_sort(F.transform("rare", _key))
    two = F.flatten(F.transform(keys, lambda x, i: F.transform(F.slice(keys, i + 2, F.size(keys)), lambda y: F.struct(x.alias("one"), y.alias("two")))))

    def pair(kinds: DataFrame, name: str) -> DataFrame:
        return kinds.where("size(rare) > 1").select(name, "p", F.explode(two).alias("two")).repartition(parts, "p", "two")

    shared = pair(a, "kind").join(pair(b, "item_kind"), ["p", "two"]).select("p", "kind", "item_kind").distinct().repartition(parts, "kind", "item_kind")
    both = shared.join(a.select("kind", "a_nz"), "kind").join(b.select("item_kind", "b_nz", "first"), "item_kind")
    return both.select("kind", "item_kind", score(F.lit("a"), F.col("p"), F.lit("b"), F.col("p"), _dot(F.col("a_nz"), F.map_from_entries("b_nz"))).alias("bound"), "first")


def rank_join(targets: DataFrame, items: DataFrame, signatures: DataFrame, k: int, incremental: bool, score: Callable[..., Column], compared: Callable[[DataFrame], object] | None = None) -> DataFrame:
    """a, t_doc, t_seq, id, seq, score, rank: the ``k`` best ``items`` of other documents for each target, of those with its predicate.

    ``targets``: a, t_doc, t_seq, p, s, nz. ``items``: p, s, nz, id, seq, doc; at most a few facts a signature. ``signatures``: p, nz of the items. ``score``: of
    (a_s, p, b_s, p, cosine). ``incremental``: only items of a smaller seq count. ``compared`` gets each table of scored pairs.
    """
    frequent = frequent_slots(signatures)
    items = _parts(items, frequent)
    entries = posting_entries(items)
    lists = written(posting_lists(entries).repartition(_partitions(targets), "list"), "lists")
    own = written(_parts(targets, frequent).repartition(_partitions(targets), *_GROUP), "targets")  # few rows that meet many lists: dealt out, not one split
    apart = (F.col("doc") != F.col("t_doc")) & ((F.col("seq") < F.col("t_seq")) if incremental else F.lit(True))

    def scored(pairs: DataFrame) -> DataFrame:
        """``pairs`` with a_p, a_s, a_nz and s, nz, seq, id, doc of an item."""
        close = _dot(F.col("a_nz"), F.map_from_entries("nz"))
        out = pairs.where(apart).select(*_GROUP, "id", "seq", score(F.col("a_s"), F.col("a_p"), F.col("s"), F.col("a_p"), close).alias("score"))
        if compared is not None:
            compared(out)
        return out

    asking = own.select(*_GROUP, F.col("p").alias("a_p"), F.col("s").alias("a_s"), F.col("nz").alias("a_nz"), F.explode(F.concat(F.array(F.lit(-1)), F.transform("rare", _key))).alias("a_slot"))
    brief = lists.select("list", "p", "slot", "at", F.transform("heads", lambda h: h["seq"]).alias("seqs"), "more", *[F.struct(F.element_at("heads", n)["seq"].alias("seq"), F.element_at("heads", n)["id"].alias("id")).alias(name) for n, name in ((1, "first"), (-1, "last"))])
    met = asking.join(brief, (F.col("a_p") == F.col("p")) & (F.col("a_slot") == F.col("slot")))
    ready = F.size(F.filter("seqs", lambda s: s < F.col("t_seq"))) if incremental else F.size("seqs")
    met = met.withColumns({"ready": ready, "bound": score(F.lit("a"), F.col("a_p"), F.lit("b"), F.col("a_p"), _dot(F.col("a_nz"), F.col("at")))}).where("ready > 0")
    before = Window.partitionBy(*_GROUP).orderBy(F.col("bound").desc(), "first", "list").rowsBetween(Window.unboundedPreceding, -1)
    bounded = met.select(*_GROUP, "a_p", "a_s", "a_nz", "list", "bound", "first", "last", (F.col("more") & (F.col("ready") == F.size("seqs"))).alias("open"), F.coalesce(F.sum("ready").over(before), F.lit(0)).alias("before"))
    bounded = written(bounded, "bounded")

    def heads(of: DataFrame) -> DataFrame:
        facts = lists.select("list", F.explode("heads").alias("h")).select("list", "h.*")
        return scored(of.join(facts, "list"))

    def threshold(best: DataFrame) -> DataFrame:
        return best.where(F.col("rank") == k).select(*_GROUP, F.col("score").alias("least"), F.struct("seq", "id").alias("least_tie"))

    def beats(tie: str) -> Column:
        return F.col("least").isNull() | (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (F.col(tie) < F.col("least_tie")))

    probed = written(_best(heads(bounded.where(F.col("before") < PROBE)), k), "probed")
    # Two embeddings are compared once, whatever the facts behind them; facts are read of those that can beat a target's threshold.
    least = threshold(probed)
    kinds = twofold_kinds(own, items, score)
    near = written(own.select(*_GROUP, F.col("p").alias("a_p"), F.col("s").alias("a_s"), F.col("nz").alias("a_nz"), _kind("p", "nz").alias("kind")).join(least, _GROUP, "left").join(kinds, "kind").where(beats("first")), "near")
    ready_kinds = near.where(F.col("first.seq") < F.col("t_seq")) if incremental else near
    twice = ready_kinds.join(items.select(_kind("p", "nz").alias("item_kind"), "s", "nz", "seq", "id", "doc"), "item_kind")
    once = written(_best(probed.drop("rank").unionByName(scored(twice)), k), "best")

    more = heads(bounded.where(F.col("before") >= PROBE).join(threshold(once), _GROUP, "left").where(beats("first")))
    twofold = written(_best(once.drop("rank").unionByName(more), k), "best")
    rest = bounded.where("open").join(threshold(twofold), _GROUP, "left").where(beats("last"))
    unseen = rest.join(entries.select("list", "s", "nz", "seq", "id", "doc"), "list").where(F.struct("seq", "id") > F.col("last"))
    out = written(_best(twofold.drop("rank").unionByName(scored(unseen)), k), "ranked")
    dropped(lists, own, bounded, probed, near, once, twofold)
    return out
