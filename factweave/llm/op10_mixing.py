"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed 36-bit hash, the head of an MD5 of its id and text. For each source the sizes are summed by the leading 12 bits of the hash, the
bucket in which the running sum passes the budget is found, and only that bucket is histogrammed again by the next 12
bits, three levels deep. What lies below the nested threshold is taken; nothing is sorted and no document list is
gathered. A budget above the source's size takes every document once and the documents below the threshold once more.

Sources stay in tables, however many they are: weights follow from ranks within range partitions, and the resharing of
excess sends two sums a round to the driver. Tables with a row a source are broadcast while their bytes are few; beyond
that they are joined in a shuffle, by source and bucket or by source and salt, so a hot source is no single task.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; rows without an id are
hashed by their text, so they mix like others; rows equal in id and text share a hash and are taken together; a source
without words has target 0; an empty table gives an empty result; further columns of the input are ignored by
:func:`mix` and kept by :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, release

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
LEVEL_BITS, LEVELS = 12, 3
#: Up to so many bytes the tables with a row a source are broadcast; beyond it they are joined in a shuffle.
BROADCAST_BYTES = 4 << 20
SALTS = 32


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def hash_prefix(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def _sources(base: DataFrame, weights) -> DataFrame:
    """skey, source_size, weight of every source: weights repeat in the order of the sources, null last."""
    order = [F.col("skey") == "n", F.col("skey")]
    totals = base.groupBy("skey").agg(F.sum("size").alias("source_size"))
    dealt = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = materialize(dealt, "places")
    part, row = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("row")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    out = dealt.withColumns({"part": part, "row": row}).join(F.broadcast(starts), "part").select("skey", "source_size", weight.alias("weight"))
    out = materialize(out, "sources")
    release(dealt)
    return out


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``sources`` with target: by weight, stopped at ``most`` times the source, the excess reshared until none is above.

    A stopped source stays stopped, since what is left for a unit of weight only grows; each round sends three numbers to the driver.
    """
    full = F.lit(float(most)) * F.col("source_size")
    first = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    words, left, weight, stopped = share * (first["size"] or 0), share * (first["size"] or 0), first["weight"] or 0, 0
    while True:
        over = (F.lit(float(left)) * F.col("weight") / F.lit(float(weight)) > full) if weight else F.lit(True)
        if not weight:
            break
        now = sources.agg(F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n")).first()
        if now["n"] == stopped:
            break
        left, weight, stopped = words - (now["full"] or 0), now["weight"] or 0, now["n"]
    shared = F.lit(float(left)) * F.col("weight") / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(over, full).otherwise(shared))


def _thresholds(base: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """skey, threshold, with_last (whether the last bucket is taken too), for the budgets of ``sources`` (skey, budget)."""
    hint = F.broadcast if small else (lambda x: x)
    cut = sources.select("skey", F.lit(0).cast("long").alias("at"), "budget", F.lit(0).cast("long").alias("last"))
    before = None
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        keyed = base.select("skey", "size", F.shiftrightunsigned("prefix", shift + LEVEL_BITS).alias("at"), F.shiftrightunsigned("prefix", shift).alias("bucket"))
        within = keyed.join(hint(cut.select("skey", "at")), ["skey", "at"], "left_semi") if level else keyed
        sums = within.groupBy("skey", "bucket").agg(F.sum("size").alias("size"))
        by_bucket = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 4,096 rows at most
        above = sums.withColumn("upto", F.sum("size").over(by_bucket)).join(hint(cut.select("skey", "budget")), "skey").where("upto > budget")
        nearest = above.groupBy("skey").agg(F.min_by(F.struct("bucket", "size", "upto"), "bucket").alias("x"))
        covered = F.col("x").isNull()  # the budget covers the whole bucket
        at = F.when(covered, F.shiftleft(F.col("at") + 1, LEVEL_BITS)).otherwise(F.col("x.bucket"))
        rest = F.when(covered, 0.0).otherwise(F.col("budget") - (F.col("x.upto") - F.col("x.size")))
        cut = materialize(cut.join(nearest, "skey", "left").select("skey", at.alias("at"), rest.alias("budget"), F.coalesce("x.size", F.lit(0)).alias("last")), "cut")
        if before is not None:
            release(before)
        before = cut
    return cut.select("skey", F.col("at").alias("threshold"), ((F.col("budget") * 2 >= F.col("last")) & (F.col("last") > 0)).alias("with_last"))


def plan(base: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> tuple[DataFrame, bool]:
    """A row a source (skey, source_size, target, floor (copies of all), threshold, with_last), and whether these are few bytes. ``base``: skey, size, prefix."""
    sources = _sources(base, weights)
    small = (sources.agg(F.sum(F.octet_length("skey") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most).cast("long"))).otherwise(F.lit(0).cast("long"))
    goal = targets(sources, share, most).withColumn("floor", whole).withColumn("budget", F.col("target") - F.col("floor") * F.col("source_size"))
    out = goal.join(_thresholds(base, goal, small), "skey").select("skey", "source_size", "target", "floor", "threshold", "with_last")
    return materialize(out, "plan"), small


def _with_copies(base: DataFrame, per_source: DataFrame, small: bool, most: int) -> DataFrame:
    below = (F.col("prefix") < F.col("threshold")) | ((F.col("prefix") == F.col("threshold")) & F.col("with_last"))
    if small:
        both = base.join(F.broadcast(per_source), "skey")
    else:
        salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = base.withColumn("salt", F.col("prefix") % SALTS).join(salted, ["skey", "salt"]).drop("salt")
    return both.withColumn("copies", F.least(F.lit(most), F.col("floor") + below.cast("long")))


def _base(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", source_key(F.col("source")).alias("skey"), size_of(F.col("text")).alias("size"), hash_prefix(F.col("doc_id"), F.col("text")).alias("prefix"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document. The texts are read once."""
    base = materialize(_base(docs), "mix")
    out = _with_copies(base, *plan(base, weights, share, most), most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The documents of the mix with their own columns, those taken twice as two rows. No text is shuffled."""
    base = materialize(_base(docs), "mix")
    per_source, small = plan(base, weights, share, most)
    tagged = docs.select(F.struct("*").alias("_fw_row"), source_key(F.col("source")).alias("skey"), hash_prefix(F.col("doc_id"), F.col("text")).alias("prefix"))
    return _with_copies(tagged, per_source, small, most).where("copies > 0").select("_fw_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_fw_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def _level_sql(level: int) -> str:
    """The bucket of a level that the budget ends in, what is left of the budget for it, and its size."""
    shift = LEVEL_BITS * (LEVELS - 1 - level)
    return f"""
sums{level} AS (SELECT skey, prefix >> {shift} AS bucket, sum(size)::BIGINT AS size FROM base JOIN cut{level} USING (skey) WHERE (prefix >> {shift + LEVEL_BITS}) = head GROUP BY ALL),
upto{level} AS (SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY bucket ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM sums{level}),
found{level} AS (SELECT skey, min(bucket) AS bucket, arg_min(u.size, bucket) AS size, arg_min(upto, bucket) AS upto FROM upto{level} u JOIN cut{level} USING (skey) WHERE upto > budget GROUP BY skey),
cut{level + 1} AS (SELECT skey, coalesce(bucket, (head + 1) << {LEVEL_BITS}) AS head, coalesce(budget - (upto - size), 0.0) AS budget, coalesce(size, 0) AS last FROM cut{level} LEFT JOIN found{level} USING (skey))"""


SQL = {
    "op10_mixing": f"""
WITH base AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, {LEVEL_BITS * LEVELS // 4}) AS BIGINT) AS prefix FROM documents),
sources AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY skey = 'n', skey) - 1) % {len(WEIGHTS)} + 1] AS weight FROM (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey)),
filling AS (SELECT *, {float(MOST_COPIES)}::DOUBLE * source_size AS most, {SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum({float(MOST_COPIES)}::DOUBLE * source_size) OVER earlier, 0) AS free,
  sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open FROM sources WINDOW earlier AS (ORDER BY source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopping AS (SELECT *, free * weight / open > most AS over FROM filling),
rest AS (SELECT arg_min(free, (source_size / weight, skey)) AS free, arg_min(open, (source_size / weight, skey)) AS open FROM stopping WHERE NOT over),
goals AS (SELECT skey, source_size, CASE WHEN over THEN most ELSE rest.free * weight / rest.open END AS target FROM stopping LEFT JOIN rest ON true),
floors AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, {MOST_COPIES}) ELSE 0 END AS whole FROM goals),
cut0 AS (SELECT skey, 0::BIGINT AS head, target - whole * source_size AS budget, 0::BIGINT AS last FROM floors),{",".join(map(_level_sql, range(LEVELS)))}
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM (SELECT *, least({MOST_COPIES}, whole + CASE WHEN prefix < head OR (prefix = head AND last > 0 AND budget * 2 >= last) THEN 1 ELSE 0 END)::INT AS copies
  FROM base JOIN floors USING (skey) JOIN cut{LEVELS} USING (skey))""",
}
