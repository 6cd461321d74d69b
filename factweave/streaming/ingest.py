"""Ingestion of arriving documents: deduplicated by content, resolved batch by batch, with job states."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from .. import vocabulary as V
from ..operators import pairs
from ..operators.resolve import resolve_pairs
from ..session import estimated_bytes, written


def new_documents(arrived: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Arrived documents whose content isn't among the completed ones; of equal contents the smallest key stays."""
    done = known.where("status = 'completed'").select("file_hash")
    fresh = arrived.join(done, "file_hash", "left_anti")
    packed = fresh.groupBy("file_hash").agg(F.min_by(F.struct("*"), key).alias("r"))
    return packed.select("r.*")


def unprocessed(found: DataFrame, documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Files (column filename) of a folder that still have to be read: those without a completed document that has facts."""
    done = documents.where("status = 'completed'").join(facts.select(F.col("document_id").alias("id")), "id", "left_semi").select("filename")
    return found.join(done, "filename", "left_anti")


class StageTimer:
    """Seconds of each stage of a document's ingestion, as rows of a job table."""

    def __init__(self, document_id: str):
        self.document_id, self.seconds = document_id, {}

    @contextmanager
    def stage(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = round(self.seconds.get(name, 0.0) + time.monotonic() - began, 3)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.document_id, k, v, schemas.STAGES.get(k)) for k, v in self.seconds.items()]
        return spark.createDataFrame(rows, "document_id string, stage string, seconds double, progress int")


def accepted(filename: Column) -> Column:
    """Whether an upload is of a kind that is read."""
    return F.lower(filename).endswith(".pdf")


def job_state(stage: Column) -> Column:
    """Progress of a stage in percent."""
    out = F.lit(None).cast("int")
    for name, progress in schemas.STAGES.items():
        out = F.when(stage == name, F.lit(progress)).otherwise(out)
    return out


def distinct_stream(documents: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream of documents without repeated contents within the watermark; state older than the delay is dropped."""
    return documents.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["file_hash"])


class Store:
    """Tables as Parquet folders, one a batch, and compacted ones that stand for all batches up to theirs.

    A batch writes to the folder of its own number and replaces it, so a batch that is run again after a failure leaves
    the same tables. :meth:`compact` writes a new folder first and deletes what it stands for after; readers take the newest
    whole compacted folder and the batches after it, so a failure at any time loses and repeats nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _found(self, name: str) -> tuple[object, dict[tuple[str, int], str]]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return fs, {(p.getName()[0], int(p.getName()[2:])): p for p in paths if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}

    def _batches(self, name: str, before: int | None = None) -> list[str]:
        _, found = self._found(name)
        whole = max((n for kind, n in found if kind == "c" and (before is None or n < before)), default=-1)
        later = sorted(n for kind, n in found if kind == "b" and n > whole and (before is None or n < before))
        return [found[k].toString() for k in [("c", whole)] * (whole >= 0) + [("b", n) for n in later]]

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        paths = self._batches(name, before)
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.path}/{name}/b={batch:09d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def compact(self, name: str, upto: int, reduce: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
        """One folder for all batches up to ``upto``, which no batch may be running; ``reduce`` may leave out rows that no reader needs."""
        table = self.read(name, upto + 1)
        if table is None or len(self._batches(name, upto + 1)) < 2:
            return
        reduce(table).write.mode("overwrite").parquet(f"{self.path}/{name}/c={upto:09d}")
        fs, found = self._found(name)
        for (kind, n), path in found.items():
            if n < upto or (kind, n) == ("b", upto):
                fs.delete(path, True)


#: Batches between compactions, and bytes up to which a batch's own rows are broadcast to the stored ones.
COMPACT_EVERY, BATCH_BYTES = 8, 16 << 20


class PairIndex:
    """The stored side of incremental pairing: signatures, the facts of each that can be candidates, and the grams of names.

    Each table gets the new rows of a batch only. A batch's own rows are broadcast (while they are few), so stored rows are
    scanned, but neither embedded nor shuffled again; only stored rows that a batch's keys hit are moved. Predicates
    that have become crowded are rank-joined, for which the signatures of these predicates are moved.
    """

    def __init__(self, store: Store, k: int = V.MOST_PAIRS, crowded: int = pairs.CROWDED):
        self.store, self.k, self.crowded = store, k, crowded

    def _all(self, name: str, batch: int, new: DataFrame) -> DataFrame:
        """The table with this batch's rows, which replace those of an earlier run of the batch."""
        before = self.store.read(name, batch)
        new = self.store.write(new, name, batch)
        return new if before is None else before.unionByName(new)

    def candidates(self, fresh: DataFrame, batch: int) -> DataFrame:
        """target, candidate, score, rank: as ``pairs.candidate_pairs`` of all facts so far, for those of the batch."""
        t = pairs.brief(fresh)
        own = pairs.signatures(t)
        hint = F.broadcast if estimated_bytes(t) <= BATCH_BYTES and estimated_bytes(own) <= BATCH_BYTES else (lambda x: x)

        def met(stored: DataFrame | None, keys: DataFrame, on: list[str]) -> DataFrame | None:
            """Stored rows with a key of the batch."""
            return None if stored is None else stored.join(hint(keys.select(*on).distinct()), on, "left_semi")

        known = met(self.store.read("signatures", batch), own, ["sig"])
        every = self._all("signatures", batch, own if known is None else own.join(known, "sig", "left_anti"))
        facts, before = t.select("sig", "fact_id", "document_id", "ingest_seq"), self.store.read("firsts", batch)
        at_hand = met(before, own, ["sig"])
        if at_hand is None:
            new = pairs.first_facts(facts, self.k)
        else:
            among = pairs.first_facts(facts.withColumn("_new", F.lit(True)).unionByName(at_hand.withColumn("_new", F.lit(False))), self.k)
            new = among.where("_new").drop("_new")
        firsts = self._all("firsts", batch, new)
        names = own.select(F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("s").alias("name")), F.struct(F.lit("p").alias("kind"), F.col("p").alias("name")))).alias("x")).select("x.*").distinct()
        stored = self.store.read("names", batch)
        unknown = names if stored is None else names.join(met(stored.where("gram = ''"), names, ["kind", "name"]), ["kind", "name"], "left_anti")
        kinds = unknown.select("kind", F.col("name").alias("k_name")).distinct()
        grams = pairs.with_grams(unknown.select("name").distinct())
        every_name = self._all("names", batch, grams.join(kinds, grams.name == kinds.k_name).select("kind", "name", "gram"))

        def links(column: str) -> DataFrame:
            mine = written(names.where(F.col("kind") == column).select("name"), "names")
            outer = every_name.where(F.col("kind") == column).drop("kind")
            lead = mine.select(F.col("name").alias("x"), F.substring("name", 1, pairs.LEAD).alias("gram"))
            held = hint(lead).join(outer.withColumnRenamed("name", "y"), "gram").where("x <> y and contains(y, x)")
            own_grams = pairs.with_grams(mine).select(F.col("name").alias("x"), "gram")
            holding = hint(own_grams).join(outer.where("gram = ''").select(F.col("name").alias("y"), F.substring("name", 1, pairs.LEAD).alias("gram")), "gram").where("x <> y and contains(x, y)")
            return held.select("x", "y").union(holding.select("x", "y"))

        crowd = pairs.crowded_predicates(met(every, own, ["p"]), self.crowded)
        most = None if crowd.isEmpty() else written(crowd, "crowded")
        linked = written(pairs.signature_pairs(own, every, most, links, hint), "pairs")
        wanted = pairs.first_facts(met(firsts, linked.select(F.col("b").alias("sig")), ["sig"]) if most is None else firsts, self.k)
        return pairs.ranked_pairs(t, own, every, wanted, linked, most, self.k, True)

    def compact(self, upto: int) -> None:
        self.store.compact("signatures", upto)
        self.store.compact("names", upto)
        self.store.compact("firsts", upto, lambda x: pairs.first_facts(x, self.k))


def ingest_batch(store: Store, facts: DataFrame, batch: int, judge=None, crowded: int = pairs.CROWDED) -> None:
    """Store a batch of facts and their relationships with facts of documents ingested before.

    ``ingest_seq`` orders the documents; a batch's documents also see each other in that order. Every COMPACT_EVERY batches the
    tables of the batches before the last are compacted.
    """
    fresh = store.write(facts, "facts", batch)
    before, edges, index = store.read("facts", batch), store.read("edges", batch), PairIndex(store, crowded=crowded)
    found = written(index.candidates(fresh, batch), "candidates")
    hint = F.broadcast if estimated_bytes(found) <= BATCH_BYTES else (lambda x: x)
    if edges is not None:
        keys = found.select(F.least("target", "candidate").alias("low"), F.greatest("target", "candidate").alias("high"))
        low, high = F.least("fact_a_id", "fact_b_id"), F.greatest("fact_a_id", "fact_b_id")
        edges = edges.withColumns({"low": low, "high": high}).join(hint(keys), ["low", "high"], "left_semi")
    once = pairs.dedup_pairs(found, edges)
    ids = found.select(F.explode(F.array("target", "candidate")).alias("fact_id")).distinct()
    pool = fresh if before is None else fresh.unionByName(before)
    store.write(resolve_pairs(once, written(pool.join(hint(ids), "fact_id", "left_semi"), "sides"), judge), "edges", batch)
    if batch and batch % COMPACT_EVERY == 0:
        index.compact(batch - 1)
        for name in ("facts", "edges"):
            store.compact(name, batch - 1)


def ingest_stream(stream: DataFrame, store: Store, to_facts: Callable[[DataFrame], DataFrame], checkpoint: str, judge=None, once: bool = True) -> StreamingQuery:
    """Run ``ingest_batch`` over a stream of documents; ``once`` works off what has arrived and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ingest_batch(store, to_facts(df), n, judge))
    return (writer.trigger(availableNow=True) if once else writer).start()


def status_counts(jobs: DataFrame, event_time: str = "ts", window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Jobs by stage and window of time, for a stream or a table."""
    source = jobs.withWatermark(event_time, delay) if jobs.isStreaming else jobs
    return source.groupBy(F.window(event_time, window).alias("w"), "stage").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "stage", "n")
