"""Registered queries against their SQL, the views' small rules, and streaming against batch."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factweave.plans import fixtures, queries, views
from factweave.streaming import ingest, jobs
from factweave.streaming.ingest import StageTimer, Store, distinct_stream, ingest_batch, ingest_stream, job_state, new_documents, status_counts, unprocessed

SAMPLE = ["candidate_pairs_top8", "candidate_pairs_varied", "relationships_varied", "undecided_varied", "judged_pairs", "overview_json", "document_facts", "tier1_pairs", "hydrated_facts", "overview_stats", "dataset_counts", "block_types", "density_top15", "normalize_number", "table_unpivot", "overlap_antijoin", "feature_hashes", "facts_csv"]


def _norm(v):
    return repr(round(float(v), 6)) if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"create view {t.split('.')[0]} as select * from '{small}/{t}'")
    df = queries.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(queries.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want and got


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_view_rules(spark):
    f = spark.createDataFrame([("f1", "d1", "Acme", True), ("f2", "gone", "Acme", False)], "fact_id string, document_id string, subject string, is_flagged boolean")
    d = spark.createDataFrame([("d1", "imf.pdf")], "id string, filename string")
    e = spark.createDataFrame([("f1", "f1"), ("f1", "f2")], "fact_a_id string, fact_b_id string")
    assert {r.fact_id: r.relationship_count for r in views.degrees(e).collect()} == {"f1": 3, "f2": 1}
    assert {r.fact_id: r.filename for r in views.hydrated(f, d).collect()} == {"f1": "imf.pdf", "f2": "Unknown"}
    with pytest.raises(ValueError):
        views.fact_page(f, 0)
    line = spark.createDataFrame([('a "q"', None)], "x string, y string").select(views.csv_line(F.col("x"), F.col("y"))).first()[0]
    assert line == '"a ""q""",""'
    j = spark.createDataFrame([("x", 0.0), ("y", 0.01), ("z", 9.0)], "stage string, seconds double")
    assert [r.bar for r in views.stage_latency(j).orderBy("stage").collect()] == [None, 8.0, 100.0]


def test_new_documents(spark):
    a = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h2")], "id int, file_hash string")
    known = spark.createDataFrame([("h1", "failed"), ("h2", "completed")], "file_hash string, status string")
    assert [r.id for r in new_documents(a, known).collect()] == [1]
    assert a.select(job_state(F.lit("COMPLETED")), job_state(F.lit("none"))).first()[:] == (100, None)
    found = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "filename string")
    docs = spark.createDataFrame([("1", "a.pdf", "completed"), ("2", "b.pdf", "completed"), ("3", "c.pdf", "failed")], "id string, filename string, status string")
    assert {r.filename for r in unprocessed(found, docs, spark.createDataFrame([("1",), ("1",), ("3",)], "document_id string")).collect()} == {"b.pdf", "c.pdf"}
    timer = StageTimer("1")
    with timer.stage("LAYOUT_EXTRACTION"):
        pass
    assert [(r.stage, r.progress) for r in timer.table(spark).collect()] == [("LAYOUT_EXTRACTION", 20)]


def test_stream_equals_batch(spark, small, tmp_path):
    """Documents that arrive one file at a time give the relationships of the whole, and a batch run again changes nothing."""
    c = fixtures.claims(spark, small).where("subject in ('BUILDING', 'MACHINERY')")
    want = {(r.fact_a_id, r.fact_b_id) for r in queries.R.resolve(c).collect()}
    for seq in (1, 2, 3, 4, 5):
        c.where(F.col("ingest_seq") == seq).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{seq}"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "in" / "*"))
    ingest_stream(stream, store, lambda df: df, str(tmp_path / "check")).awaitTermination()
    got = {(r.fact_a_id, r.fact_b_id) for r in store.read("edges").collect()}
    assert got == want
    last = len(store._batches("facts")) - 1
    again = store.spark.read.parquet(store._batches("facts")[-1])
    ingest_batch(store, spark.createDataFrame(again.collect(), again.schema), last)
    assert {(r.fact_a_id, r.fact_b_id) for r in store.read("edges").collect()} == want


def test_indexed_batches_equal_one_run(spark, small, tmp_path, monkeypatch):
    """Batches paired by the stored index, with compactions between, names that hold each other and a predicate that becomes crowded."""
    monkeypatch.setattr(ingest, "COMPACT_EVERY", 2)
    facts = fixtures.varied_claims(spark, small).where("fact_id <> 'f1'").cache()
    seqs = sorted(r[0] for r in facts.select("ingest_seq").distinct().collect())
    parts = [seqs[:2], seqs[2:3], seqs[3:4], seqs[4:]]
    store = Store(spark, str(tmp_path / "store"))
    for n, own in enumerate(parts):
        for _ in range(2 if n == 3 else 1):  # a batch that is run again
            ingest_batch(store, facts.where(F.col("ingest_seq").isin(own)), n, crowded=4)
    rows = lambda df: sorted((r.fact_a_id, r.fact_b_id, r.relationship_type, r.confidence) for r in df.collect())
    assert rows(store.read("edges")) == rows(queries.R.resolve(facts))
    assert store.read("facts").count() == facts.count()
    assert [p.rsplit("/", 1)[1] for p in store._batches("signatures")] == ["c=000000001", "b=000000002", "b=000000003"]
    assert store.read("signatures").groupBy("sig").count().where("count > 1").isEmpty() and store.read("names").groupBy("kind", "name", "gram").count().where("count > 1").isEmpty()


def test_compaction_survives_failures(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("t") is None
    for n in range(4):
        store.write(spark.range(n, n + 1), "t", n)
    store.compact("t", 2)
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 3] and sorted(r.id for r in store.read("t", 3).collect()) == [0, 1, 2]
    (tmp_path / "s" / "t" / "c=000000003").mkdir()  # begun, but without its mark
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 3]
    store.write(spark.range(1), "t", 1)  # left over from before
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 3]
    store.compact("t", 3, lambda x: x.where("id <> 2"))
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 3] and len(store._batches("t")) == 1


def test_job_states(spark, tmp_path):
    """Events out of order within the delay, in three batches, over restarts: completed, failed, stalled by a timer; late, unknown and keyless events are ignored; open jobs stay open."""
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    files = [
        [("a", 0, "QUEUED"), ("a", 8, "FACT_EXTRACTION"), ("b", 3, "QUEUED"), ("c", 1, "nonsense"), (None, 2, "QUEUED"), ("d", 0, "LAYOUT_EXTRACTION")],
        [("a", 12, "COMPLETED"), ("a", 5, "LAYOUT_EXTRACTION"), ("b", 20, "FAILED"), ("b", 20, "CANDIDATE_DETECTION"), ("e", 300, "QUEUED")],
        [("a", 1, "FAILED"), ("e", 301, "COMPLETED"), ("e", 301, "QUEUED"), ("a", 340, "QUEUED"), ("f", 400, "QUEUED")],
    ]
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(k, minute(m), s) for k, m, s in rows], "key string, at string, stage string").select("key", F.to_timestamp("at").alias("ts"), "stage")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*"))
        spark.conf.set(*jobs.STATE_STORE)
        try:
            out = jobs.job_outcomes(source, "10 minutes", 60 * 60_000)
            out.writeStream.option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.unset(jobs.STATE_STORE[0])
    got = spark.read.parquet(str(tmp_path / "out")).select("key", "job", "status", "stage", "progress", "events", F.date_format("ended_at", "H:mm").alias("at"), "stalled").collect()
    assert {tuple(r) for r in got} == {("a", 1, "COMPLETED", "COMPLETED", 100, 4, "0:12", False), ("b", 1, "FAILED", "FAILED", 40, 3, "0:20", False), ("d", 1, "FAILED", "LAYOUT_EXTRACTION", 20, 1, "1:00", True), ("e", 1, "COMPLETED", "COMPLETED", 100, 3, "5:01", False)}


def test_job_steps():
    job, n, done = jobs.advance(None, 0, [(100, "QUEUED"), (50, "FACT_EXTRACTION"), (2000, "LAYOUT_EXTRACTION")], 2500, 1000)
    assert (job, n) == (("LAYOUT_EXTRACTION", 20, 2000, 2000, 1), 1) and done == [(1, "FAILED", "QUEUED", 60, 2, 50, 1100, True)]
    assert jobs.advance(job, n, [], 3001, 1000) == (None, 2, [(2, "FAILED", "LAYOUT_EXTRACTION", 20, 1, 2000, 3000, True)])
    assert jobs.advance(None, 5, [], 10**9, 1) == (None, 5, [])


def test_job_state_is_read_and_written_once():
    """A step of a key costs one read and one write of its state, however many events it holds: each is a trip to the JVM."""
    from types import SimpleNamespace

    calls, held = [], []
    value = SimpleNamespace(exists=lambda: calls.append("exists") or bool(held), get=lambda: calls.append("get") or (held[-1] if held else None), update=lambda x: calls.append("update") or held.append(x))
    states = jobs.JobStates(1000)
    states.init(SimpleNamespace(getValueState=lambda *a: value, registerTimer=lambda at: calls.append(f"timer {at}")))
    assert list(states._step(("a",), [(100, "QUEUED"), (50, "FACT_EXTRACTION")], 0)) == [] and calls == ["get", "update", "timer 51"]
    calls.clear()
    (out,) = states._step(("a",), [(2000, "COMPLETED")], 5000)
    assert calls == ["get", "update"] and out[["key", "job", "stage", "started", "ended", "stalled"]].values.tolist() == [["a", 1, "QUEUED", 50, 1100, True], ["a", 2, "COMPLETED", 2000, 2000, False]]


def test_stream_helpers(spark, tmp_path):
    spark.createDataFrame([("h", "QUEUED"), ("h", "QUEUED"), ("g", "DONE")], "file_hash string, stage string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("file_hash string, stage string, ts timestamp").parquet(str(tmp_path / "in"))
    q = distinct_stream(s).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
    assert {r.stage: r.n for r in status_counts(spark.read.parquet(str(tmp_path / "in"))).collect()} == {"QUEUED": 2, "DONE": 1}


def test_evidence_fuzzy_reads_every_line(spark, tmp_path):
    """A quote that only the ninth line holds."""
    text = "\n".join(["alpha", *(f"filler line number {i}" for i in range(7)), "here zzz zzz stands"])
    spark.createDataFrame([(2, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.quote_id, r.status, r.score) for r in queries.QUERIES["evidence_fuzzy"](spark, str(tmp_path)).collect()] == [(2, "grounded", 0.95)]


def test_chunks_of_the_provider_are_made_once(spark):
    """What asks and claims read is a written table, not the scoring of all blocks."""
    from factweave.plans import queries

    chunks = queries._chunk_batches(spark, "/root/testdata/sf0.001")
    assert chunks.count() > 0 and all("/factweave/chunks-" in f for f in chunks.inputFiles())
