"""The query views over facts, documents, evidence and relationships. Plain DataFrames in and out; nothing is collected.

Tables: ``documents`` (id, filename, status, page_count, created_at), ``facts`` (fact_id, document_id, subject, predicate, raw_value,
normalized_value, unit, time_data, scope, confidence, is_flagged, created_at), ``evidence`` (fact_id, evidence_id, evidence_text, page_number, ...),
``edges`` (id, fact_a_id, fact_b_id, relationship_type, confidence, ...). The documents table is joined without a hint: Spark
broadcasts it while its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.normalize import dataset


def with_dataset(documents: DataFrame) -> DataFrame:
    return documents.withColumn("dataset", dataset(F.col("filename")))


def of_dataset(df: DataFrame, documents: DataFrame, name: str | None, key: str = "document_id") -> DataFrame:
    """Rows whose document is in the dataset; all for None or ``all``."""
    if name in (None, "all"):
        return df
    ids = with_dataset(documents).where(F.col("dataset") == name).select(F.col("id").alias(key))
    return df.join(ids, key, "left_semi")


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


# Documents.
def list_documents(documents: DataFrame, facts: DataFrame, name: str | None = None) -> DataFrame:
    """Documents with dataset and fact_count."""
    counts = facts.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("fact_count"))
    out = with_dataset(documents)
    out = out if name in (None, "all") else out.where(F.col("dataset") == name)
    return out.join(counts, "id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0)))


def document(documents: DataFrame, facts: DataFrame, document_id: str) -> DataFrame:
    return list_documents(documents.where(F.col("id") == document_id), facts.where(F.col("document_id") == document_id))


def document_status(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stage and progress of each document's job; without a job, what its status tells."""
    done = F.col("status") == "completed"
    j = jobs.select(F.col("document_id").alias("id"), F.col("stage").alias("_stage"), F.col("progress").alias("_progress"))
    return documents.join(j, "id", "left").select(
        "id", "status", F.coalesce("_stage", F.when(done, "COMPLETE").otherwise("PROCESSING")).alias("stage"), F.coalesce("_progress", F.when(done, 100).otherwise(50)).alias("progress")
    )


def document_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages in order, each with its blocks in order as an array."""
    b = blocks.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_type", "text"))).alias("blocks"))
    return pages.join(b, ["document_id", "page_number"], "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(b.schema["blocks"].dataType)))


def with_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with all their evidence as an array, in the order of its ids."""
    e = evidence.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "evidence_text", "page_number"))).alias("evidence"))
    return facts.join(e, "fact_id", "left")


# Facts.
def search_facts(facts: DataFrame, documents: DataFrame | None = None, name: str | None = None, document_id: str | None = None, entity: str | None = None, predicate: str | None = None, is_flagged: bool | None = None, search: str | None = None) -> DataFrame:
    """Facts that meet every filter given. Texts match anywhere, in any case; % and _ in them are wildcards."""
    out = facts if documents is None else of_dataset(facts, documents, name)
    if document_id is not None:
        out = out.where(F.col("document_id") == document_id)
    if entity:
        out = out.where(F.col("subject").ilike(f"%{entity}%"))
    if predicate:
        out = out.where(F.col("predicate").ilike(f"%{predicate}%"))
    if is_flagged is not None:
        out = out.where(F.col("is_flagged") == is_flagged)
    if search:
        out = out.where(F.col("subject").ilike(f"%{search}%") | F.col("predicate").ilike(f"%{search}%") | F.col("raw_value").ilike(f"%{search}%"))
    return out


def fact_page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of facts, newest first, each with the number of all that were found."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be within 1 and 200, offset at least 0")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page(found, [F.col("created_at").desc(), F.col("fact_id")], limit, offset).crossJoin(F.broadcast(total))  # one row


def degrees(edges: DataFrame) -> DataFrame:
    """fact_id, relationship_count: how often a fact is an endpoint; an edge to itself counts twice."""
    ends = edges.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id"))
    return ends.groupBy("fact_id").agg(F.count(F.lit(1)).alias("relationship_count"))


def hydrated(facts: DataFrame, documents: DataFrame, evidence: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Facts with filename (Unknown without a document), dataset, first evidence and relationship_count where these are given."""
    d = with_dataset(documents).select(F.col("id").alias("document_id"), "filename", "dataset")
    out = facts.join(d, "document_id", "left").withColumns({"filename": F.coalesce("filename", F.lit("Unknown")), "dataset": F.coalesce("dataset", F.lit(V.DEFAULT_DATASET))})
    if evidence is not None:
        first = evidence.groupBy("fact_id").agg(F.min_by(F.struct("evidence_text", "page_number"), "evidence_id").alias("first_evidence"))
        out = out.join(first, "fact_id", "left")
    if edges is not None:
        out = out.join(degrees(edges), "fact_id", "left").withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))
    return out


def neighbours(edges: DataFrame, facts: DataFrame, documents: DataFrame, fact_id: str) -> DataFrame:
    """Edges of one fact with the fact at the other end, null where it is missing."""
    own = edges.where((F.col("fact_a_id") == fact_id) | (F.col("fact_b_id") == fact_id)).withColumn("other_id", F.when(F.col("fact_a_id") == fact_id, F.col("fact_b_id")).otherwise(F.col("fact_a_id")))
    f = hydrated(facts, documents).select(F.col("fact_id").alias("other_id"), F.col("subject").alias("other_subject"), F.col("raw_value").alias("other_value"), F.col("filename").alias("other_filename"))
    return own.join(f, "other_id", "left")


# Relationships.
_ENDS = ("subject", "predicate", "raw_value", "filename", "dataset")


def hydrated_edges(edges: DataFrame, facts: DataFrame, documents: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with both facts; ``inner`` drops edges that miss one, ``left`` keeps them."""
    f = hydrated(facts, documents)
    out = edges
    for x in "ab":
        out = out.join(f.select(F.col("fact_id").alias(f"fact_{x}_id"), *[F.col(c).alias(f"{x}_{c}") for c in _ENDS]), f"fact_{x}_id", how)
    return out


def relationships(edges: DataFrame, facts: DataFrame, documents: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Hydrated edges of a type (ALL for any), kept in a dataset if either end is in it."""
    picked = edges if kind is None or kind.upper() == "ALL" else edges.where(F.col("relationship_type") == kind.upper())
    out = hydrated_edges(picked, facts, documents)
    return out if name in (None, "all") else out.where((F.col("a_dataset") == name) | (F.col("b_dataset") == name))


def conflicts(edges: DataFrame, facts: DataFrame, documents: DataFrame, name: str | None = None) -> DataFrame:
    """Contradicting pairs and flagged facts in one table: kind, id, left, right."""
    pairs = relationships(edges, facts, documents, "CONTRADICTS", name).select(F.lit("contradiction").alias("kind"), F.col("id"), F.col("a_raw_value").alias("left_value"), F.col("b_raw_value").alias("right_value"))
    flagged = of_dataset(facts.where("is_flagged"), documents, name).select(F.lit("flagged").alias("kind"), F.col("fact_id").alias("id"), F.col("raw_value").alias("left_value"), F.lit(None).cast("string").alias("right_value"))
    return pairs.unionByName(flagged)


# Overview.
def overview_stats(documents: DataFrame, facts: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """One row: documents, facts, edges and each type of edge. Without a dataset, edges that miss an endpoint count as well."""
    if name in (None, "all"):
        d, f, e = documents, facts, edges
    else:
        d, f = with_dataset(documents).where(F.col("dataset") == name), of_dataset(facts, documents, name)
        e = relationships(edges, facts, documents, None, name)
    n = F.count(F.lit(1))
    types = [F.count_if(F.col("relationship_type") == t).alias(c) for t, c in (("CORROBORATES", "corroborations"), ("CONTRADICTS", "contradictions"), ("CONTEXTUAL_DIFFERENCE", "contextual"))]
    return d.agg(n.alias("documents")).crossJoin(f.agg(n.alias("facts"))).crossJoin(e.agg(n.alias("relationships"), *types))  # one row each


def resolution_breakdown(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))


def dataset_counts(documents: DataFrame) -> DataFrame:
    """Documents of every dataset of the list, and of all; datasets without documents have 0."""
    counts = with_dataset(documents).rollup("dataset").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("dataset", F.lit("all")).alias("dataset"), "n")
    listed = documents.sparkSession.createDataFrame([(a, b) for a, b, _ in V.DATASETS], "dataset string, name string")
    return listed.join(counts, "dataset", "left").select("dataset", "name", F.coalesce("n", F.lit(0)).alias("documents"))


def recent_documents(documents: DataFrame, facts: DataFrame, n: int = 6) -> DataFrame:
    return page(list_documents(documents, facts), [F.col("created_at").desc(), F.col("id")], n)


def recent_relationships(edges: DataFrame, facts: DataFrame, documents: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` edges by id, hydrated; those that miss an endpoint are left out."""
    return hydrated_edges(page(edges, [F.col("id")], n), facts, documents)


def showcase(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """The first edge of each type and the first flagged fact, by id: kind, id."""
    first = edges.groupBy(F.col("relationship_type").alias("kind")).agg(F.min("id").alias("id"))
    return first.unionByName(facts.where("is_flagged").agg(F.min("fact_id").alias("id")).select(F.lit("FLAGGED").alias("kind"), "id").where("id is not null"))


def percent(n: Column, total: Column) -> Column:
    """Whole percent, halves up; a total of 0 counts as 1."""
    return F.floor(100 * n / F.greatest(total, F.lit(1)) + 0.5).cast("long")


def percent_split(edges: DataFrame) -> DataFrame:
    counts = resolution_breakdown(edges)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("relationship_type", "n", percent(F.col("n"), F.col("total")).alias("percent"))  # one row


def filter_facts(hydrated_facts: DataFrame, predicate: str = "ALL", status: str = "ALL", search: str = "") -> DataFrame:
    """Filters of the fact table: predicate, HIGH_CONF or FLAGGED, and text in subject, predicate, value or file name."""
    out = hydrated_facts
    if predicate != "ALL":
        out = out.where(F.col("predicate") == predicate)
    if status == "HIGH_CONF":
        out = out.where(F.col("confidence") >= 0.90)
    elif status == "FLAGGED":
        out = out.where(F.col("is_flagged") | (F.col("confidence") < 0.70))
    return _containing(out, search, ("subject", "predicate", "raw_value", "filename"))


def filter_relationships(edges: DataFrame, kind: str = "ALL", search: str = "") -> DataFrame:
    out = edges if kind == "ALL" else edges.where(F.col("relationship_type") == kind)
    return _containing(out, search, ("a_subject", "a_predicate", "a_raw_value", "b_raw_value", "explanation"))


def filter_documents(documents: DataFrame, search: str = "") -> DataFrame:
    return _containing(documents, search, ("filename",))


def _containing(df: DataFrame, search: str, columns: tuple[str, ...]) -> DataFrame:
    if not search:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False))
    return df.where(hit)


def distinct_predicates(facts: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` predicates by their first appearance."""
    first = facts.groupBy("predicate").agg(F.min(F.struct("created_at", "fact_id")).alias("_o"))
    return page(first, [F.col("_o")], n).select("predicate")


def stage_latency(jobs: DataFrame) -> DataFrame:
    """stage, seconds and width of its bar in percent (a second and a half fills it, 8 at least); null where no time is known."""
    return jobs.withColumn("bar", F.when(F.col("seconds") > 0, F.greatest(F.lit(8.0), F.least(F.lit(100.0), F.col("seconds") / 1.5 * 100))))


def ingestion_summary(documents: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts of each document, all facts, and edges of each type: item, n."""
    per_doc = list_documents(documents, facts).select(F.concat(F.lit("document:"), "filename").alias("item"), F.col("fact_count").alias("n"))
    types = edges.rollup("relationship_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("relationships:"), F.coalesce("relationship_type", F.lit("all"))).alias("item"), "n")
    return per_doc.unionByName(facts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("facts").alias("item"), "n")).unionByName(types)


def health(spark, model: str = "none") -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit("factweave").alias("service"), F.lit(model).alias("model"))


# Exports.
FACT_COLUMNS = ("subject", "predicate", "raw_value", "normalized_value", "unit", "time_period", "scope", "confidence", "filename", "page")
EDGE_COLUMNS = ("relationship_type", "confidence", "a_subject", "a_predicate", "a_raw_value", "a_filename", "b_raw_value", "b_filename", "explanation")


def facts_export(hydrated_facts: DataFrame) -> DataFrame:
    """The ten columns of the fact export: confidence as whole percent, page 1 where no evidence names one."""
    number = F.col("first_evidence.page_number") if "first_evidence" in hydrated_facts.columns else F.lit(None).cast("int")
    return hydrated_facts.select(
        "subject", "predicate", "raw_value", F.coalesce(F.col("normalized_value").cast("string"), F.lit("")).alias("normalized_value"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("time_data.label", F.lit("")).alias("time_period"),
        F.coalesce("scope", F.lit("")).alias("scope"), F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%")).alias("confidence"), "filename", F.coalesce(number, F.lit(1)).alias("page"),
    )


def edges_export(edges: DataFrame) -> DataFrame:
    return edges.withColumn("confidence", F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%"))).select(*EDGE_COLUMNS)


def csv_line(*columns: Column) -> Column:
    """A line of CSV: every value quoted, quotes doubled, null as empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def overview_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))
