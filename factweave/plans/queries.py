"""The registered queries: each applies an operator to whole tables of the driver, with the same result in SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from .. import vocabulary as V
from ..functions import normalize as N
from ..functions.embed import feature_hash, nearest
from ..functions.text import block_type, clean, is_boilerplate, page_quality
from ..operators import blocks as B
from ..operators import extract as X
from ..operators import ground as G
from ..operators import pairs as P
from ..operators import resolve as R
from ..session import spread, written
from . import fixtures as X0
from . import views as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _hash_sql(text: str) -> str:
    """Feature-hash vector of a text in SQL."""
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\\w\\s]', '', 'g'), '\\s+'), lambda x: x <> '')"
    return f"""
    SELECT *, list_transform(raw, lambda x: CASE WHEN norm > 1e-9 THEN round(x / norm, 5) ELSE 0.0 END) AS emb FROM (
      SELECT *, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS norm FROM (
        SELECT *, list_transform(range(128), lambda i: list_sum(list_transform(hs, lambda h: CASE WHEN h % 128 = i THEN CASE WHEN (h >> 8) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE 0.0::DOUBLE END))) AS raw FROM (
          SELECT *, list_transform(toks, lambda t: list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295::BIGINT)) AS hs FROM (
            SELECT *, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || '_' || words[i + 1])) AS toks FROM (SELECT *, {words} AS words FROM source_rows)))))"""


PAIRS_SQL = f"""{X0.CLAIMS_SQL},
source_rows AS (SELECT DISTINCT subject FROM claims),
emb AS ({_hash_sql("subject || ' revenue global'")}),
sims AS (SELECT a.subject AS sa, b.subject AS sb, greatest(-1.0, least(1.0, list_dot_product(a.emb, b.emb))) AS cos FROM emb a, emb b),
scored AS (SELECT a.fact_id AS target, b.fact_id AS candidate, b.ingest_seq AS c_seq, a.ingest_seq AS t_seq,
    CASE WHEN a.subject = b.subject THEN 0.45::DOUBLE ELSE 0.0 END + 0.35::DOUBLE + CASE WHEN cos > 0 THEN cos * 0.2::DOUBLE ELSE 0.0 END AS score
  FROM claims a JOIN claims b ON a.document_id <> b.document_id JOIN sims ON sa = a.subject AND sb = b.subject),
pairs AS (SELECT target, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, c_seq, candidate) AS rank FROM scored WHERE c_seq < t_seq AND score >= 0.35) WHERE rank <= 8),
batch AS (SELECT target, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, c_seq, candidate) AS rank FROM scored WHERE score >= 0.35) WHERE rank <= 8),
edges AS (SELECT sha256(target || '|' || candidate)[1:32] AS id, target AS fact_a_id, candidate AS fact_b_id,
    CASE WHEN a.time_label <> b.time_label THEN 'CONTEXTUAL_DIFFERENCE' WHEN gap <= 0.01 THEN 'CORROBORATES' ELSE 'CONTRADICTS' END AS relationship_type,
    CASE WHEN a.time_label <> b.time_label THEN 0.96 WHEN gap <= 0.01 THEN 0.98 ELSE 0.94 END AS confidence, a.raw_value AS a_raw, b.raw_value AS b_raw, a.subject AS a_subject, a.time_label AS a_time, b.time_label AS b_time
  FROM pairs JOIN claims a ON a.fact_id = target JOIN claims b ON b.fact_id = candidate,
    LATERAL (SELECT abs(a.normalized_value - b.normalized_value) / greatest(abs(a.normalized_value), abs(b.normalized_value), 1e-9) AS gap) WHERE a.subject = b.subject)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve(X0.claims(spark, sf_dir))


# Pairing and resolution.
@query(f"WITH {PAIRS_SQL} SELECT target, candidate, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM pairs")
def candidate_pairs_top8(spark, d):
    c = X0.claims(spark, d)
    return P.candidate_pairs(c, c).select("target", "candidate", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {PAIRS_SQL} SELECT target, candidate, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM batch")
def candidate_pairs_batch(spark, d):
    c = X0.claims(spark, d)
    return P.candidate_pairs(c, c, incremental=False).select("target", "candidate", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {PAIRS_SQL} SELECT least(target, candidate) AS low, greatest(target, candidate) AS high, CAST(min(rank) AS INT) AS rank FROM batch GROUP BY 1, 2")
def pair_dedup(spark, d):
    c = X0.claims(spark, d)
    return P.dedup_pairs(P.candidate_pairs(c, c, incremental=False)).select(F.least("target", "candidate").alias("low"), F.greatest("target", "candidate").alias("high"), "rank")


@query(f"WITH {PAIRS_SQL} SELECT relationship_type, count(*) AS n FROM edges GROUP BY 1")
def resolution_breakdown(spark, d):
    return Q.resolution_breakdown(_edges(spark, d))


@query(f"""WITH {PAIRS_SQL} SELECT fact_a_id, fact_b_id, relationship_type, confidence, 'deterministic' AS resolution_tier,
  CASE relationship_type WHEN 'CONTEXTUAL_DIFFERENCE' THEN 'entity,predicate,time' ELSE 'entity,predicate,time,scope,value' END AS dimensions,
  CASE relationship_type WHEN 'CORROBORATES' THEN 'Both independent sources assert the same revenue of ' || a_raw || ' for ' || a_subject || ' with matching context.'
    WHEN 'CONTRADICTS' THEN 'Direct conflict: Source A reports ' || a_raw || ' while Source B reports ' || b_raw || ' for the same entity (' || a_subject || ') and identical period (' || a_time || ').'
    ELSE 'The values refer to different reporting periods (Claim A specifies ''' || a_time || ''' while Claim B specifies ''' || b_time || '''), so the difference does not constitute a contradiction.' END AS explanation FROM edges""")
def tier1_pairs(spark, d):
    return _edges(spark, d).select("fact_a_id", "fact_b_id", "relationship_type", "confidence", "resolution_tier", F.array_join("supporting_dimensions", ",").alias("dimensions"), "explanation")


_VARIANTS_SQL = f"""WITH {X0.CLAIMS_SQL}, v AS (SELECT *, CASE y % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'US subsidiary' ELSE NULL END AS sc, CASE WHEN y % 2 = 0 THEN 'USD' ELSE 'EUR' END AS un, CASE WHEN y % 5 = 0 THEN NULL ELSE normalized_value END AS nv FROM claims)
SELECT a.fact_id AS a_id, b.fact_id AS b_id, CASE WHEN lower(coalesce(a.sc, 'global')) <> lower(coalesce(b.sc, 'global')) THEN 'CONTEXTUAL_DIFFERENCE'
  WHEN a.nv IS NOT NULL AND b.nv IS NOT NULL AND a.un = b.un THEN CASE WHEN abs(a.nv - b.nv) / greatest(abs(a.nv), abs(b.nv), 1e-9) <= 0.01 THEN 'CORROBORATES' ELSE 'CONTRADICTS' END
  WHEN lower(a.raw_value) = lower(b.raw_value) THEN 'CORROBORATES' ELSE 'UNDECIDED' END AS relationship_type
FROM v a JOIN v b ON a.subject = b.subject AND a.document_id = b.document_id AND a.fact_id < b.fact_id"""


@query(_VARIANTS_SQL)
def tier1_scope_unit_text(spark, d):
    """The cascade over pairs without period, with varied scopes, units and missing numbers."""
    c = X0.claims(spark, d)
    y = F.substring("time_data.label", 3, 4).cast("int")
    none = F.lit(None).cast("string")
    v = c.withColumns({"scope": F.when(y % 3 == 0, "global").when(y % 3 == 1, "US subsidiary"), "unit": F.when(y % 2 == 0, "USD").otherwise("EUR"), "normalized_value": F.when(y % 5 != 0, F.col("normalized_value")), "time_data": F.struct(none.alias("label"))})
    ids = v.select("subject", "document_id", "fact_id")
    same = ids.withColumnRenamed("fact_id", "target").join(ids.withColumnRenamed("fact_id", "candidate"), ["subject", "document_id"]).where("target < candidate").select("target", "candidate")
    return R.tier1(R.with_sides(same, v)).select("a_id", "b_id", F.coalesce("r.relationship_type", F.lit("UNDECIDED")).alias("relationship_type"))


# All pairs of facts, scored, ranked and classified one by one.
_VARIED_SQL = f"""{X0.VARIED_SQL},
source_rows AS (SELECT DISTINCT subject, predicate, scope FROM varied),
emb AS ({_hash_sql("subject || ' ' || predicate || ' ' || coalesce(scope, '')")}),
facts AS (SELECT varied.*, emb FROM varied JOIN emb ON emb.subject = varied.subject AND emb.predicate = varied.predicate AND emb.scope IS NOT DISTINCT FROM varied.scope),
scored AS (SELECT a.fact_id AS target, b.fact_id AS candidate, b.ingest_seq AS c_seq, list_dot_product(a.emb, b.emb) AS cos,
    CASE WHEN a.s = b.s THEN 0.45::DOUBLE WHEN contains(b.s, a.s) OR contains(a.s, b.s) THEN 0.30::DOUBLE ELSE 0.0 END
    + CASE WHEN a.p = b.p THEN CASE WHEN a.p IN ({str(V.MACRO_METRICS)[1:-1]}) THEN 0.35::DOUBLE + 0.25::DOUBLE ELSE 0.35::DOUBLE END WHEN contains(b.p, a.p) OR contains(a.p, b.p) THEN 0.20::DOUBLE ELSE 0.0 END
    + CASE WHEN cos > 0 THEN least(1.0, cos) * 0.2::DOUBLE ELSE 0.0 END AS score
  FROM facts a JOIN facts b ON b.ingest_seq < a.ingest_seq),
pairs AS (SELECT target, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, c_seq, candidate) AS rank FROM scored WHERE score >= 0.35) WHERE rank <= 8),
views AS (SELECT *, upper(trim(coalesce(time_label, ''))) AS t, lower(coalesce(scope, 'global')) AS c, coalesce(unit, '') AS u, {" OR ".join(f"contains(s, '{x}')" for x in V.MACRO_INSTITUTIONS)} AS official FROM varied),
sided AS (SELECT target, candidate, a.p = b.p AND (contains(a.s, b.s) OR contains(b.s, a.s) OR (a.p IN ({str(V.MACRO_METRICS)[1:-1]}) AND a.official AND b.official)) AS comparable,
    a.t <> '' AND b.t <> '' AND a.t <> b.t AS other_time, a.c <> b.c AND 'unspecified' NOT IN (a.c, b.c) AS other_scope, lower(a.raw_value) = lower(b.raw_value) AS same_text,
    a.normalized_value IS NOT NULL AND b.normalized_value IS NOT NULL AND (a.u = b.u OR '' IN (a.u, b.u)) AS numeric_pair, abs(a.normalized_value - b.normalized_value) / greatest(abs(a.normalized_value), abs(b.normalized_value), 1e-9) AS gap
  FROM pairs JOIN views a ON a.fact_id = target JOIN views b ON b.fact_id = candidate),
outcome AS (SELECT target, candidate, CASE WHEN NOT comparable THEN NULL WHEN other_time OR other_scope THEN 'CONTEXTUAL_DIFFERENCE' WHEN numeric_pair THEN CASE WHEN gap <= 0.01 THEN 'CORROBORATES' ELSE 'CONTRADICTS' END WHEN same_text THEN 'CORROBORATES' END AS relationship_type,
    CASE WHEN other_time THEN 0.96 WHEN other_scope THEN 0.95 WHEN numeric_pair THEN CASE WHEN gap <= 0.01 THEN 0.98 ELSE 0.94 END ELSE 0.97 END AS confidence FROM sided)"""


@query(f"WITH {_VARIED_SQL} SELECT target, candidate, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM pairs")
def candidate_pairs_varied(spark, d):
    """Pairs by every branch of the score, over facts that grow with the tables."""
    c = X0.varied_claims(spark, d)
    return P.candidate_pairs(c, c).select("target", "candidate", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {_VARIED_SQL} SELECT target AS fact_a_id, candidate AS fact_b_id, relationship_type, CAST(confidence AS DOUBLE) AS confidence FROM outcome WHERE relationship_type IS NOT NULL")
def relationships_varied(spark, d):
    """The cascade over these pairs: institutions, periods, scopes, units, numbers and texts."""
    return R.resolve(X0.varied_claims(spark, d)).select("fact_a_id", "fact_b_id", "relationship_type", "confidence")


@query(f"WITH {_VARIED_SQL} SELECT target AS a_id, candidate AS b_id FROM outcome WHERE relationship_type IS NULL")
def undecided_varied(spark, d):
    """What is left for a judge."""
    c = X0.varied_claims(spark, d)
    return R.tier1(R.with_sides(P.candidate_pairs(c, c), c)).where("r is null").select("a_id", "b_id")


@query(f"""WITH {X0.CROWDED_SQL},
source_rows AS (SELECT DISTINCT subject, predicate, scope FROM crowded),
emb AS ({_hash_sql("subject || ' ' || predicate || ' ' || coalesce(scope, '')")}),
facts AS (SELECT crowded.*, emb, list_filter(range(1, 129), lambda i: emb[i] <> 0) AS nz FROM crowded JOIN emb ON emb.subject = crowded.subject AND emb.scope IS NOT DISTINCT FROM crowded.scope),
scored AS (SELECT a.fact_id AS target, b.fact_id AS candidate, b.ingest_seq AS c_seq, list_reduce(list_prepend(0.0::DOUBLE, list_transform(a.nz, lambda i: a.emb[i] * b.emb[i])), lambda t, y: t + y) AS cos,
    CASE WHEN a.s = b.s THEN 0.45::DOUBLE WHEN contains(b.s, a.s) OR contains(a.s, b.s) THEN 0.30::DOUBLE ELSE 0.0 END + 0.35::DOUBLE + CASE WHEN cos > 0 THEN least(1.0, cos) * 0.2::DOUBLE ELSE 0.0 END AS score
  FROM facts a JOIN facts b ON b.ingest_seq < a.ingest_seq)
SELECT target, candidate, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, c_seq, candidate) AS rank FROM scored) WHERE rank <= 8""")
def candidate_pairs_crowded(spark, d):
    """Pairs of one predicate that all facts share: the rank join, whose crowd starts here at 64 signatures."""
    c = X0.crowded_claims(spark, d)
    return P.candidate_pairs(c, c, crowded=64).select("target", "candidate", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {X0.CLAIMS_SQL} SELECT fact_id, document_id, normalized_value FROM claims WHERE document_id NOT LIKE '1%' UNION ALL SELECT fact_id, document_id, normalized_value * 2 FROM claims WHERE document_id LIKE '1%'")
def replace_on_rerun(spark, d):
    c = X0.claims(spark, d).select("fact_id", "document_id", "normalized_value")
    fresh = c.where("document_id like '1%'").withColumn("normalized_value", F.col("normalized_value") * 2)
    return R.replace_document(c, fresh, fresh.select("document_id").distinct())


@query(f"WITH {PAIRS_SQL} SELECT fact_a_id, fact_b_id FROM edges WHERE fact_a_id NOT LIKE '%|3-%' AND fact_b_id NOT LIKE '%|3-%'")
def edges_after_rerun(spark, d):
    gone = X0.claims(spark, d).where("document_id like '3-%'").select("fact_id")
    return R.drop_edges(_edges(spark, d), gone).select("fact_a_id", "fact_b_id")


# Views over facts and relationships.
_BASE = f"{PAIRS_SQL}, {X0.DOCUMENTS_SQL.strip()}"


@query(f"WITH {_BASE} SELECT fact_id, count(*) AS relationship_count FROM (SELECT fact_a_id AS fact_id FROM edges UNION ALL SELECT fact_b_id FROM edges) GROUP BY 1")
def fact_degree(spark, d):
    return Q.degrees(_edges(spark, d))


@query(f"WITH {X0.CLAIMS_SQL} SELECT fact_id, subject, raw_value FROM claims WHERE subject ILIKE '%m%' AND predicate ILIKE '%REV%' AND NOT is_flagged AND (subject ILIKE '%a_h%' OR predicate ILIKE '%a_h%' OR raw_value ILIKE '%a_h%')")
def facts_search(spark, d):
    return Q.search_facts(X0.claims(spark, d), entity="m", predicate="REV", is_flagged=False, search="a_h").select("fact_id", "subject", "raw_value")


@query(f"WITH {X0.CLAIMS_SQL} SELECT fact_id, raw_value, (SELECT count(*) FROM claims) AS total FROM claims ORDER BY created_at DESC, fact_id LIMIT 20 OFFSET 10")
def facts_page(spark, d):
    return Q.fact_page(Q.search_facts(X0.claims(spark, d)), 20, 10).select("fact_id", "raw_value", "total")


@query(f"WITH {X0.CLAIMS_SQL}, {X0.DOCUMENTS_SQL.strip()} SELECT fact_id, dataset, filename FROM claims JOIN docs ON id = document_id WHERE dataset = 'india-macroeconomy'")
def facts_by_dataset(spark, d):
    docs = X0.claim_documents(spark, d)
    return Q.hydrated(Q.search_facts(X0.claims(spark, d), docs, "india-macroeconomy"), docs).select("fact_id", "dataset", "filename")


@query(f"""WITH {_BASE}, deg AS (SELECT fact_id, count(*) AS n FROM (SELECT fact_a_id AS fact_id FROM edges UNION ALL SELECT fact_b_id FROM edges) GROUP BY 1)
SELECT c.fact_id, coalesce(filename, 'Unknown') AS filename, coalesce(n, 0) AS relationship_count, subject || ' ' || raw_value AS first_quote FROM claims c LEFT JOIN docs ON id = document_id LEFT JOIN deg USING (fact_id)""")
def hydrated_facts(spark, d):
    c = X0.claims(spark, d)
    return Q.hydrated(c, X0.claim_documents(spark, d), _evidence(c), _edges(spark, d)).select("fact_id", "filename", "relationship_count", F.col("first_evidence.evidence_text").alias("first_quote"))


def _evidence(c: DataFrame) -> DataFrame:
    """Two pieces of evidence for each fact."""
    return c.select("fact_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "subject", "raw_value").select(
        "fact_id", F.concat("fact_id", F.lit("#"), "n").alias("evidence_id"), F.when(F.col("n") == 1, F.concat_ws(" ", "subject", "raw_value")).otherwise(F.col("raw_value")).alias("evidence_text"), F.col("n").alias("page_number")
    )


@query(f"WITH {_BASE} SELECT fact_id, raw_value, filename FROM claims JOIN docs ON id = document_id WHERE fact_id = (SELECT min(fact_id) FROM claims)")
def get_fact(spark, d):
    c = X0.claims(spark, d)
    least = c.agg(F.min("fact_id").alias("fact_id"))
    return Q.hydrated(c.join(least, "fact_id", "left_semi"), X0.claim_documents(spark, d)).select("fact_id", "raw_value", "filename")


@query(f"WITH {_BASE} SELECT CASE WHEN fact_a_id = 'BUILDING|2-HIGH|1995' THEN fact_b_id ELSE fact_a_id END AS other_id, relationship_type, c.subject AS other_subject, c.raw_value AS other_value FROM edges LEFT JOIN claims c ON c.fact_id = CASE WHEN fact_a_id = 'BUILDING|2-HIGH|1995' THEN fact_b_id ELSE fact_a_id END WHERE 'BUILDING|2-HIGH|1995' IN (fact_a_id, fact_b_id)")
def fact_neighbours(spark, d):
    return Q.neighbours(_edges(spark, d), X0.claims(spark, d), X0.claim_documents(spark, d), "BUILDING|2-HIGH|1995").select("other_id", "relationship_type", "other_subject", "other_value")


@query(f"WITH {X0.CLAIMS_SQL} SELECT fact_id, subject || ' ' || raw_value || '|' || raw_value AS quotes FROM claims WHERE document_id = '2-HIGH'")
def document_facts(spark, d):
    """A document's facts with all their evidence."""
    c = X0.claims(spark, d)
    own = Q.with_evidence(Q.search_facts(c, document_id="2-HIGH"), _evidence(c))
    return own.select("fact_id", F.array_join(F.transform("evidence", lambda x: x["evidence_text"]), "|").alias("quotes"))


_EDGE_VIEW = "FROM edges e JOIN claims a ON a.fact_id = fact_a_id JOIN claims b ON b.fact_id = fact_b_id JOIN docs da ON da.id = a.document_id JOIN docs db ON db.id = b.document_id"


@query(f"WITH {_BASE} SELECT e.id, relationship_type, a.subject AS a_subject, da.filename AS a_filename, db.filename AS b_filename {_EDGE_VIEW} WHERE da.dataset = 'delhivery' OR db.dataset = 'delhivery'")
def hydrated_relationships(spark, d):
    return Q.relationships(_edges(spark, d), X0.claims(spark, d), X0.claim_documents(spark, d), "all", "delhivery").select("id", "relationship_type", "a_subject", "a_filename", "b_filename")


@query(f"WITH {_BASE} SELECT e.id, a.raw_value AS a_raw_value, b.raw_value AS b_raw_value {_EDGE_VIEW} WHERE e.id = (SELECT min(id) FROM edges)")
def get_relationship(spark, d):
    e = _edges(spark, d)
    one = e.join(e.agg(F.min("id").alias("id")), "id", "left_semi")
    return Q.hydrated_edges(one, X0.claims(spark, d), X0.claim_documents(spark, d), "left").select("id", "a_raw_value", "b_raw_value")


@query(f"WITH {_BASE} SELECT 'contradiction' AS kind, e.id AS id, a.raw_value AS left_value, b.raw_value AS right_value {_EDGE_VIEW} WHERE relationship_type = 'CONTRADICTS' UNION ALL SELECT 'flagged', fact_id, raw_value, NULL FROM claims WHERE is_flagged")
def conflicts(spark, d):
    return Q.conflicts(_edges(spark, d), X0.claims(spark, d), X0.claim_documents(spark, d))


@query(f"WITH {_BASE} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM claims) AS facts, count(*) AS relationships, count(*) FILTER (relationship_type = 'CORROBORATES') AS corroborations, count(*) FILTER (relationship_type = 'CONTRADICTS') AS contradictions, count(*) FILTER (relationship_type = 'CONTEXTUAL_DIFFERENCE') AS contextual FROM edges")
def overview_stats(spark, d):
    return Q.overview_stats(X0.claim_documents(spark, d), X0.claims(spark, d), _edges(spark, d))


@query(f"WITH {_BASE} SELECT (SELECT count(*) FROM docs WHERE dataset = 'synthetic') AS documents, (SELECT count(*) FROM claims JOIN docs ON id = document_id WHERE dataset = 'synthetic') AS facts, count(*) AS relationships, count(*) FILTER (relationship_type = 'CORROBORATES') AS corroborations, count(*) FILTER (relationship_type = 'CONTRADICTS') AS contradictions, count(*) FILTER (relationship_type = 'CONTEXTUAL_DIFFERENCE') AS contextual {_EDGE_VIEW} WHERE da.dataset = 'synthetic' OR db.dataset = 'synthetic'")
def overview_of_dataset(spark, d):
    return Q.overview_stats(X0.claim_documents(spark, d), X0.claims(spark, d), _edges(spark, d), "synthetic")


@query(f"WITH {X0.DOCUMENTS_SQL.strip()}, sets AS (SELECT * FROM (VALUES ('all'), ('delhivery'), ('india-macroeconomy'), ('synthetic')) AS t(dataset)) SELECT sets.dataset, CASE WHEN sets.dataset = 'all' THEN (SELECT count(*) FROM docs) ELSE (SELECT count(*) FROM docs WHERE docs.dataset = sets.dataset) END AS documents FROM sets")
def dataset_counts(spark, d):
    return Q.dataset_counts(X0.claim_documents(spark, d)).select("dataset", "documents")


@query(f"WITH {X0.CLAIMS_SQL}, {X0.DOCUMENTS_SQL.strip()} SELECT id, filename, dataset, (SELECT count(*) FROM claims WHERE document_id = id) AS fact_count FROM docs")
def list_documents(spark, d):
    return Q.list_documents(X0.claim_documents(spark, d), X0.claims(spark, d)).select("id", "filename", "dataset", "fact_count")


@query(f"WITH {X0.CLAIMS_SQL}, {X0.DOCUMENTS_SQL.strip()} SELECT id, filename, (SELECT count(*) FROM claims WHERE document_id = id) AS fact_count FROM docs WHERE id = '2-HIGH'")
def get_document(spark, d):
    return Q.document(X0.claim_documents(spark, d), X0.claims(spark, d), "2-HIGH").select("id", "filename", "fact_count")


@query(f"WITH {X0.CLAIMS_SQL}, {X0.DOCUMENTS_SQL.strip()} SELECT id, (SELECT count(*) FROM claims WHERE document_id = id) AS fact_count FROM docs ORDER BY created_at DESC, id LIMIT 6")
def recent_documents(spark, d):
    return Q.recent_documents(X0.claim_documents(spark, d), X0.claims(spark, d)).select("id", "fact_count")


@query(f"WITH {_BASE} SELECT id, relationship_type FROM edges ORDER BY id LIMIT 8")
def recent_relationships(spark, d):
    return Q.recent_relationships(_edges(spark, d), X0.claims(spark, d), X0.claim_documents(spark, d)).select("id", "relationship_type")


@query(f"WITH {_BASE} SELECT relationship_type AS kind, min(id) AS id FROM edges GROUP BY 1 UNION ALL SELECT 'FLAGGED', min(fact_id) FROM claims WHERE is_flagged")
def showcase(spark, d):
    return Q.showcase(_edges(spark, d), X0.claims(spark, d))


@query(f"WITH {_BASE} SELECT relationship_type, count(*) AS n, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM edges) + 0.5) AS BIGINT) AS percent FROM edges GROUP BY 1")
def percent_split(spark, d):
    return Q.percent_split(_edges(spark, d))


@query(f"WITH {X0.CLAIMS_SQL}, {X0.DOCUMENTS_SQL.strip()} SELECT fact_id FROM claims JOIN docs ON id = document_id WHERE predicate = 'revenue' AND (is_flagged OR confidence < 0.70) AND (contains(lower(subject), 'rbi') OR contains(lower(raw_value), 'rbi') OR contains(lower(filename), 'rbi'))")
def client_fact_filter(spark, d):
    return Q.filter_facts(Q.hydrated(X0.claims(spark, d), X0.claim_documents(spark, d)), "revenue", "FLAGGED", "RBI").select("fact_id")


@query(f"WITH {X0.CLAIMS_SQL} SELECT fact_id FROM claims WHERE confidence >= 0.90")
def high_confidence_facts(spark, d):
    return Q.filter_facts(Q.hydrated(X0.claims(spark, d), X0.claim_documents(spark, d)), status="HIGH_CONF").select("fact_id")


@query(f"WITH {_BASE} SELECT e.id {_EDGE_VIEW} WHERE relationship_type = 'CONTRADICTS' AND contains(lower(a.subject), 'mach')")
def client_relationship_filter(spark, d):
    return Q.filter_relationships(Q.relationships(_edges(spark, d), X0.claims(spark, d), X0.claim_documents(spark, d)), "CONTRADICTS", "mach").select("id")


@query(f"WITH {X0.DOCUMENTS_SQL.strip()} SELECT id FROM docs WHERE contains(lower(filename), 'imf')")
def client_document_filter(spark, d):
    return Q.filter_documents(X0.claim_documents(spark, d), "IMF").select("id")


@query("SELECT event_type AS predicate FROM events GROUP BY 1 ORDER BY min((ts, CAST(event_id AS VARCHAR))) LIMIT 4")
def distinct_predicates(spark, d):
    e = X0.table(spark, d, "events").select(F.col("event_type").alias("predicate"), F.col("ts").alias("created_at"), F.col("event_id").cast("string").alias("fact_id"))
    return Q.distinct_predicates(e)


@query(f"""WITH {_BASE} SELECT 'document:' || filename AS item, (SELECT count(*) FROM claims WHERE document_id = docs.id) AS n FROM docs UNION ALL SELECT 'facts', count(*) FROM claims
UNION ALL SELECT 'relationships:all', count(*) FROM edges UNION ALL SELECT 'relationships:' || relationship_type, count(*) FROM edges GROUP BY relationship_type""")
def ingestion_summary(spark, d):
    return Q.ingestion_summary(X0.claim_documents(spark, d), X0.claims(spark, d), _edges(spark, d))


@query("SELECT 'ok' AS status, 'factweave' AS service")
def health(spark, d):
    return Q.health(spark).select("status", "service")


@query(f"WITH {X0.CLAIMS_SQL}, {X0.DOCUMENTS_SQL.strip()} SELECT '\"' || subject || '\",\"' || predicate || '\",\"' || raw_value || '\",\"' || time_label || '\",\"' || CAST(floor(confidence * 100 + 0.5) AS INT) || '%\",\"' || filename || '\",\"1\"' AS line FROM claims JOIN docs ON id = document_id")
def facts_csv(spark, d):
    e = Q.facts_export(Q.hydrated(X0.claims(spark, d), X0.claim_documents(spark, d)))
    return e.select(Q.csv_line(*[F.col(c) for c in ("subject", "predicate", "raw_value", "time_period", "confidence", "filename", "page")]).alias("line"))


@query(f"WITH {_BASE} SELECT '\"' || relationship_type || '\",\"' || CAST(floor(e.confidence * 100 + 0.5) AS INT) || '%\",\"' || a.subject || '\",\"' || da.filename || '\"' AS line {_EDGE_VIEW}")
def relationships_csv(spark, d):
    e = Q.edges_export(Q.relationships(_edges(spark, d), X0.claims(spark, d), X0.claim_documents(spark, d)))
    return e.select(Q.csv_line(*[F.col(c) for c in ("relationship_type", "confidence", "a_subject", "a_filename")]).alias("line"))


@query("SELECT '{' || chr(10) || " + " || ',' || chr(10) || ".join(f"'  \"{k}\" : ' || {k}" for k in ("documents", "facts", "relationships", "corroborations", "contradictions", "contextual")) + f" || chr(10) || '}}' AS json FROM ({SQL['overview_stats']})")
def overview_json(spark, d):
    return Q.overview_json(overview_stats(spark, d))


# Jobs.
def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = X0.table(spark, d, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("document_id")).agg(F.max_by(F.col("event_type"), F.struct("ts", "event_id")).alias("stage"), F.count(F.lit(1)).cast("int").alias("progress"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(stage, CASE WHEN c_custkey % 2 = 0 THEN 'COMPLETE' ELSE 'PROCESSING' END) AS stage, coalesce(progress, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 50 END) AS progress FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, CAST(count(*) AS INT) AS progress FROM events GROUP BY 1) ON user_id = c_custkey")
def document_status(spark, d):
    docs = X0.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "completed").otherwise("processing").alias("status"))
    return Q.document_status(docs, _jobs(spark, d)).select("id", "stage", "progress")


@query("SELECT event_type AS stage, round(sum(CAST(round(value * 1000) AS BIGINT)) / 1000.0, 3) AS seconds, count(*) AS n FROM events GROUP BY 1")
def stage_timings(spark, d):
    e = X0.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum(F.round(F.col("value") * 1000).cast("long")) / 1000.0, 3).alias("seconds"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(greatest(8.0, least(100.0, value / 1.5 * 100)), 4) END AS bar FROM events")
def stage_latency(spark, d):
    e = X0.table(spark, d, "events").withColumn("seconds", F.col("value"))
    return Q.stage_latency(e).select("event_id", F.round("bar", 4).alias("bar"))


# Text operators.
@query("""WITH q AS (SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS n, len(regexp_extract_all(text, '[a-zA-Z0-9\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}.,;:$\\-–—%()/"''#@&+=*<>\\[\\]]')) AS ok FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 1.0 WHEN n < 35 THEN 0.8 WHEN 1.0 - ok / n > 0.35 THEN round(greatest(0.1, 1.0 - (1.0 - ok / n)), 6) ELSE round(greatest(0.6, least(1.0, 1.0 - (1.0 - ok / n))), 2) END AS score, n >= 35 AND 1.0 - ok / n > 0.35 AS is_poor FROM q""")
def page_quality_scores(spark, d):
    t = spread(X0.table(spark, d, "documents")).select("doc_id", page_quality(F.col("text"), F.lit(612.0), F.lit(792.0), F.lit(False)).alias("q"))
    return t.select("doc_id", F.when(F.col("q.is_poor"), F.round("q.score", 6)).otherwise(F.col("q.score")).alias("score"), "q.is_poor")


@query("SELECT quality, toxic, count(*) AS n, count(*) FILTER (len(regexp_extract_all(text, '[a-zA-Z0-9\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}.,;:$\\-–—%()/\"''#@&+=*<>\\[\\]]')) >= 0.65 * length(text)) AS readable FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def quality_labelled(spark, d):
    t = X0.table(spark, d, "documents").join(X0.table(spark, d, "labels"), "doc_id")
    ok = F.regexp_count("text", F.lit(f"(?U){V.READABLE}")) >= 0.65 * F.char_length("text")
    return t.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("readable"))


@query(f"WITH {X0.LINES_SQL.strip()} SELECT document_id, block_index, block_type FROM blocks")
def block_types(spark, d):
    return X0.line_blocks(spark, d).select("document_id", "block_index", "block_type")


@query(f"WITH {X0.LINES_SQL.strip()} SELECT document_id, block_index, last_value(CASE WHEN block_type = 'heading' THEN t END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS heading_context FROM blocks")
def heading_context(spark, d):
    return B.with_heading_context(X0.line_blocks(spark, d)).select("document_id", "block_index", "heading_context")


@query(f"WITH {X0.LINES_SQL.strip()} SELECT document_id, count(*) AS blocks, sum(length(t)) AS chars FROM blocks GROUP BY 1")
def document_pages(spark, d):
    b = X0.line_blocks(spark, d)
    pages = b.select("document_id", "page_number").distinct()
    nested = Q.document_pages(pages, b)
    return nested.select("document_id", F.size("blocks").cast("long").alias("blocks"), F.aggregate("blocks", F.lit(0).cast("long"), lambda n, x: n + F.char_length(F.regexp_replace(x["text"], r"(?U)^\s+|\s+$", ""))).alias("chars"))


@query(f"WITH {X0.LINES_SQL.strip()} SELECT document_id, block_index FROM blocks WHERE regexp_matches(text, '(?i)all rights reserved|confidential|printed on|page [0-9]+ of [0-9]+|this page intentionally left blank|table of contents|contents page|forward-looking statements|safe harbor|statutory auditors|independent auditor''s report|cin:|isin:')")
def boilerplate_filter(spark, d):
    return X0.line_blocks(spark, d).where(is_boilerplate(F.col("text"))).select("document_id", "block_index")


# Sentences of orders have ASCII words only, where the boundaries of SQL's patterns agree.
_DENSITY_SQL = """points AS (SELECT *, CAST(CASE WHEN contains(lower(text), 'all rights reserved') THEN -10.0 ELSE round(3.5 * len(regexp_extract_all(text, '(?i)\\b(?:revenue|turnover|net income|operating income|sales|ebitda|profit|loss|assets|debt|cash|expenses|margin|dividend)\\b'))
  + 2.5 * len(regexp_extract_all(text, '(?i)(?:\\$|€|£|₹|USD|EUR|GBP|INR|crore|crores|lakh|lakhs|million|millions|billion|billions|trillion)\\b'))
  + 3.0 * len(regexp_extract_all(text, '(?i)\\b(?:employees|headcount|customers|subscribers|shipments|volume|express parcel|centers|pincodes|coverage|clients|network)\\b'))
  + least(6.0, 2.0 * len(regexp_extract_all(text, '(?i)\\b(?:FY\\s*[0-9]{2,4}|Q[1-4]\\s*[0-9]{2,4}|\\b(?:19|20)[0-9]{2}\\b|as of|ended|quarter|fiscal)\\b')))
  + least(4.0, 0.5 * len(regexp_extract_all(text, '(?i)\\b[0-9]+(?:[.,][0-9]+)?\\s*(?:%|percent|cr|mn|bn)?\\b'))), 2) END AS DOUBLE) AS score FROM sentences WHERE block_type <> 'heading')"""


@query(f"WITH {X0.TEXT_SQL.strip()}, {_DENSITY_SQL} SELECT document_id, block_index, score FROM points")
def density_score(spark, d):
    return B.scored_blocks(X0.claim_text(spark, d)).select("document_id", "block_index", "score")


@query(f"WITH {X0.TEXT_SQL.strip()}, {_DENSITY_SQL} SELECT document_id, block_index, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page_number, block_index) AS rank FROM points WHERE score >= 6.0) WHERE rank <= 15")
def density_top15(spark, d):
    return B.top_candidates(X0.claim_text(spark, d)).select("document_id", "block_index", "score", "rank")


_SIGNALS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{name}' END" for name, p, _, _ in V.DENSITY_SIGNALS) + ")"
_CHUNKS_SQL = f"""headed AS (SELECT *, last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS heading_context FROM sentences),
{_DENSITY_SQL.replace("FROM sentences", "FROM headed")},
chunks AS (SELECT *, 'chunk_' || block_index AS chunk_id, (rank - 1) // 5 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page_number, block_index) AS rank FROM points WHERE score >= 6.0) WHERE rank <= 15)"""


@query(f"WITH {X0.TEXT_SQL.strip()}, {_CHUNKS_SQL} SELECT chunk_id, heading_context, text, {_SIGNALS_SQL} AS signals FROM chunks")
def candidate_chunks(spark, d):
    return B.candidate_chunks(X0.claim_text(spark, d)).select("chunk_id", "heading_context", "text", F.array_join("signals", ",").alias("signals"))


@query("WITH raw AS (SELECT doc_id, regexp_replace(lower(text), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g') AS t FROM documents) SELECT doc_id, sha256(trim(regexp_replace(t, '[^\\p{L}\\p{N}\\p{M}\\p{Pc} ]', '', 'g'), ' ')) AS digest FROM raw")
def comparison_text(spark, d):
    return spread(X0.table(spark, d, "documents")).select("doc_id", F.sha2(clean(F.col("text")), 256).alias("digest"))


@query(f"""WITH {X0.BOXES_SQL.strip()}, tabs AS (SELECT * FROM boxes WHERE is_table) SELECT page_id, box_id FROM boxes b WHERE NOT is_table AND NOT EXISTS (SELECT 1 FROM tabs t WHERE t.page_id = b.page_id
  AND greatest(0.0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0.0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / greatest(1.0, (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.65)""")
def overlap_antijoin(spark, d):
    r = X0.rectangles(spark, d)
    return B.drop_table_overlaps(r.where("not is_table"), r.where("is_table"), ["page_id"]).select("page_id", "box_id")


@query(f"WITH {X0.BOXES_SQL.strip()} SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY is_table DESC, box_id) - 1 AS INT) AS block_index FROM boxes")
def block_numbers(spark, d):
    r = X0.rectangles(spark, d).withColumn("text", F.col("box_id").cast("string"))
    return B.number_blocks(r.where("is_table"), r.where("not is_table"), ["page_id"], "box_id").select("page_id", "box_id", "block_index")


# Normalisers.
@query(f"""WITH {X0.STRINGS_SQL.strip()} SELECT key, CASE key % 7 WHEN 0 THEN w WHEN 1 THEN w * 1000000.0 WHEN 2 THEN -w WHEN 3 THEN -w WHEN 4 THEN w * 1000.0 WHEN 5 THEN w * 10000000.0 END AS value,
  CASE key % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 3 THEN 'employees' WHEN 4 THEN 'EUR' END AS unit, CASE key % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 4 THEN 'EUR' END AS currency
FROM (SELECT key, amount, CAST(nullif(regexp_extract(amount, '[0-9]+'), '') AS DOUBLE) AS w FROM strings)""")
def normalize_number(spark, d):
    return X0.parsed_strings(spark, d).select("key", "n.value", "n.unit", "n.currency")


@query(f"WITH {X0.STRINGS_SQL.strip()} SELECT key, CASE WHEN contains(amount, '$') OR contains(amount, 'USD') THEN 'USD' WHEN contains(amount, '€') THEN 'EUR' END AS currency FROM strings")
def normalize_currency(spark, d):
    return X0.strings(spark, d).select("key", N.currency(F.col("amount")).alias("currency"))


@query(f"""WITH {X0.STRINGS_SQL.strip()} SELECT key, period AS label, CASE key % 5 WHEN 0 THEN 'fiscal_year' WHEN 1 THEN 'year' WHEN 2 THEN 'quarter' WHEN 3 THEN 'point_in_time' ELSE 'unspecified' END AS precision,
  CASE WHEN key % 5 = 1 THEN period || '-01-01' END AS start_day, CASE WHEN key % 5 = 1 THEN period || '-12-31' END AS end_day FROM strings""")
def normalize_time(spark, d):
    return X0.parsed_strings(spark, d).select("key", "t.label", "t.precision", F.col("t.start").alias("start_day"), F.col("t.end").alias("end_day"))


@query(f"WITH {X0.STRINGS_SQL.strip()} SELECT key, CASE name WHEN 'Acme Corp.' THEN 'Acme Corporation' WHEN 'Beta Limited' THEN 'Beta Ltd.' WHEN 'The RBI bulletin' THEN 'Reserve Bank of India' ELSE name END AS entity FROM strings")
def normalize_entity(spark, d):
    return X0.strings(spark, d).select("key", N.entity(F.col("name")).alias("entity"))


@query(f"WITH {X0.STRINGS_SQL.strip()} SELECT key, CASE predicate WHEN 'Total Revenue' THEN 'revenue' WHEN 'net_sales' THEN 'net_revenue' WHEN 'Head-Office' THEN 'headquarters' WHEN 'gross sales' THEN 'gross_revenue' ELSE predicate END AS predicate FROM strings")
def normalize_predicate(spark, d):
    return X0.strings(spark, d).select("key", N.predicate(F.col("predicate")).alias("predicate"))


@query(f"""WITH {X0.STRINGS_SQL.strip()} SELECT key, CASE filename WHEN 'Delhivery-2022.pdf' THEN 'delhivery' WHEN 'other.pdf' THEN 'synthetic' ELSE 'india-macroeconomy' END AS dataset,
  CASE filename WHEN 'Delhivery-2022.pdf' THEN 'Delhivery Limited' WHEN 'rbi.pdf' THEN 'Reserve Bank of India' WHEN 'Economic-Survey.pdf' THEN 'Government of India' ELSE 'Acme Corporation' END AS subject FROM strings""")
def document_names(spark, d):
    return X0.strings(spark, d).select("key", N.dataset(F.col("filename")).alias("dataset"), N.document_subject(F.col("filename")).alias("subject"))


# Extraction.
@query(f"WITH {X0.CLAIMS_SQL} SELECT document_id, 'Total revenue ' || subject || ' (' || time_label || '): ' || v AS evidence_text, 'revenue' AS predicate, CAST(v AS DOUBLE) AS normalized_value, time_label FROM (SELECT *, CAST(CAST(floor(normalized_value) AS BIGINT) AS VARCHAR) AS v FROM claims)")
def table_unpivot(spark, d):
    return X.unpivot_tables(X0.table_blocks(spark, d)).select("document_id", "evidence_text", "predicate", "normalized_value", F.col("time_data.label").alias("time_label"))


_CALLOUT_SQL = "SELECT o_orderpriority AS document_id, CAST(o_orderkey AS VARCHAR) AS block_id, 'revenue' AS predicate, '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' million' AS raw_value, floor(o_totalprice) * 1000000.0 AS normalized_value, 'Q1 ' || year(o_orderdate) AS time_label FROM orders WHERE o_orderkey % 3 = 0"


@query(_CALLOUT_SQL)
def callout_pairs(spark, d):
    return X.callouts(X0.callout_blocks(spark, d)).select("document_id", "block_id", "predicate", "raw_value", "normalized_value", F.col("time_data.label").alias("time_label"))


@query(f"SELECT document_id, normalized_value, time_label, min(CAST(block_id AS BIGINT)) AS block_id FROM ({_CALLOUT_SQL}) GROUP BY 1, 2, 3")
def dedup_signature(spark, d):
    out = X.dedup_fast(X.callouts(X0.callout_blocks(spark, d)))
    return out.select("document_id", "normalized_value", F.col("time_data.label").alias("time_label"), F.col("block_id").cast("long").alias("block_id"))


@query("SELECT o_orderkey AS key, CAST(CASE status WHEN 'grounded' THEN greatest(0.85, least(0.99, base)) WHEN 'grounded_with_warning' THEN round(base * 0.85, 2) ELSE round(base * 0.30, 2) END AS DOUBLE) AS confidence FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'grounded' WHEN 1 THEN 'grounded_with_warning' ELSE 'unsupported' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 WHEN 2 THEN 1.0 ELSE 0.9 END AS base FROM orders)")
def confidence_adjustment(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, "grounded").when(k % 3 == 1, "grounded_with_warning").otherwise("unsupported")
    return X0.table(spark, d, "orders").select(k.alias("key"), X.adjusted_confidence(status, F.when(k % 4 == 0, 0.5).when(k % 4 == 1, 0.9).when(k % 4 == 2, 1.0)).alias("confidence"))


@query(f"WITH {X0.CLAIMS_SQL}, both_sides AS (SELECT document_id, subject, predicate, raw_value, normalized_value, time_label, 0 AS p FROM claims UNION ALL SELECT document_id, lower(subject), predicate, raw_value, CASE WHEN y % 2 = 0 THEN normalized_value ELSE normalized_value + 1 END, time_label, 1 FROM claims) SELECT document_id, subject, normalized_value, time_label FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(subject), predicate, normalized_value, time_label ORDER BY p, raw_value) AS r FROM both_sides) WHERE r = 1")
def merge_claims(spark, d):
    c = X0.claims(spark, d).withColumns({"page_number": F.lit(1), "block_id": F.col("fact_id")})
    y = F.substring("time_data.label", 3, 4).cast("int")
    other = c.withColumns({"subject": F.lower("subject"), "normalized_value": F.when(y % 2 == 0, F.col("normalized_value")).otherwise(F.col("normalized_value") + 1)})
    return X.merge_claims(c, other).select("document_id", "subject", "normalized_value", F.col("time_data.label").alias("time_label"))


# Grounding.
@query(f"WITH {X0.LINES_SQL.strip()}, cleaned AS (SELECT document_id, block_index, trim(regexp_replace(regexp_replace(lower(t), '[{X0._WS}]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}} ]', '', 'g'), ' ') AS q FROM blocks), firsts AS (SELECT document_id, q AS first_q FROM cleaned WHERE block_index = 0) SELECT document_id, block_index FROM cleaned JOIN firsts USING (document_id) WHERE first_q <> '' AND contains(q, first_q)")
def evidence_containment(spark, d):
    """Blocks that hold the document's first line."""
    b = X0.line_blocks(spark, d)
    first = b.where("block_index = 0").select("document_id", F.col("text").alias("quote"))
    return b.join(first, "document_id").where((clean(F.col("quote")) != "") & G.has_quote(F.col("text"), F.col("quote"))).select("document_id", "block_index")


@query()
def evidence_fuzzy(spark, d):
    """Grounding of quotes: the first line of each document with its first word left out or changed, cited to its second block."""
    b = X0.line_blocks(spark, d).withColumns({"id": F.concat_ws("_", "document_id", "block_index"), "bbox": F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))})
    pages = b.groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), "\n").alias("raw_text"), F.lit(612.0).alias("width"))
    k = F.col("document_id") % 3
    quotes = b.where("block_index = 0").select(F.col("document_id").alias("quote_id"), "document_id", "page_number", F.concat(F.col("document_id").cast("string"), F.lit("_1")).alias("block_id"), F.when(k == 0, F.col("text")).when(k == 1, F.regexp_replace("text", r"^\S+\s+", "")).otherwise(F.regexp_replace("text", r"^\S+", "zzz zzz")).alias("quote"))
    return G.ground(quotes, b, pages).select("quote_id", "status", "score")


# Vectors.
@query(f"WITH source_rows AS (SELECT p_partkey, p_name FROM part), emb AS ({_hash_sql('p_name')}) SELECT p_partkey, slot, v FROM (SELECT p_partkey, unnest(range(128)) AS slot, unnest(emb) AS v FROM emb) WHERE v <> 0")
def feature_hashes(spark, d):
    p = X0.table(spark, d, "part").select("p_partkey", F.posexplode(feature_hash(F.col("p_name"))).alias("slot", "v"))
    return p.where("v <> 0").select("p_partkey", F.col("slot").cast("long").alias("slot"), "v")


@query("SELECT query, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS vec_id, round(greatest(-1.0, least(1.0, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 5")
def cosine_topk(spark, d):
    """The nearest five of all vectors for every twentieth vector."""
    e = X0.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    s = nearest(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q")), e, 5)
    return s.select("query", "vec_id", "score", "rank")


# Ingestion.
@query("SELECT file_hash, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE doc_id % 2 = 0) WHERE file_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL) GROUP BY 1")
def ingest_dedup(spark, d):
    """Even documents arrive where the odd ones are completed: what is new, once for each content."""
    from ..streaming.ingest import new_documents

    t = X0.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return new_documents(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1").withColumn("status", F.lit("completed")), "doc_id").select("file_hash", "doc_id")


_STAGE_OF = {"signup": "QUEUED", "view": "LAYOUT_EXTRACTION", "click": "FACT_EXTRACTION", "purchase": "COMPLETED", "error": "FAILED"}
_STALL_HOURS = 18


@query(f"""WITH RECURSIVE base AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE_OF.items())} END AS stage FROM events),
due AS (SELECT *, upto, CASE stage {" ".join(f"WHEN '{k}' THEN {v + 1000 * (k in ('COMPLETED', 'FAILED')) + (k == 'FAILED')}" for k, v in schemas.STAGES.items())} END AS place, CASE stage {" ".join(f"WHEN '{k}' THEN {v}" for k, v in schemas.STAGES.items())} END AS progress
  FROM base, (SELECT max(ms) - 3600000 AS upto FROM base) WHERE stage IS NOT NULL AND user_id IS NOT NULL AND ms < upto),
placed AS (SELECT *, coalesce(lag(stage IN ('COMPLETED', 'FAILED')) OVER w OR ms > lag(ms) OVER w + {_STALL_HOURS * 3600000}, true) AS opens FROM due WINDOW w AS (PARTITION BY user_id ORDER BY ms, place)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ms, place ROWS UNBOUNDED PRECEDING) AS job FROM placed),
jobs AS (SELECT user_id, job, arg_max(stage, (ms, place)) AS stage, max(progress) AS progress, count(*) AS events, min(ms) AS started, max(ms) AS last, any_value(upto) AS upto FROM numbered GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS key, job::INT AS job, CASE stage WHEN 'COMPLETED' THEN stage ELSE 'FAILED' END AS status, stage, progress::INT AS progress, events::INT AS events, started AS started_ms,
  CASE WHEN stage IN ('COMPLETED', 'FAILED') THEN last ELSE last + {_STALL_HOURS * 3600000} END AS ended_ms, stage NOT IN ('COMPLETED', 'FAILED') AS stalled FROM jobs WHERE stage IN ('COMPLETED', 'FAILED') OR last + {_STALL_HOURS * 3600000} < upto""")
def job_outcomes(spark, d):
    """Jobs of each user's events as a stream: completed, failed, or stalled and failed by a timer."""
    from ..session import shared_folder
    from ..streaming import jobs

    at = f"{shared_folder(spark)}/factweave/jobs-{uuid.uuid4().hex}"
    before = spark.conf.get(jobs.STATE_STORE[0], None)
    spark.conf.set(*jobs.STATE_STORE)
    try:
        stage = F.create_map(*[F.lit(x) for kv in _STAGE_OF.items() for x in kv])[F.col("event_type")]
        events = spark.readStream.schema(X0.table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet")  # a pattern, since a stream's path may be no single file
        out = jobs.job_outcomes(events.select(F.col("user_id").alias("key"), F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))).alias("ts"), stage.alias("stage")), "1 hour", _STALL_HOURS * 3_600_000)
        out.writeStream.option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(jobs.STATE_STORE[0]) if before is None else spark.conf.set(jobs.STATE_STORE[0], before)
    done = spark.read.schema(jobs.OUTCOME).parquet(f"{at}/out")
    return done.select("key", "job", "status", "stage", "progress", "events", F.unix_millis("started_at").alias("started_ms"), F.unix_millis("ended_at").alias("ended_ms"), "stalled")


@query("SELECT page_id, sha256(html) AS file_hash, octet_length(encode(html)) AS file_size FROM pages")
def file_hashes(spark, d):
    from ..sources.readers import file_hash

    return X0.table(spark, d, "pages").select("page_id", file_hash(F.col("html").cast("binary")).alias("file_hash"), F.octet_length("html").cast("long").alias("file_size"))


@query()
def html_blocks(spark, d):
    """Blocks of pages, tables and all, by the HTML source."""
    from ..sources.readers import html_blocks as read

    return read(spread(X0.table(spark, d, "pages")), "page_id", "html").select("document_id", "block_index", "block_type", "text")


def _recorded(quote: str) -> str:
    return f'```json\n{{"facts": [{{"subject": "Acme Corp.", "predicate": "total revenue", "raw_value": "$1.2 billion", "scope": null, "time": "FY 2024", "evidence": {{"quote": "{quote}"}}, "confidence": 0.95}}]}}\n```'


def _chunk_batches(spark, d):
    """Written, since each asking and the claims read it: the blocks are scored once."""
    return written(X.batches(B.candidate_chunks(X0.claim_text(spark, d))), "chunks")


def _cache(spark):
    from ..session import shared_folder
    from ..sources.answer_cache import AnswerCache

    return AnswerCache(spark, f"{shared_folder(spark)}/factweave/cache-{uuid.uuid4().hex}")


@query(f"""WITH {X0.TEXT_SQL.strip()}, {_CHUNKS_SQL}, keyed AS (SELECT *, sha256(text || '|' || coalesce(heading_context, '') || '|') AS key, bool_or(contains(text || '|' || coalesce(heading_context, ''), '7 million')) OVER (PARTITION BY document_id, batch) AS answered FROM chunks)
SELECT key, CASE WHEN answered THEN 'batch' ELSE 'chunk' END AS asked_as, answered, run FROM keyed JOIN (VALUES ('first'), ('second')) r(run) ON CASE WHEN run = 'first' THEN document_id < '3' ELSE document_id >= '3' OR NOT answered END""")
def answer_cache_asks(spark, d):
    """What two runs ask of a provider that answers prompts with one text only: half of the documents first, then all, of which the answered are not asked again and failed prompts come chunk by chunk."""
    from ..sources.providers import ReplayProvider

    chunks, cache = _chunk_batches(spark, d), _cache(spark)
    for run, part in (("first", chunks.where("document_id < '3'")), ("second", chunks)):
        cache.ask(part, ReplayProvider({"7 million": _recorded("reported revenue")}), run)
    return cache.asked().select("key", "asked_as", "answered", "run")


@query(f"""WITH {X0.TEXT_SQL.strip()}, {_CHUNKS_SQL} SELECT document_id, block_index::VARCHAR AS block_id, 'Acme Corporation' AS subject, 'revenue' AS predicate, 1.2e9::DOUBLE AS normalized_value, 'USD' AS unit, 'FY2024' AS time_label, 'global' AS scope,
  'grounded' AS validation_status, 0.95::DOUBLE AS confidence, false AS is_flagged FROM chunks QUALIFY row_number() OVER (PARTITION BY document_id, batch ORDER BY rank) = 1""")
def provider_claims(spark, d):
    """Claims from recorded answers of a model, through the cache: routed to the chunk that holds the quote, normalised, and checked against their page."""
    from ..sources.providers import ReplayProvider

    text, chunks, cache = X0.claim_text(spark, d), _chunk_batches(spark, d), _cache(spark)
    cache.ask(chunks, ReplayProvider({"revenue": _recorded("Reported Revenue of")}), "only")
    claims = X.normalise_answers(cache.claims(chunks))
    held = text.join(claims.select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_semi")
    pages = held.groupBy("document_id", "page_number").agg(F.first("text").alias("raw_text"), F.lit(612.0).alias("width"))
    done = X.grounded_answers(claims, held, pages)
    return done.select("document_id", "block_id", "subject", "predicate", "normalized_value", "unit", F.col("time_data.label").alias("time_label"), "scope", "validation_status", "confidence", "is_flagged")


@query(f"WITH {PAIRS_SQL} SELECT target AS fact_a_id, candidate AS fact_b_id, 'CONTEXTUAL_DIFFERENCE' AS relationship_type, 0.7::DOUBLE AS confidence FROM pairs JOIN claims a ON a.fact_id = target JOIN claims b ON b.fact_id = candidate WHERE a.subject <> b.subject AND 'BUILDING' IN (a.subject, b.subject)")
def judged_pairs(spark, d):
    """Pairs that the cascade leaves open, judged by a recorded answer."""
    from ..sources.providers import ReplayProvider

    c = X0.claims(spark, d)
    open_ = R.tier1(R.with_sides(P.candidate_pairs(c, c), c)).where("r is null").drop("r")
    return R.stored(R.tier3(open_, ReplayProvider({"BUILDING": '{"relationship_type": "contextual_difference", "confidence": 0.7, "explanation": "other entities"}'}))).select("fact_a_id", "fact_b_id", "relationship_type", "confidence")
