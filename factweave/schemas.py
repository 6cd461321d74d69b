"""Schemas of the tables. JSON columns are structs, arrays and maps; only reasoning_metadata stays open."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_MAP = T.MapType(_S, _S)
BBOX = T.ArrayType(_D, True)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not required) for name, kind, required in fields])


TIME = _schema(("label", _S, False), ("start", _S, False), ("end", _S, False), ("precision", _S, False))
TABLE_DATA = _schema(("headers", T.ArrayType(_S), False), ("rows", T.ArrayType(T.ArrayType(_S)), False))

DOCUMENTS = _schema(("id", _S, True), ("filename", _S, True), ("file_hash", _S, True), ("file_size", _L, True), ("status", _S, True), ("page_count", _I, False), ("error_message", _S, False), ("metadata", _MAP, False), ("created_at", _TS, False), ("completed_at", _TS, False))
PAGES = _schema(("id", _S, True), ("document_id", _S, True), ("page_number", _I, True), ("width", _D, False), ("height", _D, False), ("extraction_method", _S, False), ("quality_score", _D, False), ("raw_text", _S, False), ("created_at", _TS, False))
BLOCKS = _schema(("id", _S, True), ("page_id", _S, True), ("document_id", _S, True), ("page_number", _I, True), ("block_index", _I, True), ("block_type", _S, False), ("text", _S, True), ("bbox", BBOX, False), ("table_data", TABLE_DATA, False), ("metadata", _MAP, False))
FACTS = _schema(
    ("id", _S, True), ("document_id", _S, True), ("subject", _S, True), ("predicate", _S, True), ("raw_value", _S, True), ("normalized_value", _D, False), ("value_type", _S, False), ("unit", _S, False), ("currency", _S, False), ("time_data", TIME, False),
    ("scope", _S, False), ("location", _S, False), ("qualifiers", _MAP, False), ("confidence", _D, False), ("embedding", T.ArrayType(_D), False), ("is_flagged", _B, False), ("flag_reason", _S, False), ("created_at", _TS, False),
)
EVIDENCE = _schema(("id", _S, True), ("fact_id", _S, True), ("document_id", _S, True), ("page_id", _S, False), ("page_number", _I, True), ("block_id", _S, True), ("evidence_text", _S, True), ("bbox", BBOX, False), ("validation_status", _S, False), ("validation_score", _D, False), ("created_at", _TS, False))
RELATIONSHIPS = _schema(("id", _S, True), ("fact_a_id", _S, True), ("fact_b_id", _S, True), ("relationship_type", _S, True), ("confidence", _D, True), ("explanation", _S, True), ("supporting_dimensions", T.ArrayType(_S), False), ("resolution_tier", _S, False), ("reasoning_metadata", T.VariantType(), False), ("created_at", _TS, False))
JOBS = _schema(("id", _S, True), ("document_id", _S, True), ("stage", _S, False), ("status", _S, False), ("progress", _I, False), ("message", _S, False), ("timings", T.MapType(_S, _D), False), ("started_at", _TS, False), ("completed_at", _TS, False))

#: Stage of ingestion -> progress in percent.
STAGES = {"QUEUED": 0, "LAYOUT_EXTRACTION": 20, "CANDIDATE_DETECTION": 40, "FACT_EXTRACTION": 60, "CROSS_DOC_RESOLUTION": 85, "COMPLETED": 100, "FAILED": 0}
