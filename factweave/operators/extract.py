"""Claims from tables and callouts, from a provider's answers, and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import normalize as N
from ..functions.text import any_of, bind, strip


def _claim(metric: Column, number: Column, raw: Column, time: Column, quote: Column, path: str, confidence: float) -> list[Column]:
    """The columns that both fast paths share."""
    ours = F.lower("filename").contains("delhivery")
    coin = number["currency"]
    unit = F.coalesce(number["unit"], coin, F.when(raw.contains("₹") | ours, F.lit("INR")))
    return [
        F.col("document_id"), F.col("page_number"), F.col("block_id"), F.col("bbox"), N.document_subject(F.col("filename")).alias("subject"), metric.alias("predicate"), raw.alias("raw_value"),
        number["value"].alias("normalized_value"), F.when(raw.contains("%"), "percentage").otherwise("number").alias("value_type"), unit.alias("unit"), F.coalesce(coin, F.when(unit == "INR", F.lit("INR"))).alias("currency"),
        time.alias("time_data"), F.lit("consolidated").alias("scope"), F.when(ours, F.lit("India")).alias("location"), F.create_map(F.lit("source_type"), F.lit(path)).alias("qualifiers"), F.lit(confidence).alias("confidence"),
        quote.alias("evidence_text"), F.lit("grounded").alias("validation_status"), F.lit(1.0).alias("validation_score"),
    ]


def unpivot_tables(blocks: DataFrame) -> DataFrame:
    """A claim for each number under a period header.

    ``blocks``: document_id, filename, page_number, block_id, block_index, bbox, table_data. Columns after the first whose header
    names a period are period columns; the first cell of a row names the metric.
    """
    rows = blocks.where("size(table_data.headers) > 0 and size(table_data.rows) > 0").select("*", F.posexplode("table_data.rows").alias("row", "cells")).where("size(cells) >= 2")
    cells = rows.withColumn("metric_text", strip(F.col("cells")[0])).where(F.char_length("metric_text") >= 3).select("*", F.posexplode("table_data.headers").alias("col", "header")).where("col > 0 and col < size(cells)")
    timed = bind(cells, time=N.temporal(strip(F.col("header")))).where("time.label is not null and time.label <> '' and time.precision <> 'unspecified'")
    raw = bind(timed, raw=strip(F.get("cells", F.col("col"))))
    valued = bind(raw, number=N.number(F.col("raw"))).where("number.value is not null")
    metric = F.coalesce(N.metric(F.col("metric_text")), N.predicate(F.col("metric_text")))
    quote = F.concat(F.col("metric_text"), F.lit(" ("), F.col("header"), F.lit("): "), F.col("raw"))
    return valued.select(*_claim(metric, F.col("number"), F.col("raw"), F.col("time"), quote, "table_grid", 0.98), F.struct(F.col("block_index"), F.lit(0).alias("path"), F.col("row").alias("at"), F.col("col").alias("sub")).alias("place"))


def callouts(blocks: DataFrame, skip_tables: bool = False) -> DataFrame:
    """A claim for each line that is a number next to a line that names a metric; the line after wins over the line before.

    Neighbours come from the block's own array of lines, so nothing is shuffled. ``skip_tables`` leaves out the rendered
    text of tables, whose rows would pair with the metrics of their neighbours.
    """
    source = blocks.where(F.col("block_type") != "table") if skip_tables else blocks
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), strip), lambda x: x != "")
    triples = F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.struct(i.alias("at"), F.col("lines")[i].alias("line"), F.get("lines", i + 1).alias("after"), F.when(i > 0, F.get("lines", i - 1)).alias("before")))
    at = bind(source, lines=lines).where("size(lines) >= 2").withColumn("x", F.explode(triples)).select("*", "x.*").drop("x")
    at = at.where(~F.col("line").rlike(f"(?U){V.FOOTNOTE}") & ~F.col("line").isin(V.CALLOUT_STOP_LINES))
    at = bind(at, number=N.number(F.col("line"))).where("number.value is not null")
    after, before = N.metric(F.col("after")), N.metric(F.col("before"))
    at = bind(at, _after=after)
    at = bind(at, metric=F.coalesce("_after", before), metric_text=F.when(F.col("_after").isNotNull(), F.col("after")).otherwise(F.col("before"))).where("metric is not null")
    value, low_line, low_text = F.col("number.value"), F.lower("line"), F.lower("text")
    shown = F.col("line").contains("%") | low_line.contains("percent") | low_line.contains("per cent") | F.col("text").contains("%") | low_text.contains("per cent")
    label = F.col("line").rlike(f"(?iU){V.CHART_LABEL}")
    at = at.where(
        F.when(F.col("metric").isin("revenue", "total_income"), F.abs(value) >= 50)
        .when(F.col("metric").isin("express_parcel_volume", "freight_volume", "workforce"), value >= 500)
        .when(F.col("metric").isin(V.RATE_METRICS), shown & ~label)
        .otherwise(True)
    )
    context = F.concat_ws(" ", "text", "filename")
    time, low = N.temporal(context), F.lower(context)

    def period(text: str, precision: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(text).alias("label"), none.alias("start"), none.alias("end"), F.lit(precision).alias("precision"))

    ladder = F.lit(None)
    for words, name, precision in reversed(V.CALLOUT_PERIODS):
        ladder = F.when(any_of(low, words), period(name, precision)).otherwise(ladder)
    at = bind(at, found=time).withColumn("time", F.when(F.coalesce(F.col("found.precision"), F.lit("unspecified")) == "unspecified", F.coalesce(ladder, F.col("found"))).otherwise(F.col("found")))
    quote = F.concat(F.col("metric_text"), F.lit(": "), F.col("line"))
    return at.select(*_claim(F.col("metric"), F.col("number"), F.col("line"), F.col("time"), quote, "callout_metric", 0.99), F.struct(F.col("block_index"), F.lit(1).alias("path"), F.col("at"), F.lit(0).alias("sub")).alias("place"))


def first_of(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. ``min_by`` of the packed row aggregates before the shuffle, where a window would sort every row."""
    names = [f"_k{i}" for i in range(len(key))]
    packed = df.select(*[k.alias(n) for k, n in zip(key, names, strict=True)], F.struct(*order).alias("_o"), F.struct("*").alias("_r"))
    return packed.groupBy(*names).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def dedup_fast(claims: DataFrame) -> DataFrame:
    """One claim for each subject, predicate, value, period and page of a document; the first in page order stays."""
    key = [F.col("document_id"), F.lower("subject"), F.col("predicate"), F.col("normalized_value"), F.col("time_data.label"), F.col("page_number")]
    return first_of(claims, key, [F.col("place.block_index"), F.col("place.path"), F.col("place.at"), F.col("place.sub")])


def fast_path(blocks: DataFrame, skip_tables: bool = False) -> DataFrame:
    """Claims of tables and callouts together, without repeats."""
    return dedup_fast(unpivot_tables(blocks).unionByName(callouts(blocks, skip_tables)))


def adjusted_confidence(status: Column, base: Column) -> Column:
    base = F.coalesce(base, F.lit(0.90))
    return F.when(status == "grounded", F.greatest(F.lit(0.85), F.least(F.lit(0.99), base))).when(status == "grounded_with_warning", F.round(base * 0.85, 2)).otherwise(F.round(base * 0.30, 2))


def normalise_answers(answers: DataFrame) -> DataFrame:
    """A provider's claims with normalised values. Claims without subject, predicate or value are dropped.

    ``answers``: document_id, page_number, block_id, bbox, chunk_text, subject, predicate, raw_value, value_type, unit, currency, time (what the provider
    wrote: an object's JSON, or words, which are normalised), scope, location, confidence, quote.
    """
    whole = answers.where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> '' and coalesce(raw_value, '') <> ''")
    number = N.number(F.col("raw_value"))
    unit = F.coalesce(F.col("_n.unit"), "unit")
    return whole.withColumn("_n", number).select(
        "document_id", "page_number", "block_id", "bbox", N.entity(F.col("subject")).alias("subject"), N.predicate(F.col("predicate")).alias("predicate"), "raw_value", F.col("_n.value").alias("normalized_value"),
        F.coalesce("value_type", F.lit("text")).alias("value_type"), unit.alias("unit"), F.coalesce(F.col("_n.currency"), F.col("currency"), F.when(unit.isin("USD", "EUR", "GBP", "INR"), unit)).alias("currency"),
        _period(F.col("time")).alias("time_data"), F.coalesce("scope", F.lit("global")).alias("scope"), "location", F.col("confidence"), F.coalesce(F.col("quote"), F.substring("chunk_text", 1, 120)).alias("evidence_text"), strip(F.coalesce("quote", F.lit(""))).alias("quote"),
    )


def _period(time: Column) -> Column:
    """An object's own fields, else the period that the words name."""
    own = F.from_json(time, "struct<label:string,start:string,end:string,precision:string>")
    return F.when(strip(time).startswith("{"), own).otherwise(N.temporal(time))


def grounded_answers(claims: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Normalised claims with their quotes checked: validation_status, validation_score, is_flagged, the box of what holds the quote, and a confidence that follows.

    ``blocks`` and ``pages`` as for ``ground.ground``. Equal quotes of a block are checked once; claims without a quote are unsupported.
    """
    from .ground import flagged, ground

    own = ["document_id", "page_number", "block_id", "quote"]
    keyed = claims.withColumn("quote_id", F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own])), 256))
    checked = ground(keyed.select("quote_id", *own).dropDuplicates(["quote_id"]), blocks, pages).select("quote_id", F.col("status").alias("validation_status"), F.col("score").alias("validation_score"), F.col("bbox").alias("_box"))
    status = F.col("validation_status")
    found = keyed.join(checked, "quote_id").drop("quote_id")
    return found.withColumns({"confidence": adjusted_confidence(status, F.col("confidence")), "is_flagged": flagged(status), "bbox": F.coalesce("_box", "bbox")}).drop("_box")


def merge_claims(fast: DataFrame, answered: DataFrame) -> DataFrame:
    """Both sources without repeats of subject, predicate, value (raw if there is no number), period and page; the fast path wins."""
    both = fast.withColumn("_p", F.lit(0)).unionByName(answered.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    value = F.coalesce(F.col("normalized_value").cast("string"), F.lower("raw_value"))
    key = [F.col("document_id"), F.lower("subject"), F.lower("predicate"), value, F.col("time_data.label"), F.col("page_number")]
    return first_of(both, key, [F.col("_p"), F.col("block_id"), F.col("raw_value")]).drop("_p")


def clean_json(answer: Column) -> Column:
    """The outermost braces of an answer, else the answer without code fences."""
    braces = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(braces != "", braces).otherwise(strip(F.regexp_replace(answer, r"```(?:json)?", "")))


def chunk_key(text: Column, heading: Column, table: Column) -> Column:
    """Key under which a chunk's answer may be reused."""
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), F.coalesce(heading, F.lit("")), F.coalesce(table, F.lit(""))), 256)


def batches(chunks: DataFrame, size: int = 5) -> DataFrame:
    """Number of the prompt that a chunk goes into, within its document."""
    order = Window.partitionBy("document_id").orderBy("rank")
    return chunks.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def route_answers(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk of each claim of a batch: that named by chunk_id, else the first that contains its quote, else the batch's first.

    ``claims``: document_id, batch, chunk_id, quote, ...; ``chunks``: document_id, batch, rank, chunk_id, text.
    """
    own = chunks.groupBy("document_id", "batch").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("_c"))  # a batch holds few chunks
    named = F.filter("_c", lambda c: c["chunk_id"] == F.col("chunk_id"))
    holding = F.filter("_c", lambda c: (F.coalesce(F.col("quote"), F.lit("")) != "") & F.lower(c["text"]).contains(F.lower(F.col("quote"))))
    picked = F.coalesce(F.get(named, F.lit(0)), F.get(holding, F.lit(0)), F.get("_c", F.lit(0)))
    return claims.join(own, ["document_id", "batch"]).withColumn("_x", picked).withColumn("chunk_id", F.col("_x.chunk_id")).withColumn("chunk_text", F.col("_x.text")).drop("_c", "_x")
