"""Operators over pages and blocks: splitting, numbering, overlap filter, heading context, candidate chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import block_type, density, page_quality, strip
from ..session import written


def text_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One block a line of each document: document_id, page_number, block_index, block_type, text. Blank lines are dropped, numbers stay dense."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: strip(x) != "")
    return docs.select(F.col(doc_id).alias("document_id"), F.posexplode(lines).alias("block_index", "text")).select(
        "document_id", F.lit(1).alias("page_number"), "block_index", block_type(F.col("text")).alias("block_type"), "text"
    )


def block_id(document_id: Column, page: Column, index: Column, is_table: Column) -> Column:
    """First eight characters of the document, page, and number of the block; tables are numbered apart."""
    return F.concat(F.substring(document_id.cast("string"), 1, 8), F.lit("_p"), page.cast("string"), F.when(is_table, F.lit("_t")).otherwise(F.lit("_b")), index.cast("string"))


def area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes [x0, y0, x1, y1] share."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return wide * high


#: Edge of the finest tiles, in points, and the coarsest level of tiles, each twice as wide as those before.
TILE, LEVELS = 64.0, 40
#: Tables of a page that still come as one array.
CROWDED = 64


def _tiles(level: Column, x: Column) -> Column:
    return F.floor(x / (TILE * F.pow(F.lit(2.0), level)))


def drop_table_overlaps(blocks: DataFrame, tables: DataFrame, key: list[str], share: float = 0.65, crowded: int = CROWDED) -> DataFrame:
    """Blocks of which more than ``share`` (a half at least) of the area lies in one table of the same page are left out.

    Tables inside another one are left out first: what they cover, that one covers too. A page's tables come as one array where they are few; on pages of more than ``crowded`` the blocks that none of the largest covers go through :func:`covered_boxes`. Boxes that
    are null or not finite cover nothing and are not covered.
    """
    tables = written(outermost(tables.where(_finite(F.col("bbox"))), key), "tables")
    few = tables.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(area(F.col("bbox")).desc(), "bbox"))).where(F.col("_n") <= crowded + 1)
    boxes = written(few.groupBy(*key).agg(F.collect_list("bbox").alias("_tables")), "boxes")
    covered = F.exists("_tables", lambda t: overlap(F.col("bbox"), t) / F.greatest(F.lit(1.0), area(F.col("bbox"))) > share)
    known = blocks.join(boxes, key, "left")
    crowd = F.coalesce(F.size("_tables") > crowded, F.lit(False))
    seen = known.where(~F.coalesce(_finite(F.col("bbox")) & covered, F.lit(False)))
    left = seen.where(~crowd).select(*blocks.columns)
    most = boxes.where(crowd).select(*key)
    if most.isEmpty():
        return left
    there = written(seen.where(crowd).select(*blocks.columns), "uncovered")
    return left.unionByName(there.join(covered_boxes(there, tables.join(most, key, "left_semi"), key, share), [*key, "bbox"], "left_anti").select(*blocks.columns))


def outermost(tables: DataFrame, key: list[str]) -> DataFrame:
    """key, bbox of ``tables`` without repeated ones and those that lie, between the same two sides, inside another one of the page."""
    sides = [F.col("bbox")[i].alias(x) for i, x in enumerate(("x0", "y0", "x1", "y1"))]
    left = tables.select(*key, *sides).groupBy(*key, "x0", "y0", "y1").agg(F.max("x1").alias("x1"))
    for low, high, across in (("x0", "x1", ("y0", "y1")), ("y0", "y1", ("x0", "x1"))):
        before = Window.partitionBy(*key, *across).orderBy(F.col(low), F.col(high).desc()).rowsBetween(Window.unboundedPreceding, -1)
        left = left.withColumn("_reach", F.max(high).over(before)).where(F.col("_reach").isNull() | (F.col(high) > F.col("_reach"))).drop("_reach")
    return left.select(*key, F.array("x0", "y0", "x1", "y1").alias("bbox"))


def _finite(box: Column) -> Column:
    sides = [F.coalesce(F.abs(F.get(box, F.lit(i))) < F.lit(float("inf")), F.lit(False)) for i in range(4)]
    return sides[0] & sides[1] & sides[2] & sides[3]


def covered_boxes(blocks: DataFrame, tables: DataFrame, key: list[str], share: float) -> DataFrame:
    """key, bbox of the blocks of which more than ``share`` lies in one table, by a grid join.

    Such a table holds the block's centre. A table goes to the tiles that it touches on the level where these are as large as it, four at most;
    a block to the tile of its centre on each level that its page's tables have. No page is gathered, and one of very many boxes is spread by its tiles.
    """
    if share < 0.5:
        raise ValueError("a table that covers less than half of a block need not hold its centre")
    box = F.col("bbox")
    size = F.greatest(box[2] - box[0], box[3] - box[1], F.lit(TILE))
    leveled = tables.where(_finite(box)).select(*key, "bbox", F.least(F.ceil(F.log2(size / TILE)), F.lit(LEVELS)).cast("int").alias("level"))
    columns, lines = (F.sequence(_tiles(F.col("level"), box[i]), F.greatest(_tiles(F.col("level"), box[i]), _tiles(F.col("level"), box[i + 2]))) for i in (0, 1))
    tiled = leveled.withColumn("tx", F.explode(columns)).withColumn("ty", F.explode(lines)).withColumnRenamed("bbox", "_table")
    levels = leveled.groupBy(*key).agg(F.collect_set("level").alias("_levels"))
    asked = blocks.where(_finite(box)).select(*key, "bbox").join(levels, key).withColumn("level", F.explode("_levels"))
    placed = asked.select(*key, "bbox", "level", *[_tiles(F.col("level"), (box[i] + box[i + 2]) / 2).alias(t) for i, t in ((0, "tx"), (1, "ty"))])
    inside = overlap(box, F.col("_table")) / F.greatest(F.lit(1.0), area(box)) > share
    return placed.join(tiled, [*key, "level", "tx", "ty"]).where(inside).select(*key, "bbox")


def number_blocks(tables: DataFrame, texts: DataFrame, key: list[str], order: str = "raw_order") -> DataFrame:
    """Tables first, then texts, each in page order, numbered from 0 a page; empty blocks go, boxes of texts are rounded to two digits."""
    both = tables.select(*key, order, "text", "bbox", F.lit(True).alias("is_table")).unionByName(
        texts.select(*key, order, "text", F.transform("bbox", lambda x: F.round(x, 2)).alias("bbox"), F.lit(False).alias("is_table"))
    )
    page = Window.partitionBy(*key).orderBy(F.col("is_table").desc(), order)
    return both.where(strip(F.col("text")) != "").withColumn("block_index", F.row_number().over(page) - 1)


def with_page_quality(pages: DataFrame, ocr=None) -> DataFrame:
    """Pages with quality_score, is_poor, reasons and extraction_method.

    ``ocr`` reads the poor pages only (a function DataFrame -> DataFrame with page_id and ocr_text); what it read has
    score 0.85 and method ocr.
    """
    q = page_quality(F.col("raw_text"), F.col("width"), F.col("height"), F.col("has_images"))
    out = pages.withColumn("_q", q).select("*", F.col("_q.score").alias("quality_score"), F.col("_q.is_poor").alias("is_poor"), F.col("_q.reasons").alias("reasons"), F.lit("native").alias("extraction_method")).drop("_q")
    if ocr is None:
        return out
    read = ocr(out.where("is_poor")).select("page_id", "ocr_text")
    done = F.col("ocr_text").isNotNull()
    return out.join(read, "page_id", "left").withColumns({
        "raw_text": F.coalesce("ocr_text", "raw_text"), "quality_score": F.when(done, 0.85).otherwise(F.col("quality_score")), "extraction_method": F.when(done, "ocr").otherwise(F.col("extraction_method")),
        "reasons": F.when(done, F.array_append("reasons", F.lit("OCR fallback applied"))).otherwise(F.col("reasons")),
    }).drop("ocr_text")


def with_heading_context(blocks: DataFrame) -> DataFrame:
    """The last heading before each block on its page, null before the first."""
    page = Window.partitionBy("document_id", "page_number").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading_context", F.last(F.when(F.col("block_type") == "heading", strip(F.col("text"))), ignorenulls=True).over(page))


def table_context(headers: Column) -> Column:
    """The non-empty headers of a table in one line; null without headers."""
    return F.when(F.size(headers) > 0, F.concat(F.lit("Columns: "), F.array_join(F.filter(headers, lambda h: h.isNotNull() & (h != "")), ", ")))


def scored_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks other than headings with density score and signals."""
    # A generator, so that filters on the score don't repeat the patterns (see text.bind).
    return blocks.where(F.col("block_type") != "heading").select("*", F.inline(F.array(density(F.col("text"), F.col("block_type")))))


def top_candidates(blocks: DataFrame, k: int = V.MOST_CHUNKS, least: float = V.LEAST_DENSITY) -> DataFrame:
    """The ``k`` densest blocks of each document at ``least`` or more; ties by place. Spark limits each group before the shuffle."""
    ranked = Window.partitionBy("document_id").orderBy(F.col("score").desc(), "page_number", "block_index")
    return scored_blocks(blocks).where(F.col("score") >= least).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def candidate_chunks(blocks: DataFrame, k: int = V.MOST_CHUNKS, least: float = V.LEAST_DENSITY) -> DataFrame:
    """What is handed to extraction: chunk_id, document_id, page_number, block_id, heading_context, table_context, text, bbox, signals."""
    context = table_context(F.col("table_data.headers")) if "table_data" in blocks.columns else F.lit(None).cast("string")
    return top_candidates(with_heading_context(blocks), k, least).select(
        F.concat(F.lit("chunk_"), F.col("id")).alias("chunk_id"), "document_id", "page_number", F.col("id").alias("block_id"), "heading_context", context.alias("table_context"), "text", "bbox", "signals", "score", "rank"
    )
