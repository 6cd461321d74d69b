"""Grounding of quotes in their source: containment in the JVM, the fuzzy ratio only for what containment leaves open."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import vocabulary as V
from ..functions.text import bind, clean, let, strip
from ..session import written


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by whole-row bit operations; blocks that a ratio matches are one, so it bounds them."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(b) - row.bit_count()


def exact_ratio(a: str | None, b: str | None, least: float = 0.0) -> float | None:
    """Ratcliff-Obershelp similarity of two texts, None where it cannot be above ``least``."""
    if a is None or b is None or (least > 0 and 2 * common(a, b) <= least * (len(a) + len(b)) - 1e-6):
        return None
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio(quote: pd.Series, text: pd.Series, least: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of (quote, text), in this order; null where it cannot be above ``least``."""
    return pd.Series([exact_ratio(a, b, c) for a, b, c in zip(quote, text, least, strict=True)], dtype="float64")


#: Characters that are counted apart; all others are one class.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(text: Column) -> Column:
    """Occurrences of each counted character and of all others."""
    n = F.char_length(text)
    own = [n - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in COUNTED]
    return let(F.array(n, *own), lambda x: F.array_append(x, x[0] * 2 - F.aggregate(x, F.lit(0), lambda t, v: t + v)))


def may_exceed(a: Column, b: Column, least: Column) -> Column:
    """Whether two texts can have a ratio above ``least``: what is matched is no more than the lengths and the characters that both have. Characters are counted only where lengths allow it."""
    shared = F.aggregate(F.zip_with(F.slice(letters(a), 2, len(COUNTED) + 1), F.slice(letters(b), 2, len(COUNTED) + 1), lambda x, y: F.least(x, y)), F.lit(0), lambda t, v: t + v)
    n, m = F.char_length(a), F.char_length(b)
    return F.when(2 * F.least(n, m) > least * (n + m), 2 * shared > least * (n + m)).otherwise(False)


def block_pairs(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each cleaned quote (_q) with the blocks (_b) of its page, whether it cites the block and whether it lies in it."""
    b = blocks.select("document_id", "page_number", F.col("id").alias("_bid"), "block_index", clean(F.col("text")).alias("_b"), F.col("bbox").alias("_box"))
    q = quotes.select("quote_id", "document_id", "page_number", "block_id", "_q")
    both = q.join(b, ["document_id", "page_number"])
    return both.withColumns({"cited": F.coalesce(F.col("_bid") == F.col("block_id"), F.lit(False)), "inside": F.coalesce(F.col("_b").contains(F.col("_q")), F.lit(False))})


def threshold() -> Column:
    """The ratio that a pair has to exceed: that of the cited block, or the higher one of any other."""
    return F.when(F.col("cited"), V.GROUND["block_weak"]).otherwise(V.GROUND["other"])


def to_compare(pairs: DataFrame) -> DataFrame:
    """Pairs that lie outside each other and whose ratio can exceed its threshold."""
    return pairs.where(~F.col("inside") & may_exceed(F.col("_q"), F.col("_b"), threshold()))


def ground(quotes: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``quotes`` (quote_id, document_id, page_number, block_id, quote) with status, score and bbox.

    In order: the cited block by containment or ratio, every block of the page in order, the page's text. Blocks come
    with their page (document_id, page_number, id, block_index, text, bbox), pages with document_id, page_number, raw_text, width.
    """
    q = quotes.withColumn("_q", clean(F.coalesce(F.col("quote"), F.lit(""))))
    valid = q.where("_q <> ''").join(pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")
    inside, cited = F.col("inside"), F.col("cited")
    pairs = block_pairs(valid, blocks).where(inside | may_exceed(F.col("_q"), F.col("_b"), threshold()))
    scored = pairs.withColumn("r", ratio(F.when(~inside, F.col("_q")), F.col("_b"), threshold()))
    hit = (
        F.when(cited & inside, _result(0, "grounded", F.lit(1.0)))
        .when(cited & (F.col("r") > V.GROUND["block"]), _result(0, "grounded", F.round("r", 2)))
        .when(cited & (F.col("r") > V.GROUND["block_weak"]), _result(0, "grounded_with_warning", F.round("r", 2)))
        .when(inside, _result(1, "grounded", F.lit(0.95)))
        .when(F.col("r") > V.GROUND["other"], _result(1, "grounded_with_warning", F.round("r", 2)))
    )
    # Written, since what the page's text is read for and the result both need it: ratios are computed once.
    by_block = scored.withColumn("x", hit).where("x is not null").groupBy("quote_id").agg(F.min_by(F.struct("x.*", F.col("_box").alias("bbox")), F.struct("x.step", "block_index")).alias("x")).select("quote_id", "x.*")
    by_block = written(by_block, "grounded")
    # The page's text is read only for quotes that no block holds.
    text = pages.select("document_id", "page_number", "raw_text", "width")
    rest = valid.join(by_block.select("quote_id"), "quote_id", "left_anti").join(text, ["document_id", "page_number"])
    rest = bind(rest, _page=clean(F.coalesce(F.col("raw_text"), F.lit(""))))
    on_page, least = F.col("_page").contains(F.col("_q")), F.lit(V.GROUND["page"])
    alike = rest.where(on_page | may_exceed(F.col("_q"), F.col("_page"), least))
    tried = alike.withColumn("r", ratio(F.when(~on_page, F.col("_q")), F.col("_page"), least)).withColumn("r", F.when(on_page, F.lit(0.85)).otherwise(F.col("r"))).where(F.col("r") > least)
    box = F.array(F.lit(50.0), F.lit(50.0), F.col("width") - 50.0, F.lit(150.0))
    by_page = tried.select("quote_id", F.lit(2).alias("step"), F.lit("grounded_with_warning").alias("status"), F.round("r", 2).alias("score"), box.alias("bbox"))
    found = by_block.unionByName(by_page).drop("step")
    return quotes.join(found, "quote_id", "left").withColumns({"status": F.coalesce("status", F.lit("unsupported")), "score": F.coalesce("score", F.lit(0.0))})


def _result(step: int, status: str, score: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(status).alias("status"), score.alias("score"))


def flagged(status: Column) -> Column:
    return status == "unsupported"


def stored_score(score: Column, strict: bool = False) -> Column:
    """Score as it is stored: a zero is stored as 1 unless ``strict``."""
    return score if strict else F.when(score == 0, 1.0).otherwise(score)


def has_quote(text: Column, quote: Column) -> Column:
    """Whether a cleaned text holds a cleaned quote."""
    return (strip(F.coalesce(quote, F.lit(""))) != "") & clean(text).contains(clean(quote))
