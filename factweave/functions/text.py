"""Column functions over text: cleaning, page quality, block types and information density."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V


def strip(c: Column) -> Column:
    """Without white space, of any Unicode kind, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Nested expressions would repeat it in every place it is used."""
    return F.transform(F.array(value), body)[0]


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with further columns that are computed once. Filters on a plain column are pushed below it, which repeats its expression; they stay above a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def any_of(c: Column, parts: list[str]) -> Column:
    """Whether ``c`` contains one of the strings."""
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def first_rule(c: Column, rules: list[tuple[list[str], str]], default: str | None) -> Column:
    """Value of the first rule one of whose strings ``c`` contains."""
    out = F.lit(default)
    for parts, value in reversed(rules):
        out = F.when(any_of(c, parts), F.lit(value)).otherwise(out)
    return out


def clean(c: Column) -> Column:
    """Lower case, runs of white space as one space, no punctuation; for comparisons of quotes with texts."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"(?U)[^\w\s]", ""))


def block_type(text: Column, is_table: Column | None = None) -> Column:
    """table, heading, list or text."""
    return let(strip(text), lambda t: _block_type(t, is_table))


def _block_type(t: Column, is_table: Column | None) -> Column:
    upper = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    title = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{L}\p{Lu}") & ~t.rlike(r"(?<!\p{L})\p{Ll}")
    heading = (F.char_length(t) < 80) & ~t.rlike(r"[.:;]\z") & (upper | title)
    out = F.when(t == "", "text").when(heading, "heading").when(t.rlike(r"(?U)^(?:\*|-|•|\d+[.)])\s+"), "list").otherwise("text")
    return out if is_table is None else F.when(is_table, "table").otherwise(out)


def page_quality(text: Column, width: Column, height: Column, has_images: Column) -> Column:
    """struct<score double, is_poor boolean, reasons array<string>> of a page's extracted text."""
    n = F.char_length(strip(text))
    garbage = 1.0 - F.regexp_count(text, F.lit(f"(?U){V.READABLE}")) / F.greatest(n, F.lit(1))

    def result(score: Column, poor: bool, reason: Column | None) -> Column:
        reasons = F.array(reason) if reason is not None else F.array().cast("array<string>")
        return F.struct(score.cast("double").alias("score"), F.lit(poor).alias("is_poor"), reasons.alias("reasons"))

    few = (n < 35) & (width * height > 200000)
    share = F.format_string("High ratio of unprintable or corrupt glyphs (%.1f%%)", garbage * 100)
    return (
        F.when((n == 0) & has_images, result(F.lit(0.0), True, F.lit("Scanned/Image-only page with no native text")))
        .when(n == 0, result(F.lit(1.0), False, F.lit("Blank page with no content")))
        .when(few & has_images, result(F.lit(0.2), True, F.lit("Suspiciously low character count on page containing images")))
        .when(few, result(F.lit(0.8), False, F.lit("Low character count (likely title or separator page)")))
        .when(garbage > 0.35, result(F.greatest(F.lit(0.1), 1.0 - garbage), True, share))
        .otherwise(result(F.round(F.greatest(F.lit(0.6), F.least(F.lit(1.0), 1.0 - garbage)), 2), False, None))
    )


def is_boilerplate(text: Column) -> Column:
    """Whether a text holds a boilerplate phrase; exactly such texts have the score BOILERPLATE_POINTS in :func:`density`, without its counts."""
    return text.rlike(f"(?iU){V.BOILERPLATE}")


def density(text: Column, kind: Column) -> Column:
    """struct<score double, signals array<string>>: weighted hits of the signal patterns; boilerplate has none."""
    none = F.struct(F.lit(V.BOILERPLATE_POINTS).alias("score"), F.array().cast("array<string>").alias("signals"))
    counts = F.array(*[F.regexp_count(text, F.lit(f"(?iU){pattern}")) for _, pattern, _, _ in V.DENSITY_SIGNALS])
    return F.when(is_boilerplate(text), none).otherwise(let(counts, lambda hits: _density(hits, kind)))


def _density(counts: Column, kind: Column) -> Column:
    points, names = [F.when(kind == "table", F.lit(V.TABLE_POINTS)).otherwise(0.0)], [F.when(kind == "table", F.lit("structured_table"))]
    for i, (name, _, each, most) in enumerate(V.DENSITY_SIGNALS):
        hits = counts[i]
        gain = hits * F.lit(each)
        points.append(gain if most is None else F.least(gain, F.lit(most)))
        names.append(F.when(hits > 0, F.lit(name)))
    total = points[0]
    for p in points[1:]:
        total = total + p
    return F.struct(F.round(total, 2).alias("score"), F.array_compact(F.array(*names)).alias("signals"))
