"""Column functions that normalise numbers, currencies, periods, entities, predicates and file names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from .text import first_rule, let, strip

_NUMBER = f"(?U){V.NUMBER}"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def currency(raw: Column) -> Column:
    """Code of the first currency mark that occurs anywhere in the text, even inside a word."""
    return first_rule(F.lower(raw), [([mark], code) for mark, code in V.CURRENCIES], None)


def _double(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def number(raw: Column) -> Column:
    """struct<value double, unit string, currency string>.

    Signs: parentheses around the whole, leading dashes, the word negative. A percentage is its first number over 100. Otherwise
    the first number times the first scale word of the list that occurs as a token or a suffix of digits.
    """
    none = F.lit(None)

    def result(value: Column, unit: Column, coin: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), unit.cast("string").alias("unit"), coin.cast("string").alias("currency"))

    def signed(text: Column) -> Column:
        """The text without its sign, and the sign."""
        bracketed = text.startswith("(") & text.endswith(")") & (F.char_length(text) > 1)
        minus = text.startswith("-") | F.lower(text).contains("negative")
        body = F.when(bracketed, strip(F.substring(text, F.lit(2), F.char_length(text) - 2))).when(minus, strip(F.regexp_replace(text, "^-+", ""))).otherwise(text)
        return F.struct(body.alias("body"), F.when(bracketed | minus, F.lit(-1.0)).otherwise(1.0).alias("sign"), currency(text).alias("coin"))

    def lowered(x: Column) -> Column:
        return F.struct(x["body"].alias("body"), F.lower(x["body"]).alias("low"), x["sign"].alias("sign"), x["coin"].alias("coin"), _double(found(x["body"], _NUMBER)).alias("first"))

    def parsed(x: Column) -> Column:
        percent = (x["low"].contains("%") | x["low"].contains("percent")) & x["first"].isNotNull()
        scale = F.lit(1.0)
        for word, factor in reversed(V.SCALES):
            scale = F.when(x["low"].rlike(rf"(?U)(?:\b|(?<=\d)){word}(?:\b|$)"), F.lit(factor)).otherwise(scale)
        unit = F.coalesce(F.lower(found(x["body"], rf"(?iU)\b({V.UNIT_WORDS})\b")), x["coin"])
        return (
            F.when(percent, result(F.round(x["first"] / 100.0, 6) * x["sign"], F.lit("%"), none))
            .when(x["first"].isNull(), result(none, none, x["coin"]))
            .otherwise(result(x["first"] * scale * x["sign"], unit, x["coin"]))
        )

    whole = let(strip(raw), lambda text: let(signed(text), lambda x: let(lowered(x), parsed)))
    return F.when(raw.isNull() | (raw == ""), result(none, none, none)).otherwise(whole)


def temporal(raw: Column) -> Column:
    """struct<label, start, end, precision>: the first rule that applies names the period."""
    return let(strip(raw), lambda text: _temporal(raw, text))


def _temporal(raw: Column, text: Column) -> Column:
    span, fiscal, quarter, days, year = f"(?iU){V.FISCAL_SPAN}", f"(?iU){V.FISCAL_YEAR}", f"(?iU){V.QUARTER}", f"(?U){V.DAY_RANGE}", f"(?U){V.YEAR}"
    none = F.lit(None)
    y1, y2 = (found(text, span, g).try_cast("int") for g in (1, 2))

    def full(y: Column) -> Column:
        return F.when(F.char_length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)

    def result(label: Column, precision: str | None, start: Column = none, end: Column = none) -> Column:
        return F.struct(label.cast("string").alias("label"), start.cast("string").alias("start"), end.cast("string").alias("end"), F.lit(precision).cast("string").alias("precision"))

    y = found(text, year)
    return (
        F.when(raw.isNull() | (raw == ""), result(none, None))
        .when(F.coalesce(y2 == (y1 + 1) % 100, F.lit(False)), result(F.concat(F.lit("FY"), (2000 + y2).cast("string")), "fiscal_year"))
        .when(text.rlike(fiscal), result(F.concat(F.lit("FY"), full(found(text, fiscal))), "fiscal_year"))
        .when(text.rlike(quarter), result(F.concat(F.upper(found(text, quarter)), F.lit(" "), full(found(text, quarter, 2))), "quarter"))
        .when(text.rlike(days), result(text, "range", found(text, days), found(text, days, 2)))
        .when(y.isNotNull(), result(y, "year", F.concat(y, F.lit("-01-01")), F.concat(y, F.lit("-12-31"))))
        .when(F.lower(text).contains("as of"), result(text, "point_in_time"))
        .otherwise(result(text, "unspecified"))
    )


def entity(raw: Column) -> Column:
    """Canonical name: known institutions by pattern, else legal forms spelt one way."""
    return F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(let(strip(raw), _entity))


def _entity(text: Column) -> Column:
    out = text
    for pattern, form in V.LEGAL_FORMS:
        out = F.regexp_replace(out, f"(?iU){pattern}", form)
    out = let(out, lambda x: F.when(x.endswith(".") & ~x.endswith("Inc.") & ~x.endswith("Ltd."), strip(F.regexp_replace(x, r"\.\z", ""))).otherwise(x))
    out = strip(F.regexp_replace(out, r"(?U)\s+", " "))
    for pattern, name in reversed(V.INSTITUTIONS):
        out = F.when(text.rlike(rf"(?iU)\b(?:{pattern})\b"), F.lit(name)).otherwise(out)
    return out


def predicate(raw: Column) -> Column:
    """Canonical predicate of an alias, else the cleaned words."""
    words = strip(F.regexp_replace(F.regexp_replace(F.lower(strip(raw)), r"[_\-]+", " "), r"(?U)\s+", " "))
    table = F.create_map(*chain.from_iterable((F.lit(alias), F.lit(name)) for name, aliases in V.PREDICATE_ALIASES.items() for alias in aliases))
    return F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(let(words, lambda w: F.coalesce(F.try_element_at(table, w), w)))


def metric(text: Column) -> Column:
    """First metric of the ordered list one of whose aliases the text contains; null if none."""
    return first_rule(F.lower(text), [(aliases, name) for name, aliases in V.FAST_METRICS], None)


def dataset(filename: Column) -> Column:
    return first_rule(F.lower(filename), V.DATASET_RULES, V.DEFAULT_DATASET)


def document_subject(filename: Column, rules: list[tuple[list[str], str]] | None = None, default: str = V.DEFAULT_SUBJECT) -> Column:
    return first_rule(F.lower(filename), V.SUBJECT_RULES if rules is None else rules, default)
