"""Classification of fact pairs: a deterministic cascade, then a judge for what it leaves open, and what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import any_of, bind, strip

_SIDES = ("subject", "predicate", "raw_value", "normalized_value", "unit", "scope", "time_label")


def side(facts: DataFrame, prefix: str) -> DataFrame:
    """The columns of a fact that resolution reads, under a prefix."""
    label = F.col("time_data.label") if "time_data" in facts.columns else F.col("time_label")
    return facts.withColumn("time_label", label).select(F.col("fact_id").alias(f"{prefix}_id"), F.col("document_id").alias(f"{prefix}_document_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in _SIDES])


def with_sides(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (target, candidate) with the facts of both: a is the target, b the candidate."""
    a, b = side(facts, "a"), side(facts, "b")
    return pairs.join(a, pairs.target == a.a_id).join(b, pairs.candidate == b.b_id)


def plain(x: str) -> Column:
    """struct<s, p, t, c, u, x>: subject, predicate, period, scope, unit and text of a side as they are compared."""
    a = {c: F.col(f"{x}_{c}") for c in _SIDES}

    def low(c: Column) -> Column:
        return F.lower(strip(c))

    scope = low(F.when(F.coalesce(a["scope"], F.lit("")) == "", "global").otherwise(a["scope"]))
    time, unit = (F.upper(strip(F.coalesce(a[c], F.lit("")))) for c in ("time_label", "unit"))
    return F.struct(low(a["subject"]).alias("s"), low(a["predicate"]).alias("p"), time.alias("t"), scope.alias("c"), unit.alias("u"), low(a["raw_value"]).alias("x"))


def relationship() -> Column:
    """struct<type, confidence, explanation, dimensions, tier, metadata> of a pair with sides a and b and these sides' ``plain`` in _a and _b; null if undecided."""
    a, b = ({c: F.col(f"{x}_{c}") for c in _SIDES} for x in "ab")
    (sa, pa, ta, ca, ua, xa), (sb, pb, tb, cb, ub, xb) = ([F.col(f"_{x}")[c] for c in ("s", "p", "t", "c", "u", "x")] for x in "ab")
    institutions = pa.isin(V.MACRO_METRICS) & any_of(sa, V.MACRO_INSTITUTIONS) & any_of(sb, V.MACRO_INSTITUTIONS)
    comparable = (pa == pb) & ((sa == sb) | sb.contains(sa) | sa.contains(sb) | institutions)
    other_time = (ta != "") & (tb != "") & (ta != tb)
    other_scope = (ca != cb) & (ca != "unspecified") & (cb != "unspecified")
    va, vb = a["normalized_value"], b["normalized_value"]
    numeric = va.isNotNull() & vb.isNotNull() & ((ua == ub) | (ua == "") | (ub == ""))
    gap = F.abs(va - vb) / F.greatest(F.abs(va), F.abs(vb), F.lit(1e-9))
    same_text = xa == xb

    def said(template: str, *values: Column) -> Column:
        return F.format_string(template, *[F.coalesce(v, F.lit("None")) for v in values])

    time_reason, scope_reason = said(V.TIME_REASON, ta, tb), said(V.SCOPE_REASON, ca, cb)
    period = F.when(F.coalesce(a["time_label"], F.lit("")) == "", "current").otherwise(a["time_label"])

    def decided(kind: str, confidence: float, dimensions: list[str], explanation: Column, **metadata: Column) -> Column:
        more = F.struct(F.lit(True).alias("entity_match"), F.lit(True).alias("predicate_match"), *[v.alias(k) for k, v in metadata.items()])
        return F.struct(
            F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence"), explanation.alias("explanation"), F.array(*map(F.lit, dimensions)).alias("supporting_dimensions"),
            F.lit("deterministic").alias("resolution_tier"), F.to_json(more).alias("reasoning_metadata"),
        )

    five = ["entity", "predicate", "time", "scope", "value"]
    return (
        F.when(~comparable, F.lit(None))
        .when(other_time, decided("CONTEXTUAL_DIFFERENCE", 0.96, ["entity", "predicate", "time"], said(V.EXPLAIN_TIME, time_reason), time_difference=time_reason, time_a=a["time_label"], time_b=b["time_label"]))
        .when(other_scope, decided("CONTEXTUAL_DIFFERENCE", 0.95, ["entity", "predicate", "scope"], said(V.EXPLAIN_SCOPE, scope_reason), scope_difference=scope_reason, scope_a=a["scope"], scope_b=b["scope"]))
        .when(numeric & (gap <= V.VALUE_TOLERANCE), decided("CORROBORATES", 0.98, five, said(V.EXPLAIN_SAME_VALUE, a["predicate"], a["raw_value"], a["subject"]), relative_difference=gap, value_a=va, value_b=vb))
        .when(numeric, decided("CONTRADICTS", 0.94, five, said(V.EXPLAIN_CONFLICT, a["raw_value"], b["raw_value"], a["subject"], period), conflict_type=F.lit("numerical_incompatibility"), value_a=va, value_b=vb))
        .when(same_text, decided("CORROBORATES", 0.97, ["entity", "predicate", "value"], said(V.EXPLAIN_SAME_TEXT, a["raw_value"], a["subject"]), text_exact_match=F.lit(True)))
    )


def tier1(sided: DataFrame) -> DataFrame:
    """Pairs with their relationship in ``r``; null where a judge has to decide."""
    return bind(bind(sided, _a=plain("a"), _b=plain("b")), r=relationship()).drop("_a", "_b")


def tier3(undecided: DataFrame, judge) -> DataFrame:
    """The judge's relationship for pairs the cascade leaves open. ``judge``: a provider (see sources.providers).

    Unknown types count as UNCERTAIN; a failing judge gives UNCERTAIN with confidence 0.5.
    """
    from ..sources.providers import judged

    return judged(undecided, judge)


def stored(resolved: DataFrame) -> DataFrame:
    """Relationship rows: id, fact_a_id, fact_b_id and the fields of ``r``. Uncertain and undecided pairs are not stored."""
    kept = resolved.where("r is not null and r.relationship_type <> 'UNCERTAIN'")
    return kept.select(F.sha2(F.concat_ws("|", "a_id", "b_id"), 256).substr(1, 32).alias("id"), F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "r.*")


def resolve(facts: DataFrame, targets: DataFrame | None = None, existing: DataFrame | None = None, judge=None, incremental: bool = True, strict: bool = False) -> DataFrame:
    """Relationships of ``targets`` (all facts by default) with facts of other documents. ``strict`` leaves flagged facts out."""
    from .pairs import candidate_pairs, dedup_pairs

    pool = facts.where("not coalesce(is_flagged, false)") if strict and "is_flagged" in facts.columns else facts
    own = pool if targets is None else targets
    return resolve_pairs(dedup_pairs(candidate_pairs(own, pool, incremental=incremental), existing), pool, judge)


def resolve_pairs(pairs: DataFrame, facts: DataFrame, judge=None) -> DataFrame:
    """Relationships of ``pairs`` (target, candidate) of ``facts``."""
    every = tier1(with_sides(pairs, facts))
    out = stored(every)
    return out if judge is None else out.unionByName(stored(tier3(every.where("r is null").drop("r"), judge)))


def replace_document(table: DataFrame, fresh: DataFrame, document_ids: DataFrame) -> DataFrame:
    """``table`` with the rows of the given documents replaced by ``fresh``."""
    return table.join(document_ids, "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def drop_edges(edges: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Edges that touch none of the given facts (column fact_id)."""
    gone = fact_ids.select("fact_id")
    return edges.join(gone, edges.fact_a_id == gone.fact_id, "left_anti").join(gone, edges.fact_b_id == gone.fact_id, "left_anti")
