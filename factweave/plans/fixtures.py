"""Views of the engine's tables over the driver's Parquet tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import number, temporal
from ..operators.blocks import text_blocks
from ..session import spread

SEGMENT_NAMES = ("delhivery", "rbi-annual", "imf-article", "acme")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each segment, priority and year of orders: the priority is the document, the segment the subject."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    year = F.year("o_orderdate")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderpriority", year.alias("y")).agg(F.max("o_totalprice").alias("normalized_value"), F.min("o_orderdate").alias("created_at"))
    none = F.lit(None).cast("string")
    time = F.struct(F.concat(F.lit("FY"), F.col("y").cast("string")).alias("label"), none.alias("start"), none.alias("end"), F.lit("fiscal_year").alias("precision"))
    return g.select(
        F.concat_ws("|", "c_mktsegment", "o_orderpriority", "y").alias("fact_id"), F.col("o_orderpriority").alias("document_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("ingest_seq"), F.col("c_mktsegment").alias("subject"),
        F.lit("revenue").alias("predicate"), F.concat(F.lit("$"), F.floor("normalized_value").cast("string")).alias("raw_value"), "normalized_value", F.lit("USD").alias("unit"), time.alias("time_data"), F.lit("global").alias("scope"),
        F.element_at(F.array(*map(F.lit, (0.65, 0.85, 0.92, 0.98))), F.col("y") % 4 + 1).alias("confidence"), (F.col("y") % 7 == 0).alias("is_flagged"), "created_at",
    )


CLAIMS_SQL = """
claims AS (
  SELECT *, 'FY' || y AS time_label, 'revenue' AS predicate, '$' || CAST(CAST(floor(normalized_value) AS BIGINT) AS VARCHAR) AS raw_value, 'USD' AS unit, 'global' AS scope,
    CASE y % 4 WHEN 0 THEN 0.65 WHEN 1 THEN 0.85 WHEN 2 THEN 0.92 ELSE 0.98 END AS confidence, y % 7 = 0 AS is_flagged
  FROM (SELECT c_mktsegment || '|' || o_orderpriority || '|' || year(o_orderdate) AS fact_id, o_orderpriority AS document_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS ingest_seq,
          c_mktsegment AS subject, year(o_orderdate) AS y, max(o_totalprice) AS normalized_value, min(o_orderdate) AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority, year(o_orderdate)))"""


def _dealt(key, *options):
    """One of the options by the remainder of ``key``."""
    out = F.lit(options[-1])
    for i, x in reversed(list(enumerate(options[:-1]))):
        out = F.when(key % len(options) == i, x if isinstance(x, Column) else F.lit(x)).otherwise(out)
    return out


def varied_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each customer, thirty a document: subjects that equal, hold or miss each other, several predicates, periods, scopes and units."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k, nation = F.col("c_custkey"), F.col("n_name")

    def part(of: int):
        return F.floor(k / of)

    value = F.when(k % 9 != 0, F.floor(F.col("c_acctbal") / 1000).cast("double"))
    none = F.lit(None).cast("string")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("f"), k.cast("string")).alias("fact_id"), F.concat(F.lit("d"), part(30).cast("string")).alias("document_id"), part(30).cast("int").alias("ingest_seq"),
        _dealt(k, nation, F.concat(F.lit("Bank of "), nation), F.lower(nation), F.concat(nation, F.lit(" Ports")), "Reserve Bank of India", F.col("c_name"), F.concat(F.lit(" "), nation, F.lit(" ")), "International Monetary Fund").alias("subject"),
        _dealt(part(8), "revenue", "net_revenue", "repo_rate", "cpi_inflation", "employees", "Revenue").alias("predicate"),
        F.coalesce(F.concat(F.lit("$"), value.cast("long").cast("string")), F.lit("N/A")).alias("raw_value"), value.alias("normalized_value"), _dealt(part(5), "USD", "EUR", None).alias("unit"),
        F.struct(_dealt(part(7), "FY2023", "FY2024", "fy2024 ", None).alias("label"), none.alias("start"), none.alias("end"), none.alias("precision")).alias("time_data"), _dealt(part(3), "global", "US subsidiary", None, "unspecified").alias("scope"),
    )


VARIED_SQL = """
varied AS (
  SELECT *, '$' || CAST(CAST(normalized_value AS BIGINT) AS VARCHAR) AS dollars, coalesce(dollars, 'N/A') AS raw_value, lower(trim(subject)) AS s, lower(trim(predicate)) AS p FROM (
    SELECT 'f' || c_custkey AS fact_id, 'd' || (c_custkey // 30) AS document_id, c_custkey // 30 AS ingest_seq,
      CASE c_custkey % 8 WHEN 0 THEN n_name WHEN 1 THEN 'Bank of ' || n_name WHEN 2 THEN lower(n_name) WHEN 3 THEN n_name || ' Ports' WHEN 4 THEN 'Reserve Bank of India' WHEN 5 THEN c_name WHEN 6 THEN ' ' || n_name || ' ' ELSE 'International Monetary Fund' END AS subject,
      ['revenue', 'net_revenue', 'repo_rate', 'cpi_inflation', 'employees', 'Revenue'][c_custkey // 8 % 6 + 1] AS predicate, CASE WHEN c_custkey % 9 <> 0 THEN floor(c_acctbal / 1000) END AS normalized_value,
      ['USD', 'EUR', NULL][c_custkey // 5 % 3 + 1] AS unit, ['FY2023', 'FY2024', 'fy2024 ', NULL][c_custkey // 7 % 4 + 1] AS time_label, ['global', 'US subsidiary', NULL, 'unspecified'][c_custkey // 3 % 4 + 1] AS scope
    FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def crowded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each customer, twenty a document, all of one predicate: subjects that share words, hold each other or repeat."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k, nation = F.col("c_custkey"), F.col("n_name")
    numbered = F.concat_ws(" ", "c_mktsegment", nation, F.floor(k / 45).cast("string"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("f"), k.cast("string")).alias("fact_id"), F.concat(F.lit("d"), F.floor(k / 20).cast("string")).alias("document_id"), F.floor(k / 20).cast("int").alias("ingest_seq"),
        _dealt(k, F.col("c_name"), F.concat_ws(" ", nation, "c_name"), numbered).alias("subject"), F.lit("revenue").alias("predicate"), _dealt(F.floor(k / 7), "global", "US subsidiary", None).alias("scope"),
    )


CROWDED_SQL = """
crowded AS (
  SELECT *, lower(trim(subject)) AS s FROM (
    SELECT 'f' || c_custkey AS fact_id, c_custkey // 20 AS ingest_seq, 'revenue' AS predicate, ['global', 'US subsidiary', NULL][c_custkey // 7 % 3 + 1] AS scope,
      CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN n_name || ' ' || c_name ELSE c_mktsegment || ' ' || n_name || ' ' || (c_custkey // 45) END AS subject
    FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def claim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the claims: id, filename, status, page_count, created_at."""
    o = table(spark, sf_dir, "orders")
    seq = F.substring("id", 1, 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, SEGMENT_NAMES)), seq % 4 + 1)
    g = o.groupBy(F.col("o_orderpriority").alias("id")).agg(F.min("o_orderdate").alias("created_at"), F.count(F.lit(1)).alias("page_count"))
    return g.select("id", F.concat(name, F.lit("-"), F.col("id"), F.lit(".pdf")).alias("filename"), F.when(seq == 5, "failed").otherwise("completed").alias("status"), "page_count", "created_at")


DOCUMENTS_SQL = """
docs AS (
  SELECT id, CASE seq % 4 WHEN 0 THEN 'delhivery' WHEN 1 THEN 'rbi-annual' WHEN 2 THEN 'imf-article' ELSE 'acme' END || '-' || id || '.pdf' AS filename,
    CASE seq % 4 WHEN 0 THEN 'delhivery' WHEN 3 THEN 'synthetic' ELSE 'india-macroeconomy' END AS dataset, CASE WHEN seq = 5 THEN 'failed' ELSE 'completed' END AS status, page_count, created_at
  FROM (SELECT o_orderpriority AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS seq, min(o_orderdate) AS created_at, count(*) AS page_count FROM orders GROUP BY 1, 2))"""


def claim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each order, one page a month: document_id, page_number, block_index, id, block_type, text, bbox."""
    o, c = spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer")
    text = F.concat(F.col("c_name"), F.lit(" reported revenue of $"), F.floor("o_totalprice").cast("string"), F.lit(" million in FY"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ". All rights reserved.").when(F.col("o_orderkey") % 3 == 0, " with 500 employees.").otherwise("."))
    key = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderpriority").alias("document_id"), F.month("o_orderdate").alias("page_number"), key.alias("block_index"), key.cast("string").alias("id"), F.when(key % 11 == 0, "heading").otherwise("text").alias("block_type"), text.alias("text"),
        F.array(F.lit(50.0), F.lit(50.0), F.lit(500.0), F.lit(100.0)).alias("bbox"),
    )


TEXT_SQL = """
sentences AS (
  SELECT o_orderpriority AS document_id, month(o_orderdate) AS page_number, o_orderkey AS block_index, CASE WHEN o_orderkey % 11 = 0 THEN 'heading' ELSE 'text' END AS block_type,
    c_name || ' reported revenue of $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' million in FY' || year(o_orderdate) ||
      CASE WHEN o_orderkey % 5 = 0 THEN '. All rights reserved.' WHEN o_orderkey % 3 = 0 THEN ' with 500 employees.' ELSE '.' END AS text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-blank lines of documents as blocks."""
    return text_blocks(spread(table(spark, sf_dir, "documents")))


# White space for SQL patterns: RE2 has no class for all of Unicode's.
_WS = "\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}"
LINES_SQL = f"""
raw_lines AS (SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[{_WS}]+', '', 'g') <> '')) AS text, generate_subscripts(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[{_WS}]+', '', 'g') <> ''), 1) - 1 AS block_index FROM documents),
trimmed AS (SELECT *, regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS t FROM raw_lines),
blocks AS (SELECT doc_id AS document_id, block_index, text, t,
  CASE WHEN t = '' THEN 'text'
       WHEN length(t) < 80 AND NOT regexp_matches(t, '[.:;]$') AND regexp_matches(t, '\\p{{Lu}}') AND (NOT regexp_matches(t, '\\p{{Ll}}') OR (NOT regexp_matches(t, '\\p{{L}}\\p{{Lu}}') AND NOT regexp_matches(t, '(^|\\P{{L}})\\p{{Ll}}'))) THEN 'heading'
       WHEN regexp_matches(t, '^(\\*|-|•|\\p{{Nd}}+[.)])[{_WS}]+') THEN 'list' ELSE 'text' END AS block_type
  FROM trimmed)"""


def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each priority: a row for each segment, a column for each year, the largest price in it."""
    c = claims(spark, sf_dir)
    years = sorted(r.y for r in table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect())  # a column each
    cell = [F.max(F.when(F.col("time_data.label") == f"FY{y}", F.floor("normalized_value").cast("string"))).alias(f"y{y}") for y in years]
    rows = c.groupBy("document_id", "subject").agg(*cell)
    row = F.array(F.concat(F.lit("Total revenue "), F.col("subject")), *[F.coalesce(F.col(f"y{y}"), F.lit("-")) for y in years])
    t = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    head = F.array(F.lit("Particulars"), *[F.lit(f"FY{y}") for y in years])
    return t.select(
        "document_id", F.lit("report.pdf").alias("filename"), F.lit(1).alias("page_number"), F.concat("document_id", F.lit("_t0")).alias("block_id"), F.lit(0).alias("block_index"), F.lit("table").alias("block_type"), F.lit("").alias("text"),
        F.array(*[F.lit(0.0)] * 4).alias("bbox"), F.struct(head.alias("headers"), F.col("rows")).alias("table_data"),
    )


def callout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of three lines for each order: a metric, its number, a second number."""
    o = spread(table(spark, sf_dir, "orders"))
    metric = F.when(F.col("o_orderkey") % 3 == 0, "Total revenue").when(F.col("o_orderkey") % 3 == 1, "Repo rate").otherwise("Other items")
    text = F.concat(metric, F.lit("\n$"), F.floor("o_totalprice").cast("string"), F.lit(" million\nQ1 "), F.year("o_orderdate").cast("string"))
    return o.select(
        F.col("o_orderpriority").alias("document_id"), F.lit("report.pdf").alias("filename"), F.lit(1).alias("page_number"), F.col("o_orderkey").cast("string").alias("block_id"), F.col("o_orderkey").alias("block_index"), F.lit("text").alias("block_type"),
        text.alias("text"), F.array(*[F.lit(0.0)] * 4).alias("bbox"),
    )


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of the numbers of order lines: page_id, box_id, bbox, is_table (every seventh)."""
    l = spread(table(spark, sf_dir, "lineitem"))
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return l.select((F.col("l_orderkey") % 997).alias("page_id"), key.alias("box_id"), F.array(x, y, x + F.col("l_quantity"), y + 20.0).alias("bbox"), (key % 7 == 0).alias("is_table"))


BOXES_SQL = """
boxes AS (SELECT l_orderkey % 997 AS page_id, l_orderkey * 10 + l_linenumber AS box_id, CAST(l_partkey % 50 AS DOUBLE) AS x0, CAST(l_suppkey % 50 AS DOUBLE) AS y0,
  CAST(l_partkey % 50 AS DOUBLE) + l_quantity AS x1, CAST(l_suppkey % 50 AS DOUBLE) + 20.0 AS y1, (l_orderkey * 10 + l_linenumber) % 7 = 0 AS is_table FROM lineitem)"""


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, periods, entities and predicates in many spellings, made of orders: key, amount, period, name, predicate, filename."""
    o = spread(table(spark, sf_dir, "orders"))
    k, whole, year = F.col("o_orderkey"), F.floor("o_totalprice").cast("string"), F.year("o_orderdate").cast("string")

    def pick(*options):
        out = options[-1]
        for i, x in reversed(list(enumerate(options[:-1]))):
            out = F.when(k % len(options) == i, x).otherwise(out)
        return out

    return o.select(
        k.alias("key"),
        pick(F.concat(F.lit("$"), whole), F.concat(whole, F.lit(" million USD")), F.concat(F.lit("("), whole, F.lit(")")), F.concat(F.lit("-"), whole, F.lit(" employees")), F.concat(F.lit("€"), whole, F.lit("k")), F.concat(whole, F.lit(" crore")), F.lit("n/a")).alias("amount"),
        pick(F.concat(F.lit("FY"), year), year, F.concat(F.lit("Q3 "), year), F.concat(F.lit("as of "), F.lit("March")), F.lit("annual")).alias("period"),
        pick(F.lit("Acme Corp."), F.lit("Acme Inc."), F.lit("Beta Limited"), F.lit("The RBI bulletin"), F.lit("Gamma LLC")).alias("name"),
        pick(F.lit("Total Revenue"), F.lit("net_sales"), F.lit("Head-Office"), F.lit("gross sales"), F.lit("something else")).alias("predicate"),
        pick(F.lit("Delhivery-2022.pdf"), F.lit("rbi.pdf"), F.lit("Economic-Survey.pdf"), F.lit("other.pdf")).alias("filename"),
    )


STRINGS_SQL = """
strings AS (SELECT o_orderkey AS key,
  CASE o_orderkey % 7 WHEN 0 THEN '$' || w WHEN 1 THEN w || ' million USD' WHEN 2 THEN '(' || w || ')' WHEN 3 THEN '-' || w || ' employees' WHEN 4 THEN '€' || w || 'k' WHEN 5 THEN w || ' crore' ELSE 'n/a' END AS amount,
  CASE o_orderkey % 5 WHEN 0 THEN 'FY' || y WHEN 1 THEN y WHEN 2 THEN 'Q3 ' || y WHEN 3 THEN 'as of March' ELSE 'annual' END AS period,
  CASE o_orderkey % 5 WHEN 0 THEN 'Acme Corp.' WHEN 1 THEN 'Acme Inc.' WHEN 2 THEN 'Beta Limited' WHEN 3 THEN 'The RBI bulletin' ELSE 'Gamma LLC' END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'Total Revenue' WHEN 1 THEN 'net_sales' WHEN 2 THEN 'Head-Office' WHEN 3 THEN 'gross sales' ELSE 'something else' END AS predicate,
  CASE o_orderkey % 4 WHEN 0 THEN 'Delhivery-2022.pdf' WHEN 1 THEN 'rbi.pdf' WHEN 2 THEN 'Economic-Survey.pdf' ELSE 'other.pdf' END AS filename
  FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS w, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders))"""


def parsed_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strings(spark, sf_dir)
    return s.select("*", number(F.col("amount")).alias("n"), temporal(F.col("period")).alias("t"))
