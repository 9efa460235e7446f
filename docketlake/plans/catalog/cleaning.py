"""Cell cleaners on values built from, or found in, the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.category import classify_type, title_case
from docketlake.functions.dates import iso_text, month_number, month_start, parse_date, parse_date_number
from docketlake.functions.numbers import count_from_number, date_param, first_count, int_param, parse_count
from docketlake.functions.places import address_zip, embedded_state, is_full_address, strip_state
from docketlake.functions.text import (
    clean_text, clean_zip, drop_bare_code, employer_key, split_list, state_codes, thousands,
)
from docketlake.plans.catalog.base import AS_OF, CODES, choose, query, table


def _s(name: str):
    return F.col(name).cast("string")


@query("count_parse", """
WITH cells AS (
  SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN format('{:,}', cast(floor(o_totalprice) AS BIGINT)) || ' employees'
    WHEN 1 THEN cast(o_custkey AS VARCHAR) || '-' || cast(o_custkey + 25 AS VARCHAR)
    WHEN 2 THEN 'approx. ' || cast(o_totalprice AS VARCHAR)
    WHEN 3 THEN 'N/A' WHEN 4 THEN cast(o_custkey AS VARCHAR) || '.5 or 9999999'
    ELSE o_orderpriority END AS cell FROM orders),
nums AS (SELECT o_orderkey, cell, list_filter(list_transform(
    regexp_extract_all(cell, '\\d[\\d,]*(?:\\.\\d+)?'),
    lambda x: cast(round_even(cast(replace(x, ',', '') AS DOUBLE), 0) AS BIGINT)), lambda v: v BETWEEN 0 AND 500000) AS n
  FROM cells)
SELECT o_orderkey, cell, list_max(n) AS parsed FROM nums""")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    cust = _s("o_custkey")
    cell = (
        F.when(key % 6 == 0, F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" employees")))
        .when(key % 6 == 1, F.concat(cust, F.lit("-"), (F.col("o_custkey") + 25).cast("string")))
        .when(key % 6 == 2, F.concat(F.lit("approx. "), _s("o_totalprice")))
        .when(key % 6 == 3, "N/A")
        .when(key % 6 == 4, F.concat(cust, F.lit(".5 or 9999999")))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", cell.alias("cell"), parse_count(cell).cast("bigint").alias("parsed")
    )


@query("first_count", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey <= 500000 THEN l_orderkey END AS first,
  CASE WHEN round_even(l_extendedprice, 0) BETWEEN 0 AND 500000
       THEN cast(round_even(l_extendedprice, 0) AS BIGINT) END AS whole
FROM lineitem""")
def first_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), _s("l_orderkey"), F.lit(" EFFECTIVE "), F.col("l_shipdate").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", first_count(text).cast("bigint").alias("first"),
        count_from_number("l_extendedprice").cast("bigint").alias("whole"),
    )


@query("date_parse", """
SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 9 THEN NULL
  WHEN o_orderkey % 12 = 11 THEN cast(date_trunc('month', o_orderdate) AS DATE)::VARCHAR
  ELSE cast(o_orderdate AS DATE)::VARCHAR END AS parsed FROM orders""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 12
    fmt = lambda f: F.date_format(day, f)
    cell = (
        F.when(key == 0, fmt("M/d/yyyy")).when(key == 1, fmt("MM/dd/yyyy")).when(key == 2, fmt("yyyy-MM-dd"))
        .when(key == 3, fmt("MMMM d, yyyy")).when(key == 4, fmt("d-MMM-yy")).when(key == 5, fmt("MMM d yyyy"))
        .when(key == 6, fmt("yyyy-MM-dd'T'HH:mm:ss.SSS")).when(key == 7, fmt("yyyyMMdd"))
        .when(key == 8, F.concat(fmt("M/d/yy"), F.lit(" - "), F.date_format(F.date_add(day, 90), "M/d/yy")))
        .when(key == 9, F.concat(F.lit("Various "), fmt("yyyy")))
        .when(key == 10, F.concat(fmt("EEEE, "), F.lit("beginning "), fmt("M/d/yyyy"), F.lit(" 10:30 am")))
        .otherwise(fmt("MMMM yyyy"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parse_date(cell, AS_OF).cast("string").alias("parsed")
    )


@query("date_numbers", """
SELECT l_orderkey, l_linenumber, cast(l_shipdate AS DATE)::VARCHAR AS packed, cast(l_shipdate AS DATE)::VARCHAR AS serial,
  CASE WHEN l_partkey BETWEEN 32000 AND 60000 AND year(DATE '1899-12-30' + cast(l_partkey AS INTEGER)) BETWEEN 1988 AND 2029
       THEN cast(DATE '1899-12-30' + cast(l_partkey AS INTEGER) AS VARCHAR) END AS loose
FROM lineitem""")
def date_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    packed = F.date_format(day, "yyyyMMdd").cast("double")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        *[parse_date_number(c, AS_OF).cast("string").alias(n)
          for n, c in (("packed", packed), ("serial", serial), ("loose", F.col("l_partkey")))],
    )


@query("month_dates", """
SELECT o_orderkey, month(o_orderdate) AS month_no, cast(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS first_day
FROM orders""")
def month_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = month_number(F.date_format("o_orderdate", "MMMM"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", number.cast("bigint").alias("month_no"),
        month_start(F.year("o_orderdate"), number).cast("string").alias("first_day"),
    )


_KEY_SUFFIXES = (" Inc.", ", LLC", " Corporation", " Holdings Group Inc", " d/b/a The Other Shop", " & Sons", ", L.L.C.",
                 " FKA Old Name", " Café", " Company")


@query("employer_key", """
SELECT c_custkey, replace(lower(c_name), '#', ' ') || ([
  '', '', '', '', '', ' and sons', ' l l c', '', ' cafe', ''])[(c_custkey % 10) + 1] AS employer_key
FROM customer""")
def employer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", choose(F.col("c_custkey") % 10, _KEY_SUFFIXES))
    return table(spark, sf_dir, "customer").select("c_custkey", employer_key(name).alias("employer_key"))


_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"


@query("text_key", f"""
WITH k AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(strip_accents(
    regexp_replace(lower(nfc_normalize(text)), '([{_MARKED}])', '\\1 ', 'g'))),
    '\\b(?:d/?b/?a|f/?k/?a)\\b.*$', ' '), '&', ' and ', 'g') AS t FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')),
    '(?: (?:inc|llc|ltd|corp|corporation|co|company|lp|llp|plc|pllc|pc|holdings|group)){{1,3}}$', '')) AS employer_key
FROM k""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", employer_key("text").alias("employer_key"))


_TYPE_RULES = """
  CASE WHEN trim(blob) = '' THEN NULL WHEN c AND l THEN 'Closure and Layoff' WHEN c THEN 'Closure'
       WHEN l THEN 'Layoff' END"""


@query("type_classify", f"""
WITH blobs AS (SELECT doc_id, lower(text) AS blob,
  regexp_matches(lower(text), 'clos|shut|cessation|terminat\\w*\\s+of\\s+oper|dissolv') AS c,
  regexp_matches(lower(text), 'lay\\s*-?\\s*off|layoff|reduction|rif|downsiz|furlough|separation') AS l FROM documents)
SELECT doc_id, {_TYPE_RULES.strip()} AS kind FROM blobs""")
def type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = classify_type("text")
    named = F.when(kind.isin("Closure", "Layoff", "Closure and Layoff"), kind)
    return table(spark, sf_dir, "documents").select("doc_id", named.alias("kind"))


@query("type_codes", """
SELECT p_partkey, (['Closure', 'Layoff', 'Closure and Layoff', 'Closure', 'Layoff', NULL, 'Closure', 'Layoff'])[(p_partkey % 8) + 1]
  AS kind, upper(split_part(p_name, ' ', 1)[1:1]) || split_part(p_name, ' ', 1)[2:] || '-' ||
  upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS titled FROM part""")
def type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = choose(F.col("p_partkey") % 8, ("CL", "lo", " CL/LO ", "c", "L", " ", "Plant Closing", "Reduction in Force"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", classify_type(cell).alias("kind"),
        title_case(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))).alias("titled"),
    )


@query("zip_city", f"""
WITH x AS (SELECT c_custkey, ({[*CODES]})[c_nationkey + 1] AS code, lpad(cast(c_custkey % 100000 AS VARCHAR), 5, '0') AS z,
  upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS town FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN NULL ELSE town END AS city,
  CASE WHEN c_custkey % 4 IN (0, 2) THEN NULL WHEN c_custkey % 4 = 1 THEN code END AS code,
  CASE WHEN c_custkey % 4 = 2 THEN '12 Main St ' || town || ', ' || code || ' ' || z || '-0001' END AS address,
  CASE WHEN c_custkey % 4 = 2 THEN z END AS zip, z AS clean, CASE WHEN c_custkey % 2 = 0 THEN town END AS industry
FROM x""")
def zip_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    code = choose(F.col("c_nationkey"), CODES)
    town = F.initcap(F.lower("c_mktsegment"))
    digits = F.lpad((key % 100000).cast("string"), 5, "0")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", digits.alias("z"), town.alias("town"),
        F.when(key % 4 == 1, F.concat(town, F.lit(", "), code))
        .when(key % 4 == 2, F.concat(F.lit("12 Main St "), town, F.lit(", "), code, F.lit(" "), digits, F.lit("-0001")))
        .when(key % 4 == 3, town).otherwise(town).alias("cell"),
    )
    whole = is_full_address("cell")
    return rows.select(
        "c_custkey",
        F.when(~whole, strip_state("cell")).alias("city"),
        embedded_state("cell").alias("code"),
        F.when(whole, F.col("cell")).alias("address"),
        F.when(whole, address_zip("cell")).alias("zip"),
        clean_zip(F.concat(F.lit("zip "), "z", F.lit("-1234"))).alias("clean"),
        drop_bare_code(F.when(key % 2 == 0, F.col("town")).otherwise(F.col("z"))).alias("industry"),
    )


_WS = r"[\s\x0b\x1c-\x1f\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}]+"


@query("clean_text", f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{{200b}}\\x{{feff}}]', '', 'g'),
  '{_WS}', ' ', 'g')) AS cleaned FROM documents)
SELECT doc_id, CASE WHEN lower(cleaned) NOT IN ('', 'n/a', 'na', 'none', 'null', 'nan', '-', '.', '*', 'tbd', 'unknown')
  THEN cleaned END AS cleaned FROM t""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", clean_text("text", max_length=1 << 30).alias("cleaned")
    )


@query("clean_text_exact", f"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(nfc_normalize(text), '{_WS}', ' ', 'g')) AS cleaned FROM conversations)
SELECT conv_id, turn, CASE WHEN cleaned <> '' THEN cleaned END AS cleaned FROM t""")
def clean_texts_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", clean_text("text", unicode="exact").alias("cleaned")
    )


@query("placeholders", """
SELECT event_id, CASE WHEN event_id % 5 IN (1, 3) THEN event_type END AS cell FROM events""")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    cell = (
        F.when(F.col("event_id") % 5 == 0, " N/A ").when(F.col("event_id") % 5 == 1, F.concat(F.lit(" \t"), kind, F.lit("\n")))
        .when(F.col("event_id") % 5 == 2, "To Be  Determined").when(F.col("event_id") % 5 == 3, F.concat(F.lit(" "), kind))
        .otherwise("---")
    )
    return table(spark, sf_dir, "events").select("event_id", clean_text(cell).alias("cell"))


@query("list_parse", """
SELECT s_suppkey, upper(s_name) || ';' || cast(s_nationkey AS VARCHAR) AS items,
  CASE WHEN s_suppkey % 2 = 0 THEN 'MD|' || cast(s_suppkey AS VARCHAR) END AS codes FROM supplier""")
def list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("s_name"), F.lit(",, "), _s("s_nationkey"), F.lit(" ,"))
    typed = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("md "), _s("s_suppkey"))).otherwise("All")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array_join(split_list(raw, "upper"), ";").alias("items"),
        F.array_join(state_codes(typed), "|").alias("codes"),
    )


@query("param_parse", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS n,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS DATE)::VARCHAR END AS day FROM orders""")
def param_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    number = F.when(key % 2 == 0, _s("o_custkey")).otherwise(F.concat(_s("o_custkey"), F.lit("x")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(key % 3 == 0, day).when(key % 3 == 1, "2024-13-45").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", int_param(number).cast("bigint").alias("n"), iso_text(date_param(text)).alias("day")
    )


@query("display_text", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '—' ELSE format('{:,}', l_partkey * 37) END AS shown,
  strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem""")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("l_returnflag") != "R", F.col("l_partkey") * 37)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", thousands(n).alias("shown"), iso_text("l_shipdate").alias("day")
    )
