"""Registry and the views all registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.operators.merge import with_identity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2026-06-01"
CODES = tuple(vocab.STATES)[:25]
SUFFIXES = (" Inc.", ", LLC", " Corporation", " Holdings Group", " dba Outlet")


def query(name: str, sql: str | None = None):
    """Register a query with its expected-result SQL."""

    def register(func):
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(index: Column, values: tuple) -> Column:
    """Pick a literal by a zero-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as filings of their customers: one canonical record per order."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    day = F.col("o_orderdate").cast("date")
    key = F.col("o_orderkey")
    rows = joined.select(
        key.alias("ix"),
        choose(F.col("n_nationkey"), CODES).alias("state"),
        F.concat("c_name", choose(key % 5, SUFFIXES)).alias("employer"),
        F.when(key % 7 != 0, F.initcap(F.lower("c_mktsegment"))).alias("city"),
        F.col("n_name").alias("county"),
        day.alias("notice_date"),
        F.when(key % 3 != 0, F.date_add(day, 60)).alias("effective_date"),
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 100).cast("int")).alias("employees"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Closure")
        .when(F.col("o_orderpriority") == "2-HIGH", "Layoff")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Closure and Layoff").alias("notice_type"),
        F.col("c_mktsegment").alias("industry"),
        F.col("o_orderpriority").alias("notes"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("https://filings.example.org/"), key.cast("string")).alias("source_url"),
    )
    return with_identity(rows)


_codes = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_suffixes = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"

FILINGS_SQL = f"""
filings AS (
  SELECT *, sha1(concat(state, '|', employer_key, '|', lower(coalesce(city, '')), '|',
      cast(notice_date AS VARCHAR), '|', coalesce(cast(effective_date AS VARCHAR), ''), '|',
      coalesce(cast(employees AS VARCHAR), ''))) AS hash
  FROM (
    SELECT o_orderkey AS ix,
      ({_codes})[n_nationkey + 1] AS state,
      c_name || ({_suffixes})[(o_orderkey % 5) + 1] AS employer,
      replace(lower(c_name), '#', ' ') AS employer_key,
      CASE WHEN o_orderkey % 7 <> 0
           THEN upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) END AS city,
      n_name AS county,
      cast(o_orderdate AS DATE) AS notice_date,
      CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_orderdate AS DATE) + 60 END AS effective_date,
      CASE WHEN o_orderstatus <> 'P' THEN cast(floor(o_totalprice / 100) AS INTEGER) END AS employees,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Closure' WHEN '2-HIGH' THEN 'Layoff'
           WHEN '3-MEDIUM' THEN 'Closure and Layoff' END AS notice_type,
      c_mktsegment AS industry, o_orderpriority AS notes, o_orderstatus AS status,
      'https://filings.example.org/' || o_orderkey AS source_url
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  )
)"""


def with_filings(body: str) -> str:
    return f"WITH {FILINGS_SQL}\n{body}"


def text_of(*names: str) -> list[Column]:
    """Dates and timestamps as ISO text, for results that cross engines."""
    return [F.col(n).cast("string").alias(n) for n in names]
