"""Payload classification, JSON payloads, links and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.plans import ingest
from docketlake.plans.catalog.base import AS_OF, CODES, ORACLES, choose, filings, query, table, with_filings
from docketlake.plans.catalog.framing import _shown, files, pages
from docketlake.sources import links
from docketlake.sources.json_rows import flat_cells, json_rows, positional_records
from docketlake.sources.payload import payload_kind, payload_text


@query("payload_kind_tables", """
SELECT 'pages' AS origin, page_id AS id, 'html' AS kind FROM pages
UNION ALL SELECT 'events', event_id, 'json' FROM events""")
def payload_kind_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"), "url"
    )
    api = table(spark, sf_dir, "events").select(
        F.lit("events").alias("origin"), F.col("event_id").alias("id"), F.col("props").alias("body"),
        F.lit("https://e.example.org/events").alias("url"),
    )
    return web.unionAll(api).select("origin", "id", payload_kind(F.col("body").cast("binary"), "url").alias("kind"))


_KINDS = ("pdf", "xlsx", "xls", "csv", "xlsx", "xls", "pdf", "json", "csv", "csv", "json", "csv", "html", "html")


@query("payload_kind", f"SELECT o_orderkey, ({[*_KINDS]})[(o_orderkey % 14) + 1] AS kind FROM orders")
def payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    n = key % 14
    line = F.concat_ws(",", "o_orderstatus", F.col("o_custkey").cast("string"), "o_orderpriority")
    body = (
        F.when(n == 0, F.concat(F.unhex(F.lit("25504446")), line.cast("binary")))
        .when(n == 1, F.concat(F.unhex(F.lit("504B0304")), line.cast("binary")))
        .when(n == 2, F.concat(F.unhex(F.lit("D0CF11E0")), line.cast("binary")))
        .when(n == 11, F.concat(F.lit("a,b,c\r\n"), line, F.lit("\n\nx,y,z\n")).cast("binary"))
        .when(n == 12, F.concat(F.lit("a,b,c\n1,2\n"), line).cast("binary"))
        .when(n == 10, F.concat(F.lit(" \n["), F.to_json(F.array("o_orderpriority"))).cast("binary"))
        .otherwise(line.cast("binary"))
    )
    url = F.concat(F.lit("https://p.example.org/"), choose(n, (
        "a.csv", "b", "c.json", "d.CSV?x=1", "e.xlsm", "f.xls", "g", "h.json", "i?format=csv", "j?tqx=out:csv", "k", "l", "m", "n")))
    ctype = F.when(n == 6, "Application/PDF; q=1").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", payload_kind(body, url, ctype).alias("kind"))


@query("payload_text", "SELECT doc_id, text FROM documents")
def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", payload_text(marked).alias("text"))


@query("payload_latin1", "SELECT p_partkey, p_name || ' café' AS text FROM part")
def payload_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("20636166E9")))
    return table(spark, sf_dir, "part").select("p_partkey", payload_text(body).alias("text"))


# --------------------------------------------------------------------------
# JSON
# --------------------------------------------------------------------------

API_ROWS = 50


def api_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers: rows under ``body.results``, nested site, numeric dates, a tag list."""
    day = F.col("notice_date")
    row = F.struct(
        F.col("employer").alias("company"),
        F.struct(F.col("city").alias("city"), F.struct(F.col("county").alias("county")).alias("area")).alias("site"),
        F.when(F.col("ix") % 2 == 0, F.datediff(day, F.lit("1899-12-30").cast("date")))
        .otherwise(F.date_format(day, "yyyyMMdd").cast("int")).alias("notice_date"),
        F.date_format("effective_date", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("effective_date"),
        (F.col("employees") + 0.5).alias("workers"),
        F.array(F.lit(" a "), F.lit(None), F.lit("n/a"), F.col("status")).alias("remarks"),
    )
    doc = F.floor(F.col("ix") / API_ROWS)
    packed = filings(spark, sf_dir).select(doc.alias("doc"), "ix", row.alias("row")).groupBy("doc").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ix", F.to_json("row").alias("json")))), lambda r: r["json"]).alias("rows")
    )
    text = F.concat(F.lit('{"n": 1, "body": [{"ignored": []}, {"info": {"a": 1}, "none": [], "results": ['),
                    F.array_join("rows", ", "), F.lit("]}]}"))
    return packed.select(
        F.col("doc").cast("string").alias("doc_id"), text.alias("text"),
        choose(F.col("doc") % 25, CODES).alias("state"), F.lit("api").alias("source_name"),
        F.concat(F.lit("https://a.example.org/"), F.col("doc").cast("string")).alias("source_url"),
    )


@query("json_rows", with_filings(f"""
SELECT cast(ix // {API_ROWS} AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY ix // {API_ROWS} ORDER BY ix) - 1 AS row_ix,
  employer AS company FROM filings"""))
def json_row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_rows(api_payloads(spark, sf_dir), ("body", "1"))
    return rows.select("doc_id", F.col("row_ix").cast("bigint").alias("row_ix"),
                       F.get_json_object("record", "$.company").alias("company"))


@query("json_flatten", with_filings("""
SELECT employer, array_to_string(list_filter(['company=' || employer, 'site_area_county=' || county,
  CASE WHEN city IS NOT NULL THEN 'site_city=' || city END, 'remarks=a, , , ' || status], lambda x: x IS NOT NULL), '|') AS flat
FROM filings"""))
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_rows(api_payloads(spark, sf_dir), ("body", "1"))
    shown = F.transform(
        F.filter(flat_cells("record"), lambda e: e["key"].isin("company", "site_city", "site_area_county", "remarks")),
        lambda e: F.concat(e["key"], F.lit("="), e["s"]),
    )
    return rows.select(F.get_json_object("record", "$.company").alias("employer"), F.array_join(shown, "|").alias("flat"))


@query("event_props", "SELECT event_id, cast(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get(flat_cells("props"), F.lit(0))["n"].alias("k"))


_API_RECORDS = f"""SELECT cast(ix // {API_ROWS} AS VARCHAR) AS doc_id, employer, city, cast(notice_date AS VARCHAR) AS notice_date,
  cast(effective_date AS VARCHAR) AS effective_date, cast(round_even(employees + 0.5, 0) AS INTEGER) AS employees,
  ({[*CODES]})[((ix // {API_ROWS}) % 25) + 1] AS state, ({[vocab.STATES[c] for c in CODES]})[((ix // {API_ROWS}) % 25) + 1] AS state_name,
  'https://a.example.org/' || ix // {API_ROWS} AS source_url FROM filings"""


@query("records_from_json", with_filings(_API_RECORDS))
def records_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ingest.records_from_json(api_payloads(spark, sf_dir), AS_OF, ("body", "1")), "doc_id")


@query("positional_json", """
SELECT o_orderkey AS doc_id, 'Company|Column B|column_2' AS headers,
  'Customer ' || o_custkey || '|' || o_orderpriority || ' x|' || o_orderstatus AS cells FROM orders""")
def positional_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.array(F.array(
        F.concat(F.lit("<b>Customer</b> "), F.col("o_custkey").cast("string")),
        F.concat(F.col("o_orderpriority"), F.lit("<br/>x ")), F.col("o_orderstatus"),
    )))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))
    out = positional_records(docs, ("Company", "Column B"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array_join("headers", "|").alias("headers"),
                      F.array_join("cells", "|").alias("cells"))


# --------------------------------------------------------------------------
# Links
# --------------------------------------------------------------------------


@query("anchors", r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS text FROM pages)
SELECT page_id, href, trim(text) AS text, regexp_extract(url, '^[a-z]+://[^/]*') || href AS link FROM a WHERE href <> ''""")
def anchor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.anchors(table(spark, sf_dir, "pages"), "page_id")
    return found.select(F.col("doc_id").alias("page_id"), "href", "text", links.absolute_url("url", "href").alias("link"))


LINK_ROWS = 20
_LINK_TEXTS = ("Notices report", "Open XLSX file, layoff report", "Rapid response guide", "Customer", "Filing")


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing pages: one list item per order, linking files in five different ways."""
    key = F.col("o_orderkey")
    k, year, cust = key.cast("string"), F.year("o_orderdate") + 20, F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "M-d-yy")
    y = year.cast("string")
    item = (
        F.when(key % 5 == 0, F.concat(F.lit('<a class="x" href="/files/'), y, F.lit("/notices_"), k, F.lit('.csv">Notices report</a>')))
        .when(key % 5 == 1, F.concat(F.lit("<a href='../get?id="), k, F.lit("&amp;y="), y, F.lit("'>Open <b>XLSX</b> file, layoff report</a>")))
        .when(key % 5 == 2, F.concat(F.lit('<a href="#top">Notices</a><a href="/warn/'), y, F.lit("/list_"), k, F.lit('">Notices '), y, F.lit("</a>")))
        .when(key % 5 == 3, F.concat(F.lit('<a href="/up/'), y, F.lit("/"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lit("/layoff_"), k,
                                     F.lit('.pdf">Customer '), cust, F.lit(" Works</a>")))
        .otherwise(F.concat(F.lit('<a href="https://cdn.example.org/layoff_'), k, F.lit('.pdf">Customer '), cust, F.lit(" Notice "), day, F.lit("</a>")))
    )
    beside = F.when((key % 5 == 3) & (key % 2 == 0), F.concat(F.lit(" - "), F.date_format("o_orderdate", "M/d/yy"), F.lit(" Revised"))).otherwise("")
    rows = table(spark, sf_dir, "orders").select(
        F.floor(key / LINK_ROWS).alias("doc"), "o_orderkey", F.concat(F.lit("<li>"), item, beside, F.lit("</li>")).alias("li")
    )
    return rows.groupBy("doc").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "li"))), lambda r: r["li"]), "\n").alias("items")
    ).select(
        F.col("doc").alias("doc_id"), F.concat(F.lit("https://l.example.org/a/b/"), F.col("doc").cast("string")).alias("url"),
        F.concat(F.lit("<ul>"), "items", F.lit('</ul><script>var u="https://cdn.example.org/raw/'), F.col("doc").cast("string"),
                 F.lit('.csv\\", v="https://cdn.example.org/raw/'), F.col("doc").cast("string"), F.lit('.csv";</script>')).alias("html"),
    )


_LINKS_SQL = f"""
WITH l AS (SELECT o_orderkey AS k, o_orderkey // {LINK_ROWS} AS doc_id, year(o_orderdate) + 20 AS y, o_custkey, o_orderdate FROM orders),
d AS (
  SELECT doc_id, k, 'https://l.example.org/files/' || y || '/notices_' || k || '.csv' AS link, '.csv' AS extension, y AS year FROM l WHERE k % 5 = 0
  UNION ALL SELECT doc_id, k, 'https://l.example.org/a/get?id=' || k || '&y=' || y, '.xlsx', y FROM l WHERE k % 5 = 1
  UNION ALL SELECT doc_id, k, 'https://l.example.org/up/' || y || '/' || lpad(cast(month(o_orderdate) AS VARCHAR), 2, '0') || '/layoff_' || k || '.pdf', '.pdf', y FROM l WHERE k % 5 = 3
  UNION ALL SELECT doc_id, k, 'https://cdn.example.org/layoff_' || k || '.pdf', '.pdf', NULL FROM l WHERE k % 5 = 4),
ranked AS (SELECT doc_id, link, extension,
  greatest(CASE WHEN year BETWEEN 2000 AND 2027 THEN year END,
    (SELECT max(cast(x AS INTEGER)) FROM (SELECT unnest(regexp_extract_all(link, '20\\d{{2}}')) AS x) WHERE cast(x AS INTEGER) BETWEEN 2000 AND 2027)) AS year, k FROM d)
"""


def _found(spark: SparkSession, sf_dir: str, context: bool = False) -> DataFrame:
    return links.anchors(link_pages(spark, sf_dir), context=context)


@query("data_links", _LINKS_SQL + """SELECT doc_id, link, extension, year,
  row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(year, 0) DESC, extension IN ('.xlsx', '.csv') DESC, k) AS rank FROM ranked""")
def data_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.data_links(_found(spark, sf_dir), AS_OF).select("doc_id", "link", "extension", "year", "rank")


@query("link_filter", _LINKS_SQL + """SELECT doc_id, link FROM (SELECT doc_id, link,
  row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(year, 0) DESC, extension IN ('.xlsx', '.csv') DESC, k) AS nth
  FROM ranked WHERE contains(link, 'layoff') OR extension = '.xlsx') WHERE nth <= 4""")
def link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.data_links(_found(spark, sf_dir), AS_OF)
    return links.filter_links(found, "LAYOFF", 4).select("doc_id", "link")


@query("year_links", _LINKS_SQL + """, hay AS (
  SELECT doc_id, 'https://l.example.org/warn/' || y || '/list_' || k AS link, 'Notices ' || y || ' /warn/' || y || '/list_' || k AS text FROM l WHERE k % 5 = 2
  UNION ALL SELECT doc_id, 'https://l.example.org/a/get?id=' || k || '&y=' || y, 'get?id=' || k || '&y=' || y FROM l WHERE k % 5 = 1)
SELECT doc_id, link, max(year) AS year FROM (SELECT doc_id, link, unnest(list_filter(list_transform(
  regexp_extract_all(text, '20\\d{2}'), lambda x: cast(x AS INTEGER)), lambda v: v BETWEEN 2018 AND 2027)) AS year FROM hay) GROUP BY ALL""")
def year_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.year_links(_found(spark, sf_dir), AS_OF, 2018)


@query("embedded_urls", f"""SELECT DISTINCT o_orderkey // {LINK_ROWS} AS doc_id,
  'https://cdn.example.org/raw/' || o_orderkey // {LINK_ROWS} || '.csv' AS link FROM orders""")
def embedded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.embedded_urls(link_pages(spark, sf_dir)).select("doc_id", "link")


@query("link_filings", f"""
WITH f AS (SELECT o_orderkey AS k, o_orderkey // {LINK_ROWS} AS doc_id, year(o_orderdate) + 20 AS y,
  'Customer' || CASE WHEN o_custkey BETWEEN 1000 AND 9999 THEN '' ELSE ' ' || o_custkey END ||
    CASE WHEN o_orderkey % 5 = 3 THEN ' Works' ELSE '' END AS employer,
  CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 2 = 0 THEN cast(o_orderdate AS DATE)
    ELSE make_date(year(o_orderdate) + 20, month(o_orderdate), 1) END AS day FROM orders WHERE o_orderkey % 5 IN (3, 4))
SELECT doc_id, employer, cast(day AS VARCHAR) AS notice_date FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lower(employer), day ORDER BY k) AS nth FROM f) WHERE nth = 1""")
def link_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links.filings_from_links(_found(spark, sf_dir, context=True), AS_OF, ("doc_id",))
    return out.select("doc_id", "employer", F.col("notice_date").cast("string").alias("notice_date"))


# --------------------------------------------------------------------------
# Routing
# --------------------------------------------------------------------------


@query("route_payloads", "SELECT doc_id, employer, notice_date FROM ("
       + ORACLES["records_from_pages"] + ") UNION ALL SELECT doc_id, employer, notice_date FROM (" + ORACLES["records_from_csv"]
       + ") UNION ALL SELECT doc_id, employer, notice_date FROM (" + with_filings(_API_RECORDS) + ")")
def route_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, files and JSON answers in one landed table; half the files hang off barren pages."""
    def landed(df: DataFrame, body: str, ctype: str = "") -> DataFrame:
        return df.select(
            "doc_id", F.col("source_url").alias("url"), F.col(body).cast("binary").alias("content"),
            F.lit(ctype).alias("content_type"), F.lit(200).alias("status"),
            "state", "source_name", "source_url",
        )

    docs = files(spark, sf_dir)
    barren = docs.where("source_url like '%1' or source_url like '%3'").select(
        F.concat(F.lit("b"), "doc_id").alias("doc_id"), F.lit("<html><body>no table</body></html>").alias("html"),
        "state", "source_name", F.concat("source_url", F.lit("/index")).alias("source_url"),
        F.col("source_url").alias("link"),
    )
    payloads = (
        landed(pages(spark, sf_dir), "html").unionAll(landed(docs, "text", "text/csv"))
        .unionAll(landed(api_payloads(spark, sf_dir), "text")).unionAll(landed(barren, "html"))
    )
    out = ingest.route_payloads(payloads, AS_OF, barren.select("doc_id", "link"), ("body", "1"))
    return out.select("doc_id", "employer", F.col("notice_date").cast("string").alias("notice_date"))
