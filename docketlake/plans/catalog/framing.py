"""Grids, headers, frames and records, on pages and files built from the tables.

Every page or file holds a bounded bucket of consecutive keys, so building them is
an ordinary grouped aggregate however large the tables are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.staging import stage
from docketlake.operators import blocks, frames, funnel, headers
from docketlake.plans import ingest
from docketlake.plans.catalog.base import AS_OF, CODES, ORACLES, choose, filings, query, table, with_filings
from docketlake.session import dealt
from docketlake.sources.delimited import csv_grid
from docketlake.sources.html import html_frames, html_tables

PAGE_ROWS = 20
HEADER_SETS = (
    ("Company", "City", "Notice Date", "Layoff Date", "Employees Affected"),
    ("Employer", "Location", "Received Date", "Effective Date", "# of Workers"),
    ("Business Name", "Worksite City", "Date Received", "Date of Layoff", "Number Affected"),
)
_SETS_SQL = "[" + ", ".join("'" + "|".join(h) + "'" for h in HEADER_SETS) + "]"
_DAY_SQL = "month({0}) || '/' || day({0}) || '/' || year({0})"


def _cells() -> list[Column]:
    shown = lambda c: F.coalesce(F.date_format(c, "M/d/yyyy"), F.lit(""))
    return [
        F.col("employer"), F.coalesce("city", F.lit("")), shown("notice_date"), shown("effective_date"),
        F.coalesce(F.format_number("employees", 0), F.lit("TBD")),
    ]


_CELLS_SQL = f"""employer || '|' || coalesce(city, '') || '|' || {_DAY_SQL.format('notice_date')} || '|' ||
  coalesce({_DAY_SQL.format('effective_date')}, '') || '|' || coalesce(format('{{:,}}', employees), 'TBD')"""


def _row(tag: str, cells: list[Column]) -> Column:
    parts = [F.lit("<tr>")]
    for c in cells:
        parts += [F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")]
    return F.concat(*parts, F.lit("</tr>"))


def _header_row(doc: Column) -> Column:
    return choose(doc % 3, tuple(
        "<tr>" + "".join(f"<th>{h}</th>" for h in hs) + "</tr>" for hs in HEADER_SETS
    ))


def pages(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """Filing pages: navigation table, title row, header, rows, total, header again.

    ``split`` puts the rows of each order status into a table of their own.
    """
    cells = _cells()
    cells[0] = F.concat(F.lit('<a href="/n/'), F.col("ix").cast("string"), F.lit('.pdf">'), cells[0], F.lit("</a>"))
    doc = F.floor(F.col("ix") / PAGE_ROWS)
    rows = filings(spark, sf_dir).select(
        doc.alias("doc"), "ix", "status", F.coalesce("employees", F.lit(0)).alias("n"), _row("td", cells).alias("tr")
    )
    by = ["doc", "status"] if split else ["doc"]
    bodies = rows.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ix", "tr"))), lambda r: r["tr"]), "\n").alias("body"),
    )
    nav = '<table><tr><td rowspan="2">Home</td><td>About<br>us</td></tr><tr><td>Help</td></tr></table>'
    title = '<tr><td colspan="5">Filings &amp; notices</td></tr>'
    blank = "<tr><td></td><td> </td></tr>"
    tables = bodies.select(
        *by,
        F.concat(
            F.lit(f"<table>{title}"), _header_row(F.col("doc")), F.lit("\n"), "body", F.lit(blank),
            _row("td", [F.lit("TOTAL"), F.lit(""), F.lit(""), F.lit(""), F.col("total").cast("string")]),
            _header_row(F.col("doc")), F.lit("</table>"),
        ).alias("html"),
    )
    if split:
        tables = tables.groupBy("doc").agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("status", "html"))), lambda t: t["html"]), ""
            ).alias("html")
        )
    return tables.select(
        F.col("doc").cast("string").alias("doc_id"),
        F.concat(F.lit(f"<html><body>{nav}"), "html", F.lit("</body></html>")).alias("html"),
        choose(F.col("doc") % 25, CODES).alias("state"),
        F.lit("orders").alias("source_name"),
        F.concat(F.lit("https://p.example.org/"), F.col("doc").cast("string")).alias("source_url"),
    )


_DOCS_SQL = f"""docs AS (
  SELECT ix // {PAGE_ROWS} AS doc, *, row_number() OVER (PARTITION BY ix // {PAGE_ROWS} ORDER BY ix) AS pos FROM filings),
sizes AS (SELECT doc, count(*) AS n, cast(sum(coalesce(employees, 0)) AS BIGINT) AS total,
  ({_SETS_SQL})[(doc % 3) + 1] AS heads FROM docs GROUP BY doc)"""


def _doc_sql(body: str) -> str:
    return with_filings(f", {_DOCS_SQL}\n{body}")


@query("grid_tables", _doc_sql(f"""
SELECT cast(doc AS VARCHAR) AS doc_id, 0 AS frame_id, i AS row_ix, ['Home|About us', 'Home|Help'][i + 1] AS cells, NULL AS link
  FROM sizes, (SELECT unnest([0, 1]) AS i)
UNION ALL SELECT cast(doc AS VARCHAR), 1, 0, array_to_string(list_transform([1,2,3,4,5], lambda i: 'Filings & notices'), '|'), NULL FROM sizes
UNION ALL SELECT cast(doc AS VARCHAR), 1, 1, heads, NULL FROM sizes
UNION ALL SELECT cast(doc AS VARCHAR), 1, pos + 1, {_CELLS_SQL}, '/n/' || ix || '.pdf' FROM docs
UNION ALL SELECT cast(doc AS VARCHAR), 1, n + 2, 'TOTAL||||' || total, NULL FROM sizes
UNION ALL SELECT cast(doc AS VARCHAR), 1, n + 3, heads, NULL FROM sizes"""))
def grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables(pages(spark, sf_dir)).withColumn("cells", F.array_join("cells", "|"))


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "|") for n in names})


_FIELDS = "city|effective_date|employees|employer|notice_date"


@query("header_detect_web", _doc_sql(f"""
SELECT cast(doc AS VARCHAR) AS doc_id, 0 AS frame_id, 0 AS header_ix, 'Home|About us' AS headers, '' AS fields FROM sizes
UNION ALL SELECT cast(doc AS VARCHAR), 1, 1, heads, '{_FIELDS}' FROM sizes"""))
def header_detect_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.detect_headers(html_tables(pages(spark, sf_dir)), "web")
    return _joined(found, "headers", "fields").select("doc_id", "frame_id", "header_ix", "headers", "fields")


def _web(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    grid = html_tables(pages(spark, sf_dir, split))
    return frames.frame_rows(grid, frames.detect_headers(grid, "web"))


@query("shaped_frames", _doc_sql(f"""
SELECT cast(doc AS VARCHAR) AS doc_id, 0 AS frame_id, 0 AS header_ix, 'Home|About us' AS headers, '' AS fields, 1 AS n_rows, 0.0 AS score FROM sizes
UNION ALL SELECT cast(doc AS VARCHAR), 1, 1, heads, '{_FIELDS}', n + 2, round(100 + 5 * log10(n + 3), 6) FROM sizes"""))
def shaped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = frames.shape_frames(html_frames(pages(spark, sf_dir)), "web")
    return _joined(shaped, "headers", "fields").select(
        "doc_id", "frame_id", "header_ix", "headers", "fields", "n_rows", F.round("score", 6).alias("score")
    )


@query("row_materialise", _doc_sql("""
SELECT cast(doc AS VARCHAR) AS doc_id, frame_id, row_ix, headers, cells FROM (
  SELECT doc, 0 AS frame_id, 1 AS row_ix, 'Home|About us' AS headers, 'Home|Help' AS cells FROM sizes
  UNION ALL SELECT d.doc, 1, pos + 1, heads, employer || '|' || coalesce(city, '~') || '|' || """ + _DAY_SQL.format("notice_date")
  + " || '|' || coalesce(" + _DAY_SQL.format("effective_date") + """, '~') || '|' || coalesce(format('{:,}', employees), '~')
    FROM docs d JOIN sizes USING (doc)
  UNION ALL SELECT doc, 1, n + 2, heads, 'TOTAL|~|~|~|' || total FROM sizes
  UNION ALL SELECT doc, 1, n + 3, heads, heads FROM sizes)"""))
def row_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _joined(_web(spark, sf_dir), "headers").withColumn("cells", F.array_join("cells", "|", "~"))
    return rows.select("doc_id", "frame_id", "row_ix", "headers", "cells")


@query("frame_scores", _doc_sql("""
SELECT cast(doc AS VARCHAR) AS doc_id, 0 AS frame_id, 1 AS n_rows, 0.0 AS score FROM sizes
UNION ALL SELECT cast(doc AS VARCHAR), 1, n + 2, round(100 + 5 * log10(n + 3), 6) FROM sizes"""))
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = frames.frame_stats(_web(spark, sf_dir))
    return stats.select("doc_id", "frame_id", "n_rows", F.round("score", 6).alias("score"))


@query("best_frame", _doc_sql("SELECT cast(doc AS VARCHAR) AS doc_id, 1 AS frame_id, n + 2 AS n_rows FROM sizes"))
def best_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.top_frames(frames.frame_stats(_web(spark, sf_dir))).select("doc_id", "frame_id", "n_rows")


_RECORD_COLS = ("employer", "city", "notice_date", "effective_date", "employees", "state", "state_name", "source_url")
_RECORD_SQL = f"""employer, city, cast(notice_date AS VARCHAR) AS notice_date,
  cast(effective_date AS VARCHAR) AS effective_date, employees, ({[*CODES]})[(doc % 25) + 1] AS state,
  ({[vocab.STATES[c] for c in CODES]})[(doc % 25) + 1] AS state_name, 'https://p.example.org/n/' || ix || '.pdf' AS source_url"""


def _shown(records: DataFrame, *extra: str) -> DataFrame:
    return records.withColumns({c: F.col(c).cast("string") for c in vocab.DATE_FIELDS}).select(*extra, *_RECORD_COLS)


@query("records_from_pages", _doc_sql(f"SELECT cast(doc AS VARCHAR) AS doc_id, {_RECORD_SQL} FROM docs"))
def records_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ingest.records_from_pages(pages(spark, sf_dir), AS_OF, host="https://p.example.org"), "doc_id")


@query("frame_merge_web", _doc_sql(f"SELECT cast(doc AS VARCHAR) AS doc_id, {_RECORD_SQL} FROM docs"))
def frame_merge_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pages(spark, sf_dir, split=True)
    return _shown(ingest.records_from_pages(split, AS_OF, merge_tables=True, host="https://p.example.org"), "doc_id")


@query("best_by_yield", _doc_sql(f"""SELECT cast(doc AS VARCHAR) AS doc_id, {_RECORD_SQL} FROM docs JOIN (
  SELECT doc, status, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, status) AS place
  FROM docs GROUP BY doc, status) USING (doc, status) WHERE place = 1"""))
def best_by_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pages(spark, sf_dir, split=True)
    return _shown(ingest.records_from_pages(split, AS_OF, host="https://p.example.org"), "doc_id")


@query("rejected_rows", _doc_sql("""
SELECT cast(doc AS VARCHAR) AS doc_id, 'TOTAL' AS employer, 'junk' AS verdict FROM sizes
UNION ALL SELECT cast(doc AS VARCHAR), split_part(heads, '|', 1), 'junk' FROM sizes"""))
def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pages(spark, sf_dir).drop("html")
    rows = _web(spark, sf_dir).join(docs, "doc_id")
    return funnel.rejected_rows(rows, AS_OF).select("doc_id", "employer", "verdict")


@query("mapping_report", _doc_sql("""
SELECT cast(doc AS VARCHAR) AS doc_id, 0 AS frame_id, i - 1 AS col_ix, ['Home', 'About us'][i] AS header, NULL AS field
  FROM sizes, (SELECT unnest([1, 2]) AS i)
UNION ALL SELECT cast(doc AS VARCHAR), 1, i - 1, split_part(heads, '|', i),
  ['employer', 'city', 'notice_date', 'effective_date', 'employees'][i] FROM sizes, (SELECT unnest([1, 2, 3, 4, 5]) AS i)"""))
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.detect_headers(html_tables(pages(spark, sf_dir)), "web")
    return headers.mapping_report(found.select("doc_id", "frame_id", "headers", "mapping"))


# --------------------------------------------------------------------------
# Delimited files
# --------------------------------------------------------------------------

FILE_ROWS = 25
_SEPS = (",", ";", "\t", "|")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files of customers: optional title line, quoted names, an empty column."""
    cust = table(spark, sf_dir, "customer")
    doc = F.floor(F.col("c_custkey") / FILE_ROWS)
    sep = choose(doc % 4, _SEPS)
    name = F.concat(F.lit('"'), "c_name", sep, F.lit(' ""Best"" Shop'), F.when(F.col("c_custkey") % 2 == 0, "\nInc.").otherwise(""),
                    F.lit('"'))
    line = F.concat_ws(
        "\x01", name, F.col("c_mktsegment"), F.lit(""), F.lit("2024-03-14"),
        F.floor(F.abs("c_acctbal")).cast("string"),
    )
    rows = cust.select(doc.alias("doc"), "c_custkey", F.replace(line, F.lit("\x01"), sep).alias("line"))
    body = rows.groupBy("doc").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "line"))), lambda r: r["line"]), "\r\n").alias("body")
    )
    sep = choose(F.col("doc") % 4, _SEPS)
    head = F.replace(F.lit("Company Name\x01Town\x01County\x01Notice Date\x01Head Count"), F.lit("\x01"), sep)
    title = F.when(F.col("doc") % 2 == 1, "Revised list\n").otherwise("")
    return body.select(
        F.col("doc").cast("string").alias("doc_id"),
        F.concat(title, head, F.lit("\n"), "body", F.lit("\n\n")).alias("text"),
        choose(F.col("doc") % 25, CODES).alias("state"),
        F.lit("customers").alias("source_name"),
        F.concat(F.lit("https://f.example.org/"), F.col("doc").cast("string")).alias("source_url"),
    )


_FILE_SQL = f"""
WITH c AS (SELECT *, c_custkey // {FILE_ROWS} AS doc, ([',', ';', chr(9), '|'])[((c_custkey // {FILE_ROWS}) % 4) + 1] AS sep,
  row_number() OVER (PARTITION BY c_custkey // {FILE_ROWS} ORDER BY c_custkey) AS pos FROM customer)
"""


@query("csv_grid", _FILE_SQL + """
SELECT cast(doc AS VARCHAR) AS doc_id, row_ix, cells FROM (
  SELECT doc, pos + doc % 2 AS row_ix, c_name || sep || ' "Best" Shop' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Inc.' ELSE '' END
    || '#' || c_mktsegment || '##2024-03-14#' || cast(floor(abs(c_acctbal)) AS BIGINT) AS cells FROM c
  UNION ALL SELECT DISTINCT doc, doc % 2, 'Company Name#Town#County#Notice Date#Head Count' FROM c
  UNION ALL SELECT DISTINCT doc, 0, 'Revised list' FROM c WHERE doc % 2 = 1)""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_grid(files(spark, sf_dir)).select("doc_id", "row_ix", F.array_join("cells", "#").alias("cells"))


@query("header_detect_file", _FILE_SQL + """
SELECT DISTINCT cast(doc AS VARCHAR) AS doc_id, doc % 2 AS header_ix, 'Company Name|Town|County|Notice Date|Head Count' AS headers,
  'city|county|employees|employer|notice_date' AS fields FROM c""")
def header_detect_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.detect_headers(csv_grid(files(spark, sf_dir)), "file")
    return _joined(found, "headers", "fields").select("doc_id", F.col("header_ix").cast("bigint"), "headers", "fields")


@query("records_from_csv", _FILE_SQL + f"""
SELECT cast(doc AS VARCHAR) AS doc_id, c_name || replace(sep, chr(9), '') || ' "Best" Shop' || CASE WHEN c_custkey % 2 = 0 THEN ' Inc.' ELSE '' END AS employer,
  c_mktsegment AS city, '2024-03-14' AS notice_date, NULL AS effective_date, cast(floor(abs(c_acctbal)) AS INTEGER) AS employees,
  ({[*CODES]})[(doc % 25) + 1] AS state, ({[vocab.STATES[c] for c in CODES]})[(doc % 25) + 1] AS state_name,
  'https://f.example.org/' || doc AS source_url FROM c""")
def records_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ingest.records_from_csv(files(spark, sf_dir), AS_OF), "doc_id")


@query("records_from_grid", ORACLES["records_from_csv"])
def records_from_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir)
    return _shown(ingest.records_from_large_files(csv_grid(docs), docs, AS_OF), "doc_id")


@query("empty_columns", _FILE_SQL + """
SELECT DISTINCT cast(doc AS VARCHAR) AS doc_id, 'Company Name|Town|Notice Date|Head Count' AS headers FROM c""")
def empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = csv_grid(files(spark, sf_dir))
    rows = frames.frame_rows(grid, frames.detect_headers(grid, "file"))
    return _joined(frames.drop_empty_columns(rows), "headers").select("doc_id", "headers").distinct()


@query("file_frame_merge", """
SELECT o_custkey, 1 + o_orderkey % 2 AS frame_id, count(*) AS n_rows FROM orders GROUP BY ALL""")
def file_frame_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets 1 and 2 of a customer share a signature in another spelling; sheet 3 has no employer."""
    heads = F.array(*[F.array(*map(F.lit, h)) for h in (
        ("Company Name", "Notice Date"), ("COMPANY_NAME", "notice date"), ("Widget", "Gizmo"))])
    sheet = F.explode(F.array(F.col("o_orderkey") % 2 + 1, F.lit(3)))
    rows = table(spark, sf_dir, "orders").withColumn("frame_id", sheet).select(
        F.col("o_custkey").alias("doc_id"), "frame_id",
        F.element_at(heads, F.col("frame_id").cast("int")).alias("headers"),
    )
    # The two spellings map to the same fields; score is fields first, then rows.
    rows = rows.withColumn("fields", F.when(F.col("frame_id") < 3, F.array(F.lit("employer"), F.lit("notice_date")))
                           .otherwise(F.array().cast("array<string>")))
    merged = frames.merge_file_frames(frames.frame_stats(rows, "file"))
    return merged.select(F.col("doc_id").alias("o_custkey"), "frame_id", "n_rows")


@query("width_stitch", """
WITH g AS (SELECT o_custkey AS doc, o_orderkey AS frame, l_linenumber, 2 + o_orderkey % 2 AS width,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ix, l_partkey
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT doc, width AS frame_id, row_number() OVER (PARTITION BY doc, width ORDER BY frame, ix) - 1 AS row_ix, l_partkey FROM g""")
def width_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    grid = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("frame_id"),
        (F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey")) - 1).alias("row_ix"),
        F.array_repeat(F.col("l_partkey").cast("string"), (F.col("o_orderkey") % 2 + 2).cast("int")).alias("cells"),
        F.lit(None).cast("string").alias("link"),
    )
    return frames.stitch_by_width(grid).select(
        F.col("doc_id").alias("doc"), F.col("frame_id").cast("bigint").alias("frame_id"),
        F.col("row_ix").cast("bigint").alias("row_ix"), F.col("cells")[0].cast("bigint").alias("l_partkey"),
    )


@query("row_dedupe", """
SELECT l_partkey, l_quantity, l_returnflag, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END
    ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS nth FROM lineitem) WHERE nth = 1""")
def row_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(
        F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")),
    )
    rows = table(spark, sf_dir, "lineitem").withColumn("cells", cells)
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return frames.dedupe_rows(rows, [], order, frames.row_signature("cells")).select(
        "l_partkey", "l_quantity", "l_returnflag", "l_orderkey", "l_linenumber"
    )


@query("document_copies", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS nth FROM documents)
WHERE nth = 1""")
def document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.create_map(F.lit("text"), "text", F.lit("lang"), "lang", F.lit("none"), F.lit(None).cast("string"))
    docs = table(spark, sf_dir, "documents")
    return frames.dedupe_rows(docs, [], ["doc_id"], frames.map_signature(row)).select("doc_id", "source")


# --------------------------------------------------------------------------
# Header matching
# --------------------------------------------------------------------------

_PHRASES = (
    "Establishment", "Date Filed", "Wib (north)", "Head Count & Shifts", "Details on Remarks", "Town / City", "Start of Separation",
    "Parish or County", "Count", "Title", "Received at Office", "Plant Closing", "Sector", "Street & Number", "Workers (affected)",
    "Postal Area", "Union Contact", "Phone Number", "Comment", "Site Name of Employer",
)
_PHRASES_SQL = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "]"
_SYN_SQL = ", ".join(f"('{f}', '{s}')" for f, items in vocab.SYNONYMS.items() for s in items)
_RULE_SQL = ", ".join(f"('{f}', {list(w)}, {n})" for f, items in vocab.TOKEN_RULES.items() for w, n in items)

_SCORE_SQL = f"""
words AS (SELECT header, CASE WHEN lower(trim(header)) LIKE 'unnamed:%' THEN '' ELSE
    regexp_replace(base, '[^a-z0-9]+', '', 'g') END AS norm,
  list_filter(regexp_split_to_array(base, '[^a-z0-9]+'), lambda w: w <> '') AS tokens
  FROM (SELECT header, regexp_replace(replace(lower(trim(header)), '&', 'and'), '\\([^)]*\\)', ' ', 'g') AS base
    FROM (SELECT DISTINCT header FROM h))),
syn(field, s) AS (VALUES {_SYN_SQL}), rule(field, needed, weight) AS (VALUES {_RULE_SQL}),
parts AS (
  SELECT header, field, CASE WHEN norm = s THEN 100 ELSE 40 + length(s) END AS score FROM words JOIN syn
    ON norm = s OR (length(s) >= 6 AND contains(norm, s)) WHERE norm <> ''
  UNION ALL SELECT header, field, cast(sum(weight) AS INTEGER) FROM words JOIN rule ON list_has_all(tokens, needed)
    WHERE norm <> '' GROUP BY header, field),
scores AS (SELECT header, field, max(score) AS score FROM parts GROUP BY header, field)"""


def _header_text(prefix: Column) -> Column:
    return F.concat(choose(prefix, _PHRASES), F.lit(" "), "c_mktsegment")


@query("header_scores", f"""
WITH h AS (SELECT ({_PHRASES_SQL})[(c_custkey % 20) + 1] || ' ' || c_mktsegment AS header FROM customer
  UNION ALL SELECT text FROM conversations), {_SCORE_SQL}
SELECT header, field, score FROM scores""")
def header_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = table(spark, sf_dir, "customer").select(_header_text(F.col("c_custkey") % 20).alias("header"))
    prose = table(spark, sf_dir, "conversations").select(F.col("text").alias("header"))
    distinct = built.unionAll(prose).distinct()
    return distinct.select("header", F.explode(headers.header_scores("header")).alias("s")).select(
        "header", "s.field", "s.score"
    )


_ASSIGN_IX = (1, 3, 7, 9, 11, 13)


@query("header_assign", f"""
WITH frames AS (SELECT c_custkey, unnest(range(6)) AS col, unnest([{", ".join(
    f"({_PHRASES_SQL})[((c_custkey * {k} + {k}) % 20) + 1] || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' || c_mktsegment END" for k in _ASSIGN_IX)}]) AS header
  FROM customer), h AS (SELECT header FROM frames), {_SCORE_SQL},
cands AS (
  SELECT c_custkey, col, s.field, s.score FROM frames f JOIN scores s USING (header)
    WHERE s.score >= 4 AND regexp_replace(lower(header), '[^a-z0-9]', '', 'g') <> 'title'
  UNION ALL SELECT c_custkey, col, 'employer', 999 FROM frames
    WHERE regexp_replace(lower(header), '[^a-z0-9]', '', 'g') = 'title'),
listed AS (SELECT c_custkey, list({{'col': col, 'field': field, 'score': score}}
    ORDER BY score DESC, col, field DESC) AS cs FROM cands GROUP BY c_custkey),
taken AS (SELECT c_custkey, list_reduce(list_transform(cs, lambda c: [c]),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.col = x[1].col OR a.field = x[1].field)) > 0
      THEN acc ELSE list_concat(acc, x) END) AS got FROM listed)
SELECT c_custkey, array_to_string(list_transform(got, lambda g: g.col || '=' || g.field || '@' || g.score), ' ') AS mapping FROM taken""")
def header_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    tail = F.when(key % 2 == 0, "").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    heads = F.array(*[F.concat(choose((key * k + k) % 20, _PHRASES), tail) for k in _ASSIGN_IX])
    mapping = headers.map_headers(heads, {"title": "employer"})
    shown = F.transform(mapping, lambda m: F.concat(
        m["col"].cast("string"), F.lit("="), m["field"], F.lit("@"), m["score"].cast("string")))
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    return stage(customers, {"mapping": F.array_join(shown, " ")}, ["c_custkey"]).where("mapping != ''")


@query("header_names", """
SELECT c_custkey, array_to_string([CASE WHEN c_custkey % 3 = 0 THEN 'column_0' ELSE c_mktsegment END,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_mktsegment || '__1' END,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '__1' ELSE c_mktsegment || '__2' END, 'column_3', c_name], '|') AS names
FROM customer""")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    first = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(seg)
    cells = F.array(first, F.concat(F.lit(" "), seg), seg, F.lit(None).cast("string"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(headers.name_headers(cells), "|").alias("names")
    )


# --------------------------------------------------------------------------
# Row filters
# --------------------------------------------------------------------------

_EMPLOYERS = ("Grand Total", "Page 3 of 9", "continued on next page", "No notices", "12345", "There were no filings today", "X", "")


@query("junk_rows", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN 0 ELSE 1 END AS junk,
  CASE WHEN o_orderkey % 9 <> 6 AND o_orderkey % 9 <> 7 AND (o_orderstatus <> 'P' OR o_orderkey % 2 = 0) THEN 1 ELSE 0 END AS usable
FROM orders""")
def junk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 9 < 8, choose(F.least(key % 9, F.lit(7)), _EMPLOYERS)).otherwise(
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    )
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", name.alias("employer"),
        F.when(key % 2 == 0, F.col("o_orderdate").cast("date")).alias("notice_date"),
        F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("date").alias("closing_date"),
        F.when(F.col("o_orderstatus") != "P", 0).alias("employees"),
    )
    return rows.select(
        "o_orderkey", funnel.is_junk_employer("employer").cast("int").alias("junk"),
        funnel.is_usable().cast("int").alias("usable"),
    )


@query("repeated_headers", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS repeated FROM orders""")
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    heads = choose(key % 3, tuple("|".join(h) for h in HEADER_SETS))
    data = F.concat_ws("|", F.concat(F.lit("Company "), F.col("o_custkey").cast("string")), F.col("o_orderpriority"),
                       F.col("o_orderdate").cast("string"), F.lit("City"))
    cells = F.split(F.when(key % 4 == 0, heads).otherwise(data), r"\|")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", funnel.is_repeated_header(cells).cast("int").alias("repeated")
    )


@query("defaults_fill", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Anytown' ELSE c_mktsegment END AS city,
  CASE WHEN c_acctbal < 0 THEN 'n/k' ELSE 'given' END AS region,
  CASE WHEN c_acctbal < 0 THEN 10 ELSE c_custkey END AS employees FROM customer""")
def defaults_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("city"),
        F.when(F.col("c_acctbal") >= 0, "given").alias("region"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("employees"),
    )
    return funnel.fill_defaults(rows, {"city": "Anytown", "region": "n/k", "employees": 10})


# --------------------------------------------------------------------------
# Blocks, positional and smeared rows
# --------------------------------------------------------------------------


@query("carry_forward", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    out = blocks.carry_forward(events, ["user_id"], ["ts", "event_id"], "paid", "last_purchase", F.col("ts").cast("date"))
    return out.select("event_id", "last_purchase")


@query("heading_context", """
WITH b AS (
  SELECT o_custkey AS doc_id, o_orderkey * 3 AS pos, 'heading' AS kind, year(o_orderdate) + 10 AS y, 0 AS m FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey, o_orderkey * 3 + 1, 'title', NULL, month(o_orderdate) FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT o_custkey, o_orderkey * 3 + 2, 'panel', NULL, NULL FROM orders),
c AS (SELECT doc_id, pos, kind, last_value(y IGNORE NULLS) OVER w AS year, nullif(last_value(m IGNORE NULLS) OVER w, 0) AS month
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, year, month FROM c WHERE kind = 'panel'""")
def heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    doc, key = F.col("o_custkey").alias("doc_id"), F.col("o_orderkey")
    year = (F.year("o_orderdate") + 10).cast("string")
    parts = [
        orders.where("o_orderstatus = 'F'").select(doc, (key * 3).alias("pos"), F.lit("heading").alias("kind"), year.alias("text")),
        orders.where("o_orderstatus != 'O'").select(
            doc, (key * 3 + 1).alias("pos"), F.lit("title").alias("kind"), F.date_format("o_orderdate", "MMMM").alias("text")),
        orders.select(doc, (key * 3 + 2).alias("pos"), F.lit("panel").alias("kind"), F.col("o_orderpriority").alias("text")),
    ]
    laid = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return blocks.heading_context(laid, 5_000).where("kind = 'panel'").select("doc_id", "pos", "year", "month")


@query("labelled_blocks", """
SELECT o_orderkey, 'Customer ' || o_custkey AS employer, 'Springfield' AS city, 'County ' || o_custkey AS county, '17000' AS zip_code,
  cast(make_date(2000 + cast(o_orderkey % 20 AS INTEGER), 1 + cast(o_orderkey % 12 AS INTEGER), 1) AS VARCHAR) AS notice_date,
  cast(o_orderdate AS DATE)::VARCHAR AS effective_date, o_custkey AS employees,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Closure' ELSE 'Layoff' END AS notice_type FROM orders""")
def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "M/d/yyyy")
    text = F.concat(
        F.lit("1 Main Road, Springfield, PA 17000 COUNTIES: County "), cust, F.lit(" # AFFECTED: "), cust,
        F.when(key % 2 == 0, F.concat(F.lit(" EFFECTIVE DATES: beginning "), day, F.lit(", ending 4/1/2027")))
        .otherwise(F.concat(F.lit(" EFFECTIVE DATE: "), day)),
        F.lit(" CLOSURE OR LAYOFF: "), F.when(key % 2 == 0, "Closure").otherwise("Layoff"),
    )
    panels = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Customer "), cust).alias("title"), text.alias("text"),
        (key % 20 + 2000).alias("year"), (key % 12 + 1).alias("month"),
    )
    out = blocks.panel_records(panels, AS_OF, "PA")
    return out.select(
        "o_orderkey", "employer", "city", "county", "zip_code", F.col("notice_date").cast("string"),
        F.col("effective_date").cast("string"), F.col("employees").cast("bigint"), "notice_type",
    )


@query("positional_rows", """
SELECT o_orderkey, 'Customer ' || o_custkey AS employer, 'Trenton' AS city,
  cast(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS notice_date, cast(o_orderdate AS DATE)::VARCHAR AS effective_date,
  o_custkey AS employees, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS notes FROM orders""")
def positional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = F.col("o_custkey").cast("string")
    city = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Trenton, "), "o_orderpriority")).otherwise("Trenton")
    span = F.concat(F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" - 11/26/2026"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"),
        F.array(F.concat(F.lit("Customer "), cust), city, F.date_format("o_orderdate", "MMMM"), span, cust).alias("cells"),
    )
    heads = rows.select("o_orderkey", "year", F.array(F.lit("Company City Month"), *[F.lit(None).cast("string")] * 4).alias("cells"))
    out = blocks.positional_rows(rows.unionAll(heads), AS_OF)
    return out.select("o_orderkey", "employer", "city", F.col("notice_date").cast("string"),
                      F.col("effective_date").cast("string"), F.col("employees").cast("bigint"), "notes")


@query("smeared_rows", """
SELECT o_orderkey, 'Boulder City Shop ' || o_custkey AS employer, 'Las Vegas' AS city, 'Clark' AS county,
  cast(o_orderdate AS DATE)::VARCHAR AS notice_date, cast(o_orderdate AS DATE)::VARCHAR AS effective_date,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 500 END AS employees,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Layoff' ELSE 'Closure' END AS notice_type, CASE WHEN o_orderkey % 2 = 0 THEN 'below' END AS notes
FROM orders""")
def smeared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "M/d/yyyy")
    action = F.when(key % 2 == 0, "Layoff").otherwise("Closure")
    count = F.when(key % 3 != 0, (key % 500).cast("string")).otherwise("unknown")
    flag = F.when(key % 2 == 0, "Non-Listed").otherwise("Listed")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", key.alias("doc_id"), F.lit(1).alias("page"),
        F.array(day, F.concat(day, F.substring(action, 1, 2)), F.substring(action, 3, 9),
                F.concat(count, F.lit("Boulder CityShop ")), cust, F.lit("Las Vegas"), F.lit("Clark"), flag).alias("cells"),
    )
    lines = table(spark, sf_dir, "orders").select(
        key.alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line_ix"),
        F.concat(day, F.lit(" "), day, action, F.lit(" "), count, F.lit("Boulder City Shop "), cust,
                 F.lit(" Las Vegas Clark "), flag).alias("line"),
    )
    out = blocks.smeared_rows(rows, lines, AS_OF, note="below")
    return out.select("o_orderkey", "employer", "city", "county", F.col("notice_date").cast("string"),
                      F.col("effective_date").cast("string"), F.col("employees").cast("bigint"), "notice_type", "notes")


@query("detail_enrich", with_filings("""
SELECT ix, coalesce(employees, ix % 1000) AS employees FROM filings"""))
def detail_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir).select("ix", "employees", "source_url")
    details = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://filings.example.org/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("<h3 class='t'>Company</h3><p>9 lives</p><h3>Number of <b>Employees</b> Affected</h3>\n<p class='d'>"),
                 (F.col("o_orderkey") % 1000).cast("string"), F.lit(" people</p>")).alias("html"),
    )
    return blocks.enrich_counts(rows, details).select("ix", F.col("employees").cast("bigint").alias("employees"))


@query("link_resolve", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://x.example.org/' || o_orderkey WHEN 1 THEN 'https://h.example.org/d/' || o_orderkey
  ELSE 'https://h.example.org/list' END AS source_url FROM orders""")
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    link = F.when(key % 3 == 0, F.concat(F.lit("https://x.example.org/"), key.cast("string"))).when(
        key % 3 == 1, F.concat(F.lit("/d/"), key.cast("string")))
    url = blocks.resolve_link(F.lit("https://h.example.org/list"), link, "https://h.example.org")
    return table(spark, sf_dir, "orders").select("o_orderkey", url.alias("source_url"))
