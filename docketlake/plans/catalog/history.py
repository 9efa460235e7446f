"""Search, rollups, identity and keyed history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.places import state_code, state_name
from docketlake.operators import merge, rollup, runs, search
from docketlake.operators.funnel import coverage
from docketlake.plans.catalog.base import CODES, filings, query, table, text_of, with_filings
from docketlake.plans.ingest import period_urls
from docketlake.session import work_dir

FIRST, NOW = "2024-01-01 00:00:00", "2024-06-01 12:00:00"
_ROW = ("hash", "state", "employer", "city", "employees", "notice_type")
_ROW_SQL = "hash, state, employer, city, employees, notice_type"


@query("summary", with_filings("""
SELECT count(*) AS notices, cast(coalesce(sum(employees), 0) AS BIGINT) AS workers_affected,
  count(DISTINCT state) AS states, cast(min(notice_date) AS VARCHAR) AS earliest_notice,
  cast(max(notice_date) AS VARCHAR) AS latest_notice FROM filings"""))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.summary(filings(spark, sf_dir)).select(
        "notices", "workers_affected", "states", *text_of("earliest_notice", "latest_notice")
    )


@query("group_rollup_share", with_filings("""
SELECT state, n, workers, round(n * 100.0 / max(n) OVER (), 1) AS share FROM (
  SELECT state, count(*) AS n, cast(coalesce(sum(employees), 0) AS BIGINT) AS workers
  FROM filings GROUP BY state)"""))
def group_rollup_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.share_of_max(rollup.per_group(filings(spark, sf_dir)))


_FIND = dict(query="automobile", min_employees=1000, since="1996-06-01")
_FIND_SQL = """WHERE (contains(lower(employer), 'automobile') OR contains(lower(industry), 'automobile')
  OR contains(lower(notes), 'automobile')) AND employees >= 1000 AND notice_date >= DATE '1996-06-01'"""


@query("search_page", with_filings(f"""
SELECT {_ROW_SQL}, cast(notice_date AS VARCHAR) AS notice_date FROM filings {_FIND_SQL}
ORDER BY filings.notice_date DESC NULLS LAST, hash LIMIT 25 OFFSET 25"""))
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(filings(spark, sf_dir), page=2, **_FIND).select(*_ROW, *text_of("notice_date"))


@query("search_total", with_filings(f"""
SELECT count(*) AS total, cast(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS total_pages
FROM filings {_FIND_SQL}"""))
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_total(filings(spark, sf_dir), **_FIND)


@query("search_wildcard", with_filings("""
SELECT count(*) AS total, cast(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS total_pages
FROM filings WHERE (lower(employer) LIKE '%customer#%7%llc%' OR lower(industry) LIKE '%customer#%7%llc%'
  OR lower(notes) LIKE '%customer#%7%llc%') AND contains(lower(city), 'build')"""))
def search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_total(
        filings(spark, sf_dir), query="customer#%7%llc", city="build", wildcards=True
    )


_MODES = ("notice_date_desc", "notice_date_asc", "employees_desc", "employer_asc")
_MODES_SQL = {
    "notice_date_desc": "effective_date DESC NULLS LAST",
    "notice_date_asc": "effective_date ASC NULLS FIRST",
    "employees_desc": "employees DESC NULLS LAST",
    "employer_asc": "employer ASC",
}


@query("sort_modes", with_filings(" UNION ALL ".join(
    f"(SELECT '{m}' AS mode, hash FROM filings ORDER BY {o}, hash LIMIT 40)" for m, o in _MODES_SQL.items())))
def sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The effective date stands in for the sort date because it has NULLs.
    df = filings(spark, sf_dir).drop("notice_date").withColumnRenamed("effective_date", "notice_date")
    out = None
    for mode in _MODES:
        part = search.search(df, order=mode, per_page=40).select(F.lit(mode).alias("mode"), "hash")
        out = part if out is None else out.unionAll(part)
    return out


@query("latest_k", """SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 12""")
def latest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.latest(table(spark, sf_dir, "events"), 12, "ts", "event_id").select(
        "event_id", "user_id", "event_type"
    )


@query("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.distinct_values(table(spark, sf_dir, "events"), "event_type")


@query("record_hash", with_filings("SELECT ix, employer_key, hash FROM filings"))
def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("ix", "employer_key", "hash")


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filing listed once per line of its order."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ix"), F.col("l_linenumber").alias("line"), "l_shipdate", "l_partkey"
    )
    return filings(spark, sf_dir).join(lines, "ix")


@query("batch_dedupe", with_filings("""
SELECT hash, ix, line, l_partkey FROM (
  SELECT f.hash, f.ix, l_linenumber AS line, l_partkey, row_number() OVER (
    PARTITION BY hash ORDER BY l_shipdate, ix, l_linenumber, l_partkey) AS nth
  FROM filings f JOIN lineitem ON l_orderkey = ix) WHERE nth = 1"""))
def batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sightings(spark, sf_dir)
    return merge.dedupe_batch(rows, ["l_shipdate", "ix", "line", "l_partkey"]).select(
        "hash", "ix", "line", "l_partkey"
    )


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History before the run: filed and open orders, some fields still empty."""
    base = merge.dedupe_batch(filings(spark, sf_dir).where("status != 'P'"), ["ix"])
    stamp = F.lit(FIRST).cast("timestamp")
    return base.withColumns({
        "industry": F.when(F.col("notes") != "1-URGENT", F.col("industry")),
        "county": F.when(F.col("notes") == "2-HIGH", "").otherwise(F.col("county")),
        "first_seen_at": stamp, "last_seen_at": stamp, "updated_at": stamp,
        "is_active": F.col("notes") != "3-MEDIUM",
    })


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dedupe_batch(filings(spark, sf_dir).where("status != 'F'"), ["ix"])


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(_target(spark, sf_dir), _batch(spark, sf_dir), NOW)


_MERGE_SQL = with_filings(f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ix) AS nth FROM filings WHERE status <> 'P'),
branked AS (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ix) AS nth FROM filings WHERE status <> 'F'),
t AS (SELECT * EXCLUDE (nth) REPLACE (
    CASE WHEN notes <> '1-URGENT' THEN industry END AS industry,
    CASE WHEN notes = '2-HIGH' THEN '' ELSE county END AS county),
    notes <> '3-MEDIUM' AS is_active FROM ranked WHERE nth = 1),
s AS (SELECT * EXCLUDE (nth) FROM branked WHERE nth = 1),
m AS (SELECT coalesce(t.hash, s.hash) AS hash,
    CASE WHEN t.hash IS NULL THEN s.industry WHEN s.hash IS NOT NULL AND coalesce(t.industry, '') = ''
         THEN s.industry ELSE t.industry END AS industry,
    CASE WHEN t.hash IS NULL THEN s.county WHEN s.hash IS NOT NULL AND coalesce(t.county, '') = ''
         THEN s.county ELSE t.county END AS county,
    CASE WHEN t.hash IS NULL THEN s.employer ELSE t.employer END AS employer,
    CASE WHEN t.hash IS NULL THEN '{NOW}' ELSE '{FIRST}' END AS first_seen_at,
    CASE WHEN s.hash IS NULL THEN '{FIRST}' ELSE '{NOW}' END AS last_seen_at,
    CASE WHEN s.hash IS NOT NULL OR t.is_active THEN 1 ELSE 0 END AS active,
    coalesce(t.state, s.state) AS state,
    CASE WHEN t.hash IS NULL THEN 'new' WHEN s.hash IS NULL THEN 'kept'
         WHEN (coalesce(t.industry, '') = '' AND coalesce(s.industry, '') <> '')
           OR (coalesce(t.county, '') = '' AND coalesce(s.county, '') <> '')
           OR (coalesce(t.city, '') = '' AND coalesce(s.city, '') <> '')
           OR (coalesce(t.notice_type, '') = '' AND coalesce(s.notice_type, '') <> '')
           OR (coalesce(t.notes, '') = '' AND coalesce(s.notes, '') <> '')
         THEN 'updated' ELSE 'seen' END AS change
  FROM t FULL JOIN s ON t.hash = s.hash)
""")


@query("upsert", _MERGE_SQL + "SELECT hash, employer, first_seen_at, last_seen_at, last_seen_at AS updated_at, "
                              "active, change FROM m")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select(
        "hash", "employer", *text_of("first_seen_at", "last_seen_at", "updated_at"),
        F.col("is_active").cast("int").alias("active"), "change",
    )


@query("backfill", _MERGE_SQL + "SELECT hash, industry, county FROM m WHERE change = 'updated'")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).where("change = 'updated'").select("hash", "industry", "county")


@query("upsert_stats", _MERGE_SQL + """SELECT state, count(*) FILTER (change = 'new') AS rows_new,
  count(*) FILTER (change = 'updated') AS rows_updated FROM m GROUP BY state""")
def upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert_stats(_merged(spark, sf_dir), ["state"])


@query("soft_delete", with_filings(f""",
t AS (SELECT hash, min(state) AS state, bool_or(status <> 'F') AS seen FROM filings GROUP BY hash)
SELECT hash, CASE WHEN seen OR NOT ok THEN 1 ELSE 0 END AS active, CASE WHEN seen OR NOT ok THEN 0 ELSE 1 END AS retired
FROM t JOIN (SELECT ({[*CODES]})[n_nationkey + 1] AS state, n_regionkey IN (0, 1) AS ok FROM nation) USING (state)"""))
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir)
    target = merge.dedupe_batch(rows, ["ix"]).select("hash", "state", F.lit(True).alias("is_active"))
    nation = table(spark, sf_dir, "nation").where("n_regionkey in (0, 1)")
    ok = nation.select(F.element_at(F.array(*map(F.lit, CODES)), F.col("n_nationkey") + 1).alias("state"))
    seen = rows.where("status != 'F'")
    return merge.deactivate_missing(target, seen, ok).select(
        "hash", F.col("is_active").cast("int").alias("active"), F.col("retired").cast("int").alias("retired")
    )


@query("new_feed", _MERGE_SQL + "SELECT hash, state FROM m WHERE change = 'new'")
def new_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.new_rows(_batch(spark, sf_dir), _target(spark, sf_dir)).select("hash", "state")


@query("existing_probe", _MERGE_SQL + "SELECT hash, state FROM m WHERE change IN ('seen', 'updated')")
def existing_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.existing_rows(_target(spark, sf_dir), _batch(spark, sf_dir)).select("hash", "state")


@query("export_rows", with_filings("""
SELECT state, employer, cast(notice_date AS VARCHAR) AS notice_date, hash FROM filings
WHERE state IN ('AL', 'CA', 'GA') AND notice_date >= DATE '1997-01-01'"""))
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.export_rows(filings(spark, sf_dir), ["al", "ca", "ga"], "1997-01-01",
                             columns=("state", "employer", "notice_date", "hash"))
    return out.withColumn("notice_date", F.col("notice_date").cast("string"))


@query("export_files", with_filings("""
SELECT fmt, state, employer, cast(notice_date AS VARCHAR) AS notice_date, employees FROM filings, (VALUES ('csv'), ('json')) AS f(fmt)
WHERE state IN ('AL', 'CA', 'GA')"""))
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports written as CSV and as JSON lines, read back whole."""
    base, names = work_dir(spark, "export"), "state string, employer string, notice_date date, employees int"
    out = search.export_rows(filings(spark, sf_dir), ["al", "ca", "ga"], columns=("state", "employer", "notice_date", "employees"))
    for fmt in ("csv", "json"):
        search.write_export(out, f"{base}/{fmt}", fmt)
    back = spark.read.schema(names).option("header", "true").csv(f"{base}/csv").withColumn("fmt", F.lit("csv")).unionByName(
        spark.read.schema(names).json(f"{base}/json").withColumn("fmt", F.lit("json")))
    return back.withColumn("notice_date", F.col("notice_date").cast("string"))


@query("search_export", with_filings("""
SELECT state, employer, city, county, cast(notice_date AS VARCHAR) AS notice_date,
  cast(effective_date AS VARCHAR) AS effective_date, employees, notice_type, industry, source_url
FROM filings WHERE state = 'CO' ORDER BY filings.notice_date DESC NULLS LAST, hash"""))
def search_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search_export(filings(spark, sf_dir), state="co")
    return out.withColumns({c: F.col(c).cast("string") for c in ("notice_date", "effective_date")})


@query("coverage", with_filings(" UNION ALL ".join(
    f"SELECT state, '{f}' AS field, count({f}) AS filled, count(*) AS total, "
    f"round(100.0 * count({f}) / count(*), 1) AS pct, cast(100.0 * count({f}) / count(*) <= 50 AS INTEGER) AS low "
    f"FROM filings GROUP BY state"
    for f in ("city", "county", "notice_date", "effective_date", "employees", "notice_type"))))
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(filings(spark, sf_dir), ("state",)).withColumn("low", F.col("low").cast("int"))


@query("label_coverage", """
SELECT source, 'quality' AS field, count(quality) AS filled, count(*) AS total,
  round(100.0 * count(quality) / count(*), 1) AS pct, cast(100.0 * count(quality) / count(*) <= 50 AS INTEGER) AS low
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return coverage(joined, ("source",), ("quality",)).withColumn("low", F.col("low").cast("int"))


# Events as a run log: each day is a run, each user a source.
_RUNS_SQL = """results AS (
  SELECT cast(cast(ts AS DATE) AS VARCHAR) AS run_id, user_id AS source, bool_or(event_type = 'purchase') AS ok,
    CASE WHEN user_id % 10 = 0 THEN 'does not publish' ELSE '' END AS unavailable,
    count(*) AS rows_parsed, count(*) FILTER (event_type = 'signup') AS rows_new,
    count(*) FILTER (event_type = 'click') AS rows_updated
  FROM events GROUP BY ALL)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("ts").cast("date").cast("string").alias("run_id"), F.col("user_id").alias("source")
    ).agg(
        F.bool_or(F.col("event_type") == "purchase").alias("ok"),
        F.count("*").alias("rows_parsed"),
        F.count_if(F.col("event_type") == "signup").alias("rows_new"),
        F.count_if(F.col("event_type") == "click").alias("rows_updated"),
    ).withColumn("unavailable", F.when(F.col("source") % 10 == 0, "does not publish").otherwise(""))


@query("run_rollup", f"""WITH {_RUNS_SQL}
SELECT run_id, count(*) AS states_attempted, count(*) FILTER (ok) AS states_ok,
  count(*) FILTER (NOT ok AND unavailable = '') AS states_failed, cast(sum(rows_parsed) AS BIGINT) AS rows_parsed,
  cast(sum(rows_new) AS BIGINT) AS rows_new, cast(sum(rows_updated) AS BIGINT) AS rows_updated
FROM results GROUP BY run_id""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.run_rollup(_results(spark, sf_dir))


@query("run_results", f"""WITH {_RUNS_SQL}, runs AS (
  SELECT cast(cast(ts AS DATE) AS VARCHAR) AS run_id, cast(min(ts) AS DATE)::VARCHAR AS started
  FROM events GROUP BY 1)
SELECT run_id, started, source, rows_parsed FROM runs JOIN results USING (run_id)""")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("run_id")).agg(
        F.min("ts").cast("date").cast("string").alias("started")
    )
    return rollup.run_results(runs, _results(spark, sf_dir)).select("run_id", "started", "source", "rows_parsed")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources; one is fine when an order carries a usable headcount."""
    sources = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("state"), F.col("c_mktsegment").alias("source_name"),
        F.concat(F.lit("https://c.example.org/"), F.col("c_custkey").cast("string")).alias("url"),
        F.when(F.col("c_acctbal") < 0, "closed account").otherwise("").alias("unavailable"),
    )
    used = filings(spark, sf_dir).where("employees is not null").select(
        F.substring_index("employer", " ", 1).alias("state"), "employees"
    ).withColumn("state", F.rtrim("state", F.lit(",")))
    return rollup.source_status(sources, rollup.counts_by_source(used))


_STATUS_SQL = with_filings(""", counts AS (
  SELECT rtrim(split_part(employer, ' ', 1), ',') AS state, count(*) AS rows_parsed, cast(sum(employees) AS BIGINT) AS workers
  FROM filings WHERE employees IS NOT NULL GROUP BY 1),
status AS (
  SELECT c_name AS state, c_mktsegment AS source_name, 'https://c.example.org/' || c_custkey AS url,
    CASE WHEN c_acctbal < 0 THEN 0 ELSE coalesce(rows_parsed, 0) END AS rows_parsed,
    CASE WHEN c_acctbal < 0 THEN 0 ELSE coalesce(workers, 0) END AS workers,
    CASE WHEN c_acctbal >= 0 AND coalesce(rows_parsed, 0) > 0 THEN 1 ELSE 0 END AS ok,
    CASE WHEN c_acctbal < 0 THEN 'unavailable' WHEN coalesce(rows_parsed, 0) > 0 THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN c_acctbal < 0 THEN 'closed account' WHEN coalesce(rows_parsed, 0) = 0 THEN 'parsed 0 usable rows' END AS error
  FROM customer LEFT JOIN counts ON c_name = counts.state)
""")


@query("source_status", _STATUS_SQL + "SELECT state, status, rows_parsed, workers, error FROM status")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("state", "status", "rows_parsed", "workers", "error")


@query("health_report", _STATUS_SQL + """SELECT state, source_name AS source, url, ok, rows_parsed AS rows, workers,
  cast(rows_parsed AS DOUBLE) / 4 AS duration_s, error FROM status""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _status(spark, sf_dir).withColumn("duration_s", F.col("rows_parsed") / 4)
    return rollup.health_report(rows).withColumn("ok", F.col("ok").cast("int"))


@query("health_totals", _STATUS_SQL + """SELECT status, count(*) AS n_sources, cast(sum(rows_parsed) AS BIGINT) AS rows_parsed,
  cast(sum(workers) AS BIGINT) AS workers FROM status GROUP BY status""")
def health_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.health_totals(_status(spark, sf_dir))


@query("health_lists", _STATUS_SQL + "SELECT status, state, error FROM status")
def health_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.health_lists(_status(spark, sf_dir))


@query("run_history", _STATUS_SQL.rstrip() + """, stats AS (
  SELECT rtrim(split_part(employer, ' ', 1), ',') AS state, count(*) FILTER (status = 'O') AS rows_new,
    count(*) FILTER (status = 'F') AS rows_updated FROM filings GROUP BY 1)
SELECT s.state, s.ok, s.rows_parsed, coalesce(rows_new, 0) AS rows_new, coalesce(rows_updated, 0) AS rows_updated
FROM status s LEFT JOIN stats USING (state)""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("status") == "O", "new").when(F.col("status") == "F", "updated")
    merged = filings(spark, sf_dir).select(
        F.rtrim(F.substring_index("employer", " ", 1), F.lit(",")).alias("state"), change.alias("change")
    )
    results = _status(spark, sf_dir).withColumn("rows_new", F.lit(0))
    return merge.run_history(results, merge.upsert_stats(merged, ["state"])).select(
        "state", F.col("ok").cast("int").alias("ok"), "rows_parsed", "rows_new", "rows_updated"
    )


def _logged_runs(spark: SparkSession, sf_dir: str) -> str:
    """Two runs in a log, the first of them replayed; the second tries the sources with an open account only."""
    path = work_dir(spark, "runs")
    state = F.rtrim(F.substring_index("employer", " ", 1), F.lit(",")).alias("state")

    def work(new: str, updated: str, which: str):
        change = F.when(F.col("status") == new, "new").when(F.col("status") == updated, "updated")
        stats = merge.upsert_stats(filings(spark, sf_dir).select(state, change.alias("change")), ["state"])
        results = _status(spark, sf_dir).where(which)
        return results, stats.join(results.select("state"), "state", "left_semi")

    runs.logged_run(spark, path, "first", lambda: work("O", "F", "true"))
    runs.logged_run(spark, path, "second", lambda: work("F", "P", "status != 'unavailable'"))
    runs.logged_run(spark, path, "first", lambda: work("O", "F", "true"))
    return path


_RUN_SQL = _STATUS_SQL.rstrip() + """, changes AS (
  SELECT rtrim(split_part(employer, ' ', 1), ',') AS state, count(*) FILTER (status = 'O') AS o,
    count(*) FILTER (status = 'F') AS f, count(*) FILTER (status = 'P') AS p FROM filings GROUP BY 1),
results AS (
  SELECT 'first' AS run_id, s.*, coalesce(o, 0) AS rows_new, coalesce(f, 0) AS rows_updated FROM status s LEFT JOIN changes USING (state)
  UNION ALL SELECT 'second', s.*, coalesce(f, 0), coalesce(p, 0) FROM status s LEFT JOIN changes USING (state) WHERE status <> 'unavailable')
"""


@query("run_log", _RUN_SQL + """
SELECT run_id, count(*) AS states_attempted, cast(sum(ok) AS BIGINT) AS states_ok, count(*) FILTER (ok = 0) AS states_failed,
  cast(sum(rows_parsed) AS BIGINT) AS rows_parsed, cast(sum(rows_new) AS BIGINT) AS rows_new, cast(sum(rows_updated) AS BIGINT) AS rows_updated,
  1 AS in_order FROM results GROUP BY run_id""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(spark, _logged_runs(spark, sf_dir)).select(
        "run_id", "states_attempted", "states_ok", "states_failed", "rows_parsed", "rows_new", "rows_updated",
        (F.col("started_at") < F.col("finished_at")).cast("int").alias("in_order"))


@query("run_results", _RUN_SQL + "SELECT run_id, state, source_name, url, ok, rows_parsed, rows_new, rows_updated, error FROM results")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_results(spark, _logged_runs(spark, sf_dir)).select(
        "run_id", "state", "source_name", "url", F.col("ok").cast("int").alias("ok"), "rows_parsed", "rows_new", "rows_updated", "error")


@query("source_listing", """SELECT c_name AS state, c_mktsegment AS strategy, n_name AS source_name,
  'https://c.example.org/' || c_custkey AS url FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return search.list_sources(joined.select(
        F.col("c_name").alias("state"), F.col("c_mktsegment").alias("strategy"), F.col("n_name").alias("source_name"),
        F.concat(F.lit("https://c.example.org/"), F.col("c_custkey").cast("string")).alias("url"),
    ))


@query("source_selection", "SELECT s_name AS state, s_acctbal FROM supplier "
                           "WHERE s_name IN ('Supplier#000000001', 'Supplier#000000007')")
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "supplier").select(F.upper("s_name").alias("state"), "s_name", "s_acctbal")
    picked = search.select_sources(sources, ["supplier#000000001", " Supplier#000000007 "])
    return picked.select(F.col("s_name").alias("state"), "s_acctbal")


@query("period_urls", """
SELECT s_suppkey, year, 'https://s.example.org/' || s_suppkey || '/' || year AS url
FROM supplier, (SELECT unnest(range(2021, 2027)) AS year) WHERE s_acctbal >= 0
UNION ALL SELECT s_suppkey, NULL, 'https://s.example.org/' || s_suppkey FROM supplier WHERE s_acctbal < 0""")
def source_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("https://s.example.org/"), F.col("s_suppkey").cast("string"))
    sources = table(spark, sf_dir, "supplier").select(
        "s_suppkey", base.alias("url"),
        F.when(F.col("s_acctbal") >= 0, F.concat(base, F.lit("/{year}"))).alias("url_template"),
    )
    return period_urls(sources, "2026-06-01").select("s_suppkey", F.col("year").cast("bigint").alias("year"), "url")


_NAMES_SQL = ", ".join(f"('{c}', '{vocab.STATES[c]}')" for c in CODES)


@query("state_lookup", with_filings(f""", names(state, state_name) AS (VALUES {_NAMES_SQL})
SELECT state, count(*) AS n, state_name, state AS back FROM filings JOIN names USING (state) GROUP BY ALL"""))
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = filings(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))
    name = state_name("state")
    return named.select("state", "n", name.alias("state_name"), state_code(name).alias("back"))
