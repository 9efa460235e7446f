import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.operators import merge, rollup, runs, search
from docketlake.operators.funnel import conform
from docketlake.sources.tables import read_snapshot, write_snapshot
from docketlake.streaming import feed
from docketlake.streaming.feed import merge_batch

T1, T2 = "2024-01-01 00:00:00", "2024-06-01 00:00:00"


@pytest.fixture()
def batch(spark):
    def make(*rows):
        full = [{"state": "MD", "employer": "Acme Corp", "city": "Baltimore", "notice_date": date(2024, 1, 15),
                 "employees": 100, "county": None, "ix": i, **r} for i, r in enumerate(rows)]
        cols = ["state", "employer", "city", "notice_date", "employees", "county", "ix"]
        df = spark.createDataFrame([tuple(r[c] for c in cols) for r in full],
                                   "state string, employer string, city string, notice_date date, employees int, county string, ix long")
        return merge.dedupe_batch(merge.with_identity(conform(df, ["ix"])), ["ix"])

    return make


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], vocab.NOTICE_SCHEMA)


def stats(merged):
    return tuple(merge.upsert_stats(merged).first())


def test_upsert_sequence(empty, batch):
    first = merge.upsert(empty, batch({}, {}), T1)
    assert stats(first) == (1, 0)
    table = first.drop("change")
    again = merge.upsert(table, batch({}), T2)
    assert stats(again) == (0, 0)
    row = again.first()
    assert str(row.first_seen_at) == T1 and str(row.last_seen_at) == T2 and row.employer_key == "acme"
    filled = merge.upsert(table, batch({"county": "Baltimore County"}), T2)
    assert stats(filled) == (0, 1) and filled.first().county == "Baltimore County"
    assert stats(merge.upsert(table, batch({"employees": 250}), T2)) == (1, 0)
    assert stats(merge.upsert(empty, batch({}, {"employer": "Beta LLC"}), T1)) == (2, 0)
    assert merge.new_rows(batch({}), table).count() == 0
    assert merge.existing_rows(table, batch({})).count() == 1


def test_batch_order_decides_duplicates(batch, spark):
    rows = [{"county": "first"}, {"county": "second"}]
    assert batch(*rows).first().county == "first"
    # Permutation of the input rows does not matter, only ingest order does.
    swapped = batch(*rows).unionByName(batch(*rows)).orderBy(F.desc("county"))
    assert merge.dedupe_batch(swapped, ["ix"]).first().county == "first"


def test_deactivate(empty, batch, spark):
    table = merge.upsert(empty, batch({"employer": "Acme"}, {"employer": "Beta"}), T1).drop("change")
    seen = batch({"employer": "Acme"})
    out = merge.deactivate_missing(table, seen, seen)
    assert [r.employer for r in out.where("is_active").collect()] == ["Acme"]
    assert out.where("retired").count() == 1
    none_ok = spark.createDataFrame([], "state string")
    assert merge.deactivate_missing(table, seen, none_ok).where("retired").count() == 0


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash"), "id")
    out = merge.dedupe_batch(df, ["id"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20_001 and out.where("hash = 'hot'").first().id == 0


def test_summary_and_shares(spark):
    df = spark.createDataFrame([("MD", 100, date(2024, 1, 1)), ("MD", None, date(2024, 2, 1)), ("VA", 50, None)],
                               "state string, employees int, notice_date date")
    assert tuple(rollup.summary(df).first()) == (3, 150, 2, date(2024, 1, 1), date(2024, 2, 1))
    assert [tuple(r) for r in rollup.share_of_max(rollup.per_group(df)).orderBy("state").collect()] == [
        ("MD", 2, 100, 100.0), ("VA", 1, 50, 50.0)]
    shared = rollup.share_of_max(rollup.per_group(df))
    shared.collect()
    assert "ReusedExchange" in shared._jdf.queryExecution().executedPlan().toString()
    empty = df.limit(0)
    assert tuple(rollup.summary(empty).first())[:3] == (0, 0, 0)


def test_search(spark):
    df = spark.createDataFrame(
        [("a", "MD", "Acme 100%", None, "Retail", "Ode", 5, date(2024, 1, 1), True), ("b", "VA", "Beta", "x_y", None, "Ode", None, None, False)],
        "hash string, state string, employer string, notes string, industry string, city string, employees int, notice_date date, is_active boolean")
    hashes = lambda **f: [r.hash for r in search.search(df, **f).collect()]
    assert hashes() == ["a", "b"] and hashes(order="notice_date_asc") == ["b", "a"]
    assert hashes(query="RETAIL") == ["a"] and hashes(query="0%") == ["a"] and hashes(query="x%y") == []
    assert hashes(query="x%y", wildcards=True) == ["b"] and hashes(query="\\", wildcards=True) == []
    assert hashes(state="va", city=" ode ") == ["b"] and hashes(min_employees=1) == ["a"] and hashes(active_only=True) == ["a"]
    assert hashes(page=2, per_page=1) == ["b"] and hashes(page=-3, per_page=1) == ["a"]
    assert tuple(search.search_total(df, query="nope").first()) == (0, 1)
    with pytest.raises(KeyError, match="QQ"):
        search.select_sources(df, ["md", "qq"])
    assert search.select_sources(df, ["va", "MD"]).count() == 2


def test_search_pushes_filters_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "MD", date(2024, 1, 1), 5, "x")], "hash string, state string, notice_date date, employees int, notes string").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = search.search_filter(spark.read.parquet(path), state="md", since="2024-01-01", min_employees=3).select("hash")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(notice_date" in text and "EqualTo(state,MD)" in text and "notes" not in text
    page = search.search(spark.read.parquet(path), order="x")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page


def test_snapshots_and_replay(spark, tmp_path, batch):
    path = str(tmp_path / "table")
    rows = [batch({"employer": "Acme"}, {"employer": "Beta"}), batch({"employer": "Acme"})]
    for i, stamp in enumerate((T1, T2)):
        merge_batch(rows[i], i, path, stamp, ["ix"], full_snapshot=True)
    once = {(r.employer, r.is_active, str(r.first_seen_at)) for r in read_snapshot(spark, path).collect()}
    merge_batch(rows[1], 1, path, T2, ["ix"], full_snapshot=True)
    again = {(r.employer, r.is_active, str(r.first_seen_at)) for r in read_snapshot(spark, path).collect()}
    assert once == again == {("Acme", True, T1), ("Beta", False, T1)}
    # A batch of another state leaves the files of this one alone.
    before = set(read_snapshot(spark, path).inputFiles())
    merge_batch(batch({"state": "VA"}), 2, path, T2, ["ix"])
    after = set(read_snapshot(spark, path).inputFiles())
    assert before < after and read_snapshot(spark, path).count() == 3
    # A version without its success marker does not count.
    target = write_snapshot(read_snapshot(spark, path).withColumn("employer", F.lit("lost")), path, 9)
    os.remove(f"{target}/_SUCCESS")
    assert read_snapshot(spark, path).where("employer = 'lost'").count() == 0


def test_odd_states_and_a_second_checkpoint_keep_the_history(spark, tmp_path, batch):
    path = str(tmp_path / "table")
    merge_batch(batch({"state": None, "employer": "Acme"}, {"state": "A/B =%", "employer": "Beta"}), 0, path, T1, ["ix"])
    merge_batch(batch({"state": None, "employer": "Gamma"}, {"state": "A/B =%", "employer": "Delta"}), 1, path, T1, ["ix"])
    # Another stream counts its batches from 0 again.
    merge_batch(batch({"state": "MD", "employer": "Epsilon"}), 0, path, T2, ["ix"], stream="other")
    merge_batch(batch({"state": None, "employer": "Zeta"}), 0, path, T2, ["ix"], stream="third")
    got = {(r.state, r.employer) for r in read_snapshot(spark, path).collect()}
    assert got == {(None, "Acme"), (None, "Gamma"), (None, "Zeta"), ("A/B =%", "Beta"), ("A/B =%", "Delta"), ("MD", "Epsilon")}


def test_source_status(spark):
    sources = spark.createDataFrame([("MD", ""), ("VA", None), ("WY", "does not publish")], "state string, unavailable string")
    counts = spark.createDataFrame([("MD", 3, 10), ("WY", 1, 1)], "state string, rows_parsed long, workers long")
    got = {r.state: (r.status, r.error) for r in rollup.source_status(sources, counts).collect()}
    assert got == {"MD": ("ok", None), "VA": ("failed", "parsed 0 usable rows"), "WY": ("unavailable", "does not publish")}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("MD", date(2024, 1, 2)), ("VA", None)], "state string, notice_date date").withColumn("is_active", F.lit(True))
    out = search.export_rows(df, ["md", "va"], columns=("state", "notice_date"))
    assert [r.state for r in out.collect()] == ["MD", "VA"]
    search.write_export(out.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines()[:2] == ["state,notice_date", "MD,2024-01-02"]
    search.write_export(out.coalesce(1), str(tmp_path / "j"), "json")
    assert '"notice_date":null' in next((tmp_path / "j").glob("*.json")).read_text()


def test_runs_are_logged_once_however_often_they_are_replayed(spark, tmp_path):
    path = str(tmp_path / "runs")
    report = spark.createDataFrame(
        [("MD", "u1", 3, None), ("MD", "u1", 0, "not followed"), ("VA", "u2", 0, "no table"), ("VA", "u2", 2, None), ("ZZ", None, 0, "error status")],
        "state string, url string, n_records long, reason string")
    stats = spark.createDataFrame([("MD", 2, 1)], "state string, rows_new long, rows_updated long")
    for run in ("a", "b", "a"):
        runs.logged_run(spark, path, run, lambda: (runs.source_results(report), stats))
    log = {r.run_id: r for r in runs.runs(spark, path).collect()}
    assert set(log) == {"a", "b"}
    assert tuple(log["a"])[2:8] == (3, 1, 2, 5, 2, 1) and log["a"].started_at < log["a"].finished_at and log["a"].notes is None
    rows = {(r.run_id, r.state): (r.url, r.ok, r.rows_parsed, r.rows_new, r.error) for r in runs.run_results(spark, path).collect()}
    assert len(rows) == 6 and rows["b", "MD"] == ("u1", True, 3, 2, None)
    assert rows["a", "VA"] == ("u2", False, 2, 0, "no table") and rows["a", "ZZ"] == (None, False, 0, 0, "error status")


def test_a_run_that_fails_is_logged_with_its_error(spark, tmp_path):
    path = str(tmp_path / "runs")

    def broken():
        raise OSError("disk gone")

    with pytest.raises(OSError):
        runs.logged_run(spark, path, "x", broken)
    row = runs.runs(spark, path).first()
    assert row.notes == "OSError: disk gone" and row.states_attempted == 0 and runs.run_results(spark, path).count() == 0
    with pytest.raises(ValueError):
        runs.logged_run(spark, path, "../x", broken)


def test_kept_rows_are_the_missing_ones(spark):
    from docketlake.operators.merge import deactivate_missing, retire_kept

    kind = "hash string, state string, is_active boolean, change string"
    merged = spark.createDataFrame([("a", "MD", True, "kept"), ("b", "MD", True, "seen"), ("c", "VA", True, "kept"), ("d", "MD", False, "kept"),
                                    ("e", None, True, "kept")], kind)
    batch = spark.createDataFrame([("b", "MD")], "hash string, state string")
    got = retire_kept(merged, batch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, deactivate_missing(merged, batch, batch).select(got.columns).collect()))
    assert {r.hash for r in got.where("retired").collect()} == {"a"}


def test_hashes_of_a_batch_are_not_broadcast(spark, tmp_path):
    keys = spark.range(20000).select(F.sha1(F.col("id").cast("string")).alias("hash"), "id")
    some = keys.where("id < 3000")
    found = merge.maybe_existing_rows(keys, some, 3000)
    assert found.where("id < 3000").count() == 3000 and found.where("id >= 3000").count() < 17000 / 8
    assert merge.maybe_existing_rows(keys, some.where("id < 0"), 0).count() == 0
    # What passes without being in the batch stays as it was: first sightings, stamps and the number of rows.
    path = str(tmp_path / "table")
    plain = keys.where("id < 400").select(
        F.lit("MD").alias("state"), F.concat(F.lit("Plant "), F.col("id").cast("string")).alias("employer"), "id")
    for b, (low, high) in enumerate([(0, 300), (250, 400), (0, 1)]):
        merge_batch(conform(plain.where(F.col("id").between(low, high - 1)), ["id"]), b, path, f"2024-06-0{b + 1} 12:00:00", ["id"])
    out = read_snapshot(spark, path, schema=vocab.NOTICE_SCHEMA)
    got = {tuple(r)[:2]: r[2] for r in out.groupBy(F.dayofmonth("first_seen_at"), F.dayofmonth("last_seen_at")).count().collect()}
    assert got == {(1, 1): 249, (1, 2): 50, (2, 2): 100, (1, 3): 1}


def test_a_landed_file_is_dealt_before_it_is_sorted(spark, tmp_path, monkeypatch):
    rows = conform(spark.range(100).select(F.lit("MD").alias("state"), F.concat(F.lit("Plant "), F.col("id").cast("string")).alias("employer"), "id"),
                   [F.col("id").alias("ingest_ix")])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    monkeypatch.setattr(feed, "merge_batch", lambda batch, *_: seen.append((batch.count(), batch.rdd.getNumPartitions())))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    feed.ingest(stream, str(tmp_path / "table"), str(tmp_path / "state"), "2024-06-01 12:00:00").awaitTermination()
    assert seen == [(100, 4 * spark.sparkContext.defaultParallelism)]
