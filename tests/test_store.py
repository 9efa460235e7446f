"""The stored history over many batches: runs, folding, commits, vacuum."""

import json
import math
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.operators.funnel import conform
from docketlake.operators.merge import upsert
from docketlake.sources import tables
from docketlake.streaming.feed import merge_batch

DAYS = [f"2024-03-{d:02d} 00:00:00" for d in range(1, 29)]


@pytest.fixture()
def notices(spark):
    def make(pairs):
        rows = [(state, employer, date(2024, 1, 15), 10, i) for i, (state, employer) in enumerate(pairs)]
        return conform(spark.createDataFrame(rows, "state string, employer string, notice_date date, employees int, ix long"), ["ix"])

    return make


def read(spark, path, **kw):
    return {(r.state, r.employer): r for r in tables.read_snapshot(spark, path, schema=vocab.NOTICE_SCHEMA, **kw).collect()}


def test_runs_grow_geometrically():
    runs, written, n = {}, 0, 200
    for _ in range(n):
        folded = tables.folding(runs, {7: 1})
        rows = 1 + sum(k for _, k in folded.get(7, []))
        left = len(runs.get(7, [])) - len(folded.get(7, []))
        runs[7] = [*runs.get(7, [])[:left], ("f", rows)]
        written += rows
        assert len(runs[7]) <= 1 + math.log2(n)
    assert sum(k for _, k in runs[7]) == n and written <= n * (2 + math.log2(n))
    # A small batch leaves a large run alone, a large one takes the small ones along, other buckets stay.
    layers = {7: [("a", 1000), ("b", 4)], 8: [("a", 1)]}
    assert tables.folding(layers, {7: 1}) == {}
    assert tables.folding(layers, {7: 2}) == {7: [("b", 4)]}
    assert tables.folding(layers, {7: 600}) == {7: [("a", 1000), ("b", 4)]}
    assert tables.folding(layers, {}) == {} and tables.folding({}, {3: 5}) == {}


def test_many_batches_equal_one_upsert_after_another(spark, tmp_path, notices):
    path = str(tmp_path / "table")
    big = [("MD", f"Firm {i}") for i in range(300)]
    want = {k: (DAYS[0], DAYS[0], True) for k in big}
    merge_batch(notices(big), 0, path, DAYS[0], ["ix"])
    for b in range(1, 7):
        pairs = [("MD", f"Firm {b}"), ("MD", f"New {b}"), ("MD", f"New {b}"), ("VA", "Often"), (None, f"Odd {b}")]
        merge_batch(notices(pairs), b, path, DAYS[b], ["ix"])
        for k in pairs:
            want[k] = (want.get(k, (DAYS[b],))[0], DAYS[b], True)
    got = {k: (str(r.first_seen_at), str(r.last_seen_at), r.is_active) for k, r in read(spark, path).items()}
    assert got == want
    version, runs = tables.manifest(spark, path)
    assert version == 7 and len(tables.versions(spark, path)) == tables.KEPT
    # The first batch's run still lies where it was written: later batches were small beside it.
    md = next(iter({r[0] for r in spark.createDataFrame([("MD",)], "state string").select(tables.part_of("state")).collect()}))
    assert runs[md][0][1] == 300 and len(runs[md]) <= 4
    # Earlier versions that are kept can still be read.
    assert ("MD", "New 6") not in read(spark, path, before=7) and ("MD", "New 5") in read(spark, path, before=7)


def test_only_manifests_count_and_vacuum_removes_the_rest(spark, tmp_path, notices):
    path = str(tmp_path / "table")
    for b in range(3):
        merge_batch(notices([("MD", "Acme")]), b, path, DAYS[b], ["ix"])
    rows = tables.read_snapshot(spark, path, schema=vocab.NOTICE_SCHEMA)
    lost = tables.write_snapshot(rows.withColumn("employer", F.lit("lost")), path, 4, "lost")
    assert set(read(spark, path)) == {("MD", "Acme")}
    for b in range(3, 9):
        merge_batch(notices([("MD", "Acme")]), b, path, DAYS[b], ["ix"])
    assert not os.path.exists(lost)
    folders = {n for n in os.listdir(path) if n.startswith("version=")}
    assert len(folders) == tables.KEPT and len(read(spark, path)) == 1
    assert str(read(spark, path)["MD", "Acme"].first_seen_at) == DAYS[0]
    # A second writer of a version does not replace the first.
    version, runs = tables.manifest(spark, path)
    again = tables.write_snapshot(rows_of(spark, path), path, version)
    with pytest.raises(RuntimeError, match="somebody else"):
        tables.commit_snapshot(spark, path, version, again, {}, runs)
    with open(f"{path}/_manifest/{version:010d}.json") as f:
        assert {int(p) for p in json.load(f)} == set(runs)


def rows_of(spark, path):
    return tables.read_snapshot(spark, path, schema=vocab.NOTICE_SCHEMA)


def test_retired_and_revived_rows_are_written_alone(spark, tmp_path, notices):
    path = str(tmp_path / "table")
    names = [("MD", f"Firm {i}") for i in range(40)]
    merge_batch(notices(names), 0, path, DAYS[0], ["ix"])
    merge_batch(notices([("VA", "Other")]), 1, path, DAYS[1], ["ix"])
    # A listing without two firms retires them and nothing of another state; its return revives one.
    merge_batch(notices(names[2:]), 2, path, DAYS[2], ["ix"], full_snapshot=True)
    assert {k for k, r in read(spark, path).items() if not r.is_active} == set(names[:2])
    merge_batch(notices(names[:1]), 3, path, DAYS[3], ["ix"])
    got = read(spark, path)
    assert {k for k, r in got.items() if not r.is_active} == {names[1]} and len(got) == 41
    assert str(got[names[0]].first_seen_at) == DAYS[0] and str(got[names[1]].last_seen_at) == DAYS[0]


def test_empty_batch_and_empty_table(spark, tmp_path, notices):
    path = str(tmp_path / "table")
    merge_batch(notices([("MD", "Acme")]).where("false"), 0, path, DAYS[0], ["ix"])
    assert tables.read_snapshot(spark, path) is None and tables.versions(spark, path) == [] and tables.vacuum(spark, path) == 0
    assert upsert(spark.createDataFrame([], vocab.NOTICE_SCHEMA), spark.createDataFrame([], vocab.NOTICE_SCHEMA), DAYS[0]).count() == 0
