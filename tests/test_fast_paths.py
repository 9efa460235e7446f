"""Short paths give what the whole computation gives."""

import json

from pyspark.sql import functions as F

from docketlake.functions import dates, text
from docketlake.operators import frames, funnel, headers
from docketlake.sources import html
from docketlake.sources.json_rows import json_frames

ODD = ["", " ", "a", " a", "a ", "a  b", "a\tb", "a b", "​a", "n/a", " N/A ", "TBD", "TBD.", "Zoë", "é  é", None, "a b c"]


def test_cells_are_cleaned_as_texts(spark):
    df = spark.createDataFrame([(ODD,)], "c array<string>")
    row = df.select(F.transform("c", text.clean_cell).alias("a"),
                    F.transform("c", lambda c: text.clean_text(c, unicode="done")).alias("b")).first()
    assert row.a == row.b


def test_usual_dates_are_read_as_dates_in_text(spark):
    days = ["3/14/1995", "13/2/2001", "2/13/2001", "2-3-1999", "2.3/1999", "31/4/2001", "1/1/1850", "1/1/2999", "99/99/2000", "3/14/1995\n", "n/a", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    for first in (False, True):
        # A comma around the date keeps it off the short path.
        got = df.select(dates.parse_date("d", "2026-06-01", first).alias("a"),
                        dates.parse_date(F.concat(F.col("d"), F.lit(" ,")), "2026-06-01", first).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]


def test_no_mapped_row_is_passed_over(spark):
    rows = [["Emp(x)loyer", "1"], ["l&i", "2"], ["Customer 1", "3/4/2001"], ["a", "(company", "b)"], ["Notice Date"], [None, "Town"], [], [""]]
    df = spark.createDataFrame([(r,) for r in rows], "c array<string>")
    got = df.select(headers.may_name_fields(F.col("c")).alias("may"), F.size(headers.map_headers("c")).alias("n")).collect()
    assert all(r.may for r in got if r.n > 0)
    assert not got[2].may


def test_repeated_header_is_told_by_the_frames_mapping(spark):
    head = ["Company", "City", "Notice Date", "Employees"]
    df = spark.createDataFrame([(c, head) for c in (head, ["Acme", "Town", "3/4/2001", "12"], ["Employer", "Town", "Date Received", "Workers"],
                                                    ["Company", "City", None, "Notice Date"])], "c array<string>, h array<string>")
    for overrides in (None, {"City": "county"}):
        mapped = df.withColumn("m", headers.map_headers("h", overrides))
        got = mapped.select(funnel.is_repeated_header("c", F.col("h"), F.col("m")).alias("a"), funnel.is_repeated_header("c").alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] == [True, False, True, True]


def test_mapping_is_that_of_the_named_headers(spark):
    page = lambda head: f"<table><tr>{head}</tr><tr><td>Acme</td><td>Town</td><td>1/2/2001</td></tr></table>"
    pages = spark.createDataFrame([
        ("plain", page("<th>Company</th><th>City</th><th>Notice Date</th>")),
        ("blank", page("<th>Company</th><th></th><th>Notice Date</th>")),
        ("twice", page("<th>Company</th><th>Company</th><th>Notice Date</th>")),
        ("short", page("<th>Company</th><th>City</th>"))], "doc_id string, html string")
    for overrides in (None, {"Company": "union_name"}):
        shaped = frames.shape_frames(html.html_frames(pages), "web", overrides)
        got = shaped.select("mapping", headers.map_headers("headers", overrides).alias("m")).collect()
        assert len(got) == 4 and all(r.mapping == r.m for r in got)


def test_large_pages_are_scanned_as_small_ones(monkeypatch):
    page = ("<p>x<table><tr><th a='>' colspan=2>A&amp;B<!-- <td> --></th><td x=a=b>c<br>d</td></tr><script><td></script>"
            "<tr><td><a href=/x>1</a><table><tr><td>in</td></tr></table></td></tr></table>tail")
    small = html._tables(page)
    monkeypatch.setattr(html, "OUT_CHARS", 0)
    assert html._tables(page) == small
    assert [[list(html._rectangle(t))] for t in small][0][0][0] == (["A&B", "A&B", "c d"], None)


def test_json_slots_take_the_last_value_of_a_key(spark):
    rows = '[{"a": 1, "b": "x", "a": 2}, {"b": "y"}, {"c": {"d": 3}, "a": "z"}]'
    df = spark.createDataFrame([("d", json.dumps({"n": 1})), ("e", rows)], "doc_id string, text string")
    frame = json_frames(df.where("doc_id = 'e'")).first()
    at = {k: i for i, k in enumerate(frame.headers)}
    cells = [[r.cells[at[k]] for k in ("a", "b", "c_d")] for r in frame.rows]
    assert cells[1:] == [[None, "y", None], ["z", None, "3"]] and cells[0][1:] == ["x", None]
    assert [r.nums[at["c_d"]] for r in frame.rows] == [None, None, 3.0]
