from datetime import date

from pyspark.sql import functions as F

from samples import AS_OF
from docketlake.operators import blocks
from docketlake.plans.ingest import HANDLERS, handler, period_urls, records_from_sources
from docketlake.sources import links
from docketlake.sources.json_rows import flat_cells, json_frames, walk
from docketlake.sources.payload import looks_delimited, payload_kind


def test_labelled_panel(cells):
    got = cells(blocks.split_labels, [
        "8 Quarry Lane, Milford, PA 18337 COUNTY: Pike # AFFECTED: 31 EFFECTIVE DATE: from 9/30/2025 CLOSURE OR LAYOFF: Layoff",
        "Dock 4, Erie COUNTIES: Erie # AFFECTED: 240 EFFECTIVE DATES: 5/1/20255 to 6/1/2025 UNION: none",
        "no labels here"])
    assert got[0]["county"] == "Pike" and got[0]["affected"] == "31" and got[0]["closureorlayoff"] == "Layoff"
    assert got[0]["_address"].startswith("8 Quarry Lane")
    assert got[1]["affected"] == "240" and got[1]["effectivedate"].startswith("5/1/20255")
    assert got[2] == {"_address": "no labels here"}


def test_heading_context(spark):
    rows = [("d", 0, "heading", "2023"), ("d", 1, "title", "April"), ("d", 2, "title", "Quarry Works"), ("d", 3, "panel", "x"),
            ("d", 4, "heading", "2022"), ("d", 5, "panel", "y"), ("e", 0, "panel", "z")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string")
    for size in (1, 2, 100):
        got = {(r.doc_id, r.pos): (r.year, r.month) for r in blocks.heading_context(df, size).collect()}
        assert got["d", 3] == (2023, 4) and got["d", 5] == (2022, None) and got["e", 0] == (None, None)


def test_carry_forward_splits_a_hot_key(spark):
    df = spark.range(9000).select(F.lit("hot").alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 700 == 5, F.col("id")).alias("v"))
    out = blocks.carry_forward(df, ["k"], ["pos"], "v", "last", F.floor(F.col("pos") / 100))
    bad = out.where("pos >= 5 and last != (floor((pos - 5) / 700) * 700 + 5)").count()
    assert bad == 0 and out.where("last is null").count() == 5


def test_smeared_row(spark):
    rows = spark.createDataFrame([("d", 1, ["2/3/2025", "4/4/2025Clos", "ure", "12Harbor Li", "ght C", "o", "Sparks", "Washoe", "WARN"]),
                                  ("d", 1, ["5/6/2025", "6/7/2025Lay", "off unknownTin Roof", "", "Elko", "Elko", "Non-WARN"]),
                                  ("d", 1, ["Filed", "p", "q", "r", "s", "t"])], "doc_id string, page int, cells array<string>")
    lines = spark.createDataFrame([("d", 1, 0, "List"), ("d", 1, 1, "5/6/2025 6/7/2025Layoff unknownTin Roof Diner Elko Elko Non-WARN")],
                                  "doc_id string, page int, line_ix int, line string")
    got = {r.employer: r for r in blocks.smeared_rows(rows, lines, AS_OF).collect()}
    assert got["Harbor Light Co"].employees == 12 and got["Harbor Light Co"].effective_date == date(2025, 4, 4)
    assert got["Harbor Light Co"].notes is None
    other = got["Tin Roof Diner"]
    assert other.employees is None and other.city == "Elko" and other.notice_type == "Layoff" and other.notes


def test_link_names_and_paths(cells):
    assert cells(links.link_employer, ["Harbor Light Co WARN 5-6-25", "Revised Notice - Tin Roof Diner", "Quarry Works Letter 12-1-24"]) == [
        "Harbor Light Co", "Tin Roof Diner", "Quarry Works"]
    assert cells(links.path_date, ["/files/2025/05/harbor.pdf", "/files/2024/31/tin.pdf", "/files/quarry.pdf"]) == [
        date(2025, 5, 1), date(2024, 1, 1), None]


def test_absolute_urls(cells):
    base = F.lit("https://h.org/a/b/page?x=1#f")
    got = cells(lambda c: links.absolute_url(base, c), ["/r", "s", "../t/./u?q", "?z=2", "//o.org/p", "http://k/x", "#top", "../../../v"])
    assert got == ["https://h.org/r", "https://h.org/a/b/s", "https://h.org/a/t/u?q", "https://h.org/a/b/page?z=2",
                   "https://o.org/p", "http://k/x", "https://h.org/a/b/page?x=1#top", "https://h.org/v"]


def test_filings_beside_links(spark):
    html = ('<ul><li><a href="/d/warn/nilfisk.pdf">Nilfisk Inc.</a> - 12/10/25 Revised</li>'
            '<li>11/2/25 <a href="/d/warn/b.pdf">Beta Works</a></li>'
            '<li><a href="/d/2026/08/warn-c.pdf">Gamma <b>Mill</b></a></li><li><a href="/guide-warn.pdf">Employer guide</a></li>'
            '<li><a href="/d/2026/08/warn-c2.pdf">GAMMA MILL</a></li></ul>')
    page = spark.createDataFrame([("p", "https://h.org/x", html)], "doc_id string, url string, html string")
    got = sorted((r.employer, r.notice_date) for r in links.filings_from_links(links.anchors(page, context=True), AS_OF, ("doc_id",)).collect())
    assert got == [("Beta Works", date(2025, 11, 2)), ("Gamma Mill", date(2026, 8, 1)), ("Nilfisk Inc", date(2025, 12, 10))]


def test_detail_count(cells):
    html = '<dl><dt>Company</dt><dd>7 Eleven</dd><dt>Number of Employees Affected</dt><dd><b>TBD</b></dd><strong>Planned number</strong> <span>39</span></dl>'
    assert cells(blocks.detail_count, [html, "<p>39</p>"]) == [39, None]


def test_payload_kinds(cells):
    kind = lambda url: (lambda c: payload_kind(c.cast("binary"), F.lit(url)))
    assert cells(kind("http://x/f"), ["%PDF-1.4", "<!doctype html><p>", ' {"a":1}', "a,b,c\n1,2,3", "plain"]) == ["pdf", "html", "json", "csv", "html"]
    assert cells(kind("http://x/f.XLS?q"), ["zzz"]) == ["xls"]
    assert cells(looks_delimited, ["a|b|c\n1|2|3", "a,b\n1,2", "a;b;c", "<a,b,c\n1,2,3"]) == [True, False, False, False]


def test_json_paths_and_flattening(spark, cells):
    doc = '{"n": 1, "a": {"0": [{"k": {"x": {"y": 5}, "z": "n/a"}, "tags": [" q ", null, 3], "d": 20240314}, {"late": true}]}}'
    assert cells(lambda c: walk(c, ("a", "0", "1", "late")), [doc]) == ["true"]
    got = cells(lambda c: F.transform(flat_cells(walk(c, ("a", "0", "0"))), lambda e: F.struct(e["key"], e["s"], e["n"])), [doc])[0]
    assert {tuple(e) for e in got} == {("k_x_y", "5", 5.0), ("k_z", "n/a", None), ("tags", "q, , 3", None), ("d", "20240314", 20240314.0)}
    frame = json_frames(spark.createDataFrame([("d", doc)], "doc_id string, text string"), ("a", "0")).first()
    assert frame.headers == ["k_x_y", "k_z", "tags", "d", "late"] and frame.rows[1].cells == [None, None, None, None, "true"]


def test_periods_and_registry(spark):
    src = spark.createDataFrame([("MD", "u", "u/{year}", None), ("VA", "v", None, None), ("DC", "w", "w/{year}", [2019, 2024])],
                                "state string, url string, url_template string, years array<int>")
    got = [(r.state, r.year, r.url) for r in period_urls(src, "2023-05-01").collect()]
    assert got == [("MD", 2023, "u/2023"), ("MD", 2022, "u/2022"), ("MD", 2021, "u/2021"), ("DC", 2024, "w/2024"), ("DC", 2019, "w/2019"), ("VA", None, "v")]

    @handler("zz")
    def own(payloads, as_of):
        return payloads.selectExpr("doc_id", "'own' as employer", "state", "10 as employees")

    rows = [("p", "u1", bytearray(b"<table><tr><th>Company</th><th>Employees</th></tr><tr><td>Acme</td><td>5</td></tr></table>"), "MD"),
            ("q", "u2", bytearray(b"anything"), "ZZ")]
    landed = spark.createDataFrame(rows, "doc_id string, url string, content binary, state string").selectExpr(
        "*", "'' as content_type", "200 as status", "'s' as source_name", "url as source_url")
    got = records_from_sources(landed, AS_OF).collect()
    del HANDLERS["ZZ"]
    assert sorted((r.doc_id, r.employer, r.employees) for r in got) == [("p", "Acme", 5), ("q", "own", 10)]


def test_carry_forward_keeps_null_keys_and_carries_several_values(spark):
    df = spark.createDataFrame([(None, 0, 1, None), (None, 1, None, 5), ("k", 0, None, 7), ("k", 9, 3, None)], "k string, pos int, v int, w int")
    out = blocks.carry_forward(df, ["k"], ["pos"], ["v", "w"], ["last_v", "last_w"], F.floor(F.col("pos") / 2))
    assert sorted(((r.k, r.pos, r.last_v, r.last_w) for r in out.collect()), key=str) == sorted(
        [(None, 0, 1, None), (None, 1, 1, 5), ("k", 0, None, 7), ("k", 9, 3, 7)], key=str)
