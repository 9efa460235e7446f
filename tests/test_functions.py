from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samples import AS_OF
from docketlake.functions import category, dates, identity, numbers, places, text

DAY = date(2022, 8, 9)


def test_date_texts(cells):
    shown = [
        "8/9/2022", "08/09/2022", "2022-08-09", "August 9, 2022", "09-Aug-22", "Aug 9 2022", "2022-08-09T06:30:00", "20220809",
        "Tuesday, August 9, 2022", "8/9/2022 4:15 pm", "8.9.2022", "9 August 2022", "filed 8/9/2022",
    ]
    assert cells(lambda c: dates.parse_date(c, AS_OF), shown) == [DAY] * len(shown)
    assert cells(lambda c: dates.parse_date(c, AS_OF), ["29/8/2022"]) == [date(2022, 8, 29)]


def test_date_special_shapes(cells):
    got = cells(lambda c: dates.parse_date(c, AS_OF), [
        "5/1/25 - 6/30/25", "from 9/30/2025", "7/4/99", "Sept 12, 2021", "Jul 2023", "2-2025"])
    assert got == [date(2025, 5, 1), date(2025, 9, 30), date(1999, 7, 4), date(2021, 9, 12), date(2023, 7, 1), date(2025, 2, 1)]


def test_date_rejects(cells):
    bad = ["", " ", None, "pending", "in spring", "n/a", "unk", "--", "2021", "8/9/1901", "8/9/2077", "44782",
           "4/31/2022", "20221399", "2060-05-05", "August 9"]
    assert cells(lambda c: dates.parse_date(c, AS_OF), bad) == [None] * len(bad)


def test_date_dayfirst(cells):
    assert cells(lambda c: dates.parse_date(c, AS_OF, dayfirst=True), ["9/8/2022", "8/29/2022"]) == [DAY, date(2022, 8, 29)]


def test_date_numbers(cells):
    got = cells(lambda c: dates.parse_date_number(c, AS_OF), [20220809.0, 44782.0, float("nan"), 12.0, 99999999999.0],
                "double")
    assert got == [DAY, DAY, None, None, None]


def test_counts(cells):
    got = cells(numbers.parse_count, ["2,018", "31 jobs", "some 12", "7-19", "0", "2.5", "2,018 to 8765432", "３５"])
    assert got == [2018, 31, 12, 19, 0, 2, 2018, 35]
    bad = ["pending", "none", "", None, "unk", "Closed", "8765432"]
    assert cells(numbers.parse_count, bad) == [None] * len(bad)
    assert cells(numbers.count_from_number, [31.0, 12.0, 2.5, 3.5, -1.0, None], "double") == [31, 12, 2, 4, None, None]
    assert cells(numbers.first_count, ["240 EFFECTIVE DATES: 5/1/20255", None, "many"]) == [240, None, None]


@pytest.mark.parametrize("mode", ["jvm", "exact"])
def test_clean_text(cells, mode):
    got = cells(lambda c: text.clean_text(c, unicode=mode), [
        " Tern \t Foods\n", "Tern\u00a0Foods", "NULL", "--", "Pending", " ", "not reported", "#n/a", None, "Ｔｅｒｎ\u200b",
        "½ ﬁ…", "été"])
    assert got == ["Tern Foods", "Tern Foods"] + [None] * 7 + ["Tern", "1⁄2 fi...", "été"]
    assert cells(lambda c: text.clean_text(c, 5, mode), ["abcdefgh"]) == ["abcde"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Mn", "Mc", "Lo"]), max_size=20), min_size=1, max_size=40))
def test_jvm_folding_equals_exact(cells, values):
    values = [v.replace("\x00", "") for v in values]
    assert cells(lambda c: text.clean_text(c), values) == cells(lambda c: text.clean_text(c, unicode="exact"), values)


def test_employer_key(cells):
    got = cells(text.employer_key, [
        "Tern Foods Co.", "TERN FOODS COMPANY", "Tern LLC dba Gull Foods", "Tarn Co", "P & Q, L.L.C.",
        "Tern Holdings Inc", "Group", "X inc llc corp ltd", "Tern f/k/a Old", None, "Café Olé", "ﬁrst Ａ"])
    assert got == ["tern foods", "tern foods", "tern", "tarn", "p and q l l c", "tern", "group", "x inc", "tern", "", "cafe ole", "first a"]


def test_classify_type(cells):
    got = cells(category.classify_type, [
        "Mill shuts down", "furlough", "closing with layoffs", "c", "L", "cl/lo", "Downsizing", None, " ",
        "o'neil's move", "TBD"])
    assert got == ["Closure", "Layoff", "Closure and Layoff", "Closure", "Layoff", "Closure and Layoff", "Layoff",
                   None, None, "O'Neil'S Move", None]


def test_places(cells):
    shown = ["Salisbury, MD", "Foo ZZ", "40 Canal Street Salisbury, MD 21801"]
    assert cells(places.strip_state, shown) == ["Salisbury", "Foo ZZ", shown[2]]
    assert cells(places.embedded_state, shown) == ["MD", None, None]
    assert cells(places.is_full_address, shown) == [False, False, True]
    assert cells(places.address_zip, shown) == [None, None, "21801"]
    assert cells(text.clean_zip, ["MD 02139-1234", "1234", None]) == ["02139", None, None]
    assert cells(text.drop_bare_code, ["313210", "Retail 44"]) == [None, "Retail 44"]
    assert cells(places.state_name, ["MD", "ZZ"]) == ["Maryland", ""]
    assert cells(places.state_code, ["Puerto Rico", "x"]) == ["PR", None]


def test_lists_and_params(cells):
    assert cells(lambda c: text.split_list(c, "upper"), [" md, ,va ", None]) == [["MD", "VA"], []]
    assert cells(text.state_codes, ["md va,dc", "all", ""]) == [["MD", "VA", "DC"], None, None]
    assert cells(numbers.int_param, ["12", "x", "", None]) == [12, None, None, None]
    assert cells(numbers.date_param, ["2022-08-09", "2022-13-40", "soon"]) == [DAY, None, None]
    assert cells(text.thousands, [1234, None], "int") == ["1,234", "—"]


def test_record_hash(spark):
    rows = [(0, "VA", "Tern Foods Co.", "Suffolk", DAY, None, 31),
            (1, "VA", "TERN FOODS COMPANY", "suffolk", DAY, None, 31),
            (2, "VA", "Tern Foods", "Suffolk", DAY, None, 32)]
    df = spark.createDataFrame(rows, "i int, state string, employer string, city string, notice_date date, effective_date date, employees int")
    import hashlib

    got = [r.h for r in df.select("i", identity.record_hash().alias("h")).orderBy("i").collect()]
    assert got[0] == got[1] == hashlib.sha1(b"VA|tern foods|suffolk|2022-08-09||31").hexdigest()
    assert got[2] != got[0]


def test_no_python_in_the_default_cleaners(spark):
    df = spark.createDataFrame([("x",)], "v string").select(
        text.clean_text("v"), text.employer_key("v"), dates.parse_date("v", AS_OF), numbers.parse_count("v"),
        category.classify_type("v"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_first_date_in_reading_order_wins(cells):
    as_of = "2026-06-01"
    got = cells(lambda c: dates.parse_date(c, as_of), [
        "August 9, 2022 - 9/1/2022", "9 August 2022 through 2022-10-01", "2022-10-01 to August 9, 2022", "x" * 300 + " 9/1/2022"])
    assert [str(d) for d in got] == ["2022-08-09", "2022-08-09", "2022-10-01", "2022-09-01"]


def test_texts_are_cut_only_on_request(cells):
    assert cells(text.clean_text, ["a" * 2000]) == ["a" * 2000]
    assert cells(lambda c: text.clean_text(c, 5), ["a" * 2000]) == ["aaaaa"]
