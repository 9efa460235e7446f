"""Records that are not tables: labelled panels, headings, positional lists,
smeared rows, detail pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.category import classify_type
from docketlake.functions.dates import month_number, month_start, parse_date
from docketlake.functions.numbers import first_count, parse_count
from docketlake.functions.text import _col, clean_text, let

_EDGE = r"^[ |​ ]+|[ |​ ]+$"

# Plural labels read under their singular key.
_PLURALS = {"counties": "county", "effectivedates": "effectivedate", "noticedates": "noticedate"}


def split_labels(text: Column | str, labels: str = vocab.BLOCK_LABELS) -> Column:
    """Cut a text at its labels: ``MAP<key, text>``, the lead under ``_address``."""
    marked = F.regexp_replace(_col(text), labels, "\x01$1\x02")

    def entry(part: Column, i: Column) -> Column:
        key = F.regexp_replace(F.lower(F.substring_index(part, "\x02", 1)), "[^a-z]", "")
        for plural, single in _PLURALS.items():
            key = F.when(key == plural, F.lit(single)).otherwise(key)
        lead = i == 0
        return F.struct(
            F.when(lead, F.lit("_address")).otherwise(key).alias("key"),
            F.regexp_replace(
                F.when(lead, part).otherwise(F.substring_index(part, "\x02", -1)), _EDGE, ""
            ).alias("value"),
        )

    def last_wins(entries: Column) -> Column:
        later = lambda e, i: F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]
        )
        empty_lead = lambda e: (e["key"] == "_address") & (e["value"] == "")
        return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i) & ~empty_lead(e)))

    return let(F.transform(F.split(marked, "\x01"), entry), last_wins)


def panel_records(panels: DataFrame, as_of: dt.date | str, state: str) -> DataFrame:
    """Labelled panels (``title, text, year, month``) -> canonical columns."""
    place = rf",\s*([A-Za-z .'\-]+),\s*{state}\s+(\d{{5}})"
    rows = panels.withColumn("f", split_labels("text")).withColumn("lead", F.col("f")["_address"])
    begin = F.nullif(F.regexp_extract(F.col("f")["effectivedate"], r"(?i)beginning\s+([^,;]+)", 1), F.lit(""))
    keep = [c for c in panels.columns if c not in ("title", "text", "year", "month")]
    return rows.select(
        *keep,
        clean_text("title").alias("employer"),
        clean_text(F.regexp_extract("lead", place, 1)).alias("city"),
        clean_text(F.col("f")["county"]).alias("county"),
        F.when(F.col("lead").rlike(rf",\s*{state}\s+\d{{5}}"), clean_text("lead")).alias("address"),
        F.nullif(F.regexp_extract("lead", place, 2), F.lit("")).alias("zip_code"),
        F.coalesce(
            parse_date(F.col("f")["noticedate"], as_of),
            month_start(F.col("year"), F.col("month")),
        ).alias("notice_date"),
        parse_date(F.coalesce(begin, F.col("f")["effectivedate"]), as_of).alias("effective_date"),
        first_count(F.col("f")["affected"]).alias("employees"),
        classify_type(F.col("f")["closureorlayoff"]).alias("notice_type"),
        clean_text(F.col("f")["industry"]).alias("industry"),
        clean_text(F.col("f")["union"]).alias("union_name"),
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Sequence[str], out: str | Sequence[str],
    chunk: Column
) -> DataFrame:
    """Last non-null ``value`` up to each row, safe for one huge key; several values in one pass.

    ``chunk`` must not decrease along ``order``.  Each (key, chunk) is a window of
    its own; only one carried value per chunk crosses between chunks.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    df = df.withColumn("_chunk", chunk)
    place = F.struct(*order)
    ends = df.groupBy(*keys, "_chunk").agg(*[
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), place)).alias(f"_end{i}") for i, v in enumerate(values)
    ])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate([*keys, "_chunk"])],
        *[F.last(f"_end{i}", ignorenulls=True).over(earlier).alias(f"_carry{i}") for i in range(len(values))],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate([*keys, "_chunk"])]
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    filled = df.join(ends, same).withColumns({
        o: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_carry{i}"))
        for i, (v, o) in enumerate(zip(values, outs, strict=True))
    })
    return filled.drop("_chunk", *[f"_key{i}" for i in range(len(keys) + 1)], *[f"_carry{i}" for i in range(len(values))])


def heading_context(blocks: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """Give each block the nearest preceding year heading and month title.

    ``blocks``: ``doc_id, pos, kind, text`` with kinds ``heading``, ``title`` and
    ``panel``.  A new year heading ends the month before it.
    """
    text = clean_text("text")
    is_year = (F.col("kind") == "heading") & text.rlike(r"^20\d{2}$")
    month = F.when(F.col("kind") == "title", month_number(text))
    marked = blocks.withColumns({
        "_year": F.when(is_year, text.cast("int")),
        # 0 marks "month unknown again".
        "_month": F.when(is_year, F.lit(0)).otherwise(month),
    })
    chunk = F.floor(F.col("pos") / chunk_rows)
    marked = carry_forward(marked, ["doc_id"], ["pos"], ["_year", "_month"], ["year", "month"], chunk)
    return marked.withColumn("month", F.nullif(F.col("month"), F.lit(0))).drop("_year", "_month")


def positional_rows(
    rows: DataFrame,
    as_of: dt.date | str,
    cells: str = "cells",
    year: Column | str = "year",
    header: str = r"(?i)company\s+city|workforce\s+affected",
) -> DataFrame:
    """Rows without a usable header: employer, city, month posted, effective, count.

    The notice date is the first of the posted month in the file's year; the
    effective date is the part before the first dash.
    """
    value = lambda i: clean_text(F.get(F.col(cells), F.lit(i)))
    city = value(1)
    month = month_number(F.substring_index(value(2), " ", 1))
    keep = [c for c in rows.columns if c != cells]
    return rows.select(
        *keep,
        value(0).alias("employer"),
        clean_text(F.substring_index(city, ",", 1)).alias("city"),
        F.when(month.isNotNull(), month_start(_col(year), month)).alias("notice_date"),
        parse_date(F.trim(F.substring_index(value(3), "-", 1)), as_of).alias("effective_date"),
        parse_count(value(4)).alias("employees"),
        clean_text(F.when(F.locate(",", city) > 0, F.regexp_replace(city, r"^[^,]*,", ""))).alias("notes"),
    ).where(F.col("employer").isNotNull() & ~F.col("employer").rlike(header))


# "3/15/2026Layoff 1Spirit Airlines": date, action, count, company.
_SMEAR = r"(?i)^(\d{1,2}/\d{1,2}/\d{4})\s*(Layoff|Closure|Closing)\s*(\d+|unknown|NR|N/A)?\s*(.*)$"
_DAY = r"^\d{1,2}/\d{1,2}/\d{4}$"


def _cut_last(text: Column, trailer: Column) -> Column:
    """Text before the last occurrence of ``trailer``, unchanged when absent."""
    after = F.length(F.call_function("substring_index", text, trailer, F.lit(-1)))
    head = F.substring(text, F.lit(1), F.length(text) - after - F.length(trailer))
    return F.when((trailer != "") & text.contains(trailer), head).otherwise(text)


def smeared_rows(
    rows: DataFrame,
    lines: DataFrame,
    as_of: dt.date | str,
    page: Sequence[str] = ("doc_id", "page"),
    note: str = "Filed as a non-WARN notice (below WARN thresholds)",
) -> DataFrame:
    """Split rows whose middle columns ran together.

    ``lines`` (page keys, ``line_ix, line``) is the plain text of the page and
    keeps the spacing of the name; the first line with the row's date supplies it.
    """
    trimmed = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    cell = lambda i: F.element_at("c", i)
    parts = (
        rows.withColumn("c", trimmed)
        .where((F.size("c") >= 6) & F.get("c", F.lit(0)).rlike(_DAY))
        .withColumns({
            "received": cell(1), "flag": cell(-1), "county": cell(-2), "city": cell(-3),
            "middle": F.array_join(F.slice("c", 2, F.size("c") - 4), ""),
        })
        .where(F.col("middle").rlike(_SMEAR))
        .drop("c", "cells")
    )
    dated = lines.withColumn("received", F.regexp_extract("line", r"^(\d{1,2}/\d{1,2}/\d{4})", 1)).withColumn(
        "rest", F.trim(F.substring(F.col("line"), F.length("received") + 1, F.length("line")))
    )
    first = (
        dated.where((F.col("received") != "") & F.col("rest").rlike(_SMEAR))
        .groupBy(*page, "received")
        .agg(F.min_by(F.regexp_extract("rest", _SMEAR, 4), "line_ix").alias("tail"))
    )
    named = _cut_last(_cut_last(F.col("tail"), F.col("county")), F.col("city"))
    part = lambda g: F.nullif(F.regexp_extract("middle", _SMEAR, g), F.lit(""))
    keep = [c for c in rows.columns if c != "cells"]
    return (
        parts.join(first, [*page, "received"], "left")
        .select(
            *keep,
            F.coalesce(
                clean_text(F.regexp_replace(named, r"[ \-|]+$", "")), clean_text(part(4))
            ).alias("employer"),
            clean_text("city").alias("city"),
            clean_text("county").alias("county"),
            parse_date("received", as_of).alias("notice_date"),
            parse_date(part(1), as_of).alias("effective_date"),
            parse_count(part(3)).alias("employees"),
            classify_type(part(2)).alias("notice_type"),
            F.when(F.lower("flag").contains("non"), F.lit(note)).alias("notes"),
        )
        .where("employer is not null")
    )


_TERM = r"dt|th|strong|label|h[3-5]"
_VALUE = r"dd|td|span|p"
_PAIR = (
    rf"(?is)<(?:{_TERM})\b[^>]*+>((?:(?!</(?:{_TERM})>).)*+)</(?:{_TERM})>"
    rf"(?:(?!<(?:{_VALUE})\b|<(?:{_TERM})\b).)*+<(?:{_VALUE})\b[^>]*+>((?:(?!</(?:{_VALUE})>).)*+)</"
)
_COUNT_LABEL = (
    r"(?i)(employees?\s+affected|number\s+of\s+employees|affected\s+employees|planned\s+number)"
)


def detail_count(html: Column | str) -> Column:
    """Headcount of a detail page: first labelled value that is a number."""
    html = _col(html)
    labels = F.regexp_extract_all(html, F.lit(_PAIR), 1)
    values = F.regexp_extract_all(html, F.lit(_PAIR), 2)
    plain = lambda s: F.regexp_replace(s, "<[^>]*>", " ")
    counts = F.transform(
        F.filter(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda p: plain(p["l"]).rlike(_COUNT_LABEL)),
        lambda p: parse_count(plain(p["v"])),
    )
    return F.get(F.filter(counts, lambda n: n.isNotNull()), F.lit(0))


def enrich_counts(records: DataFrame, details: DataFrame, url: str = "source_url") -> DataFrame:
    """Fill missing headcounts from detail pages (``url, html``), others untouched.

    Only records without a count meet the join, so the detail side is read once
    and the rest of the records do not shuffle.
    """
    found = details.select(F.col("url").alias(url), detail_count("html").alias("_count")).where(
        "_count is not null"
    ).groupBy(url).agg(F.max("_count").alias("_count"))
    missing = records.where("employees is null")
    filled = missing.join(found, url, "left").withColumn("employees", F.col("_count")).drop("_count")
    return records.where("employees is not null").unionByName(filled.select(records.columns))


def resolve_link(source_url: Column | str, link: Column | str, host: Column | str | None = None) -> Column:
    """Row link as provenance: absolute wins, rooted gets the host, else the page."""
    link = _col(link)
    out = F.when(link.startswith("http"), link)
    if host is not None:
        host = F.lit(host) if isinstance(host, str) else host
        out = out.when(link.startswith("/"), F.concat(host, link))
    return out.otherwise(_col(source_url))
