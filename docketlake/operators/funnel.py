"""Framed rows -> canonical records.

Input rows carry ``headers, cells, mapping`` (see :mod:`frames`) plus provenance.
The funnel is a chain of projections and one filter; it never shuffles.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.category import classify_type
from docketlake.functions.dates import parse_date, parse_date_number
from docketlake.functions.numbers import count_from_number, parse_count
from docketlake.functions.places import address_zip, embedded_state, is_full_address, state_name, strip_state
from docketlake.functions.staging import stage
from docketlake.functions.text import _col, clean_zip, drop_bare_code, let
from docketlake.operators.blocks import resolve_link
from docketlake.operators.frames import row_map
from docketlake.operators.headers import OVERRIDE_SCORE, hinted_cells, map_headers


# Three lines with a letter (any character beyond ASCII may be one), without going back.
_LETTER, _OTHER = "[A-Za-z\\x{80}-\\x{10FFFF}]", "[^A-Za-z\\x{80}-\\x{10FFFF}]"
_THREE_WORDED = rf"^{_OTHER}*+{_LETTER}" + rf"[^\n]*+\n{_OTHER}*+{_LETTER}" * 2


def is_junk_employer(employer: Column | str) -> Column:
    """Missing, too short, or a total / header / footer wording."""
    name = F.trim(_col(employer))
    return F.coalesce((F.length(name) < 2) | name.rlike(vocab.JUNK_EMPLOYER), F.lit(True))


def is_repeated_header(cells: Column | str, headers: Column | None = None, mapping: Column | None = None) -> Column:
    """A body row whose values themselves map to fields.  A row equal to ``headers`` has their ``mapping``.

    Three cells with a letter, and a cheap stem count, are asked for before the mapper runs.
    """

    def check(full: Column) -> Column:
        need = F.greatest(F.lit(3), F.size(full) - 1)
        lettered = F.size(F.filter(full, lambda v: v.rlike(_LETTER))) >= need
        maybe = lettered & (hinted_cells(full) >= need)
        own = F.size(map_headers(full))
        if headers is not None:
            # An override speaks for the headers of a frame, not for its rows.
            plain = ~F.exists(mapping, lambda m: m["score"] == OVERRIDE_SCORE)
            own = F.when((full == headers) & plain, F.size(mapping)).otherwise(own)
        return F.when((F.size(full) >= 3) & maybe, own >= need).otherwise(F.lit(False))

    full = F.filter(_col(cells), lambda v: F.coalesce(v, F.lit("")) != "")
    # No vocabulary word is without a letter, so a row of dates and numbers is one by a single look at the joined cells.
    return F.when(F.array_join(_col(cells), "\n").rlike(_THREE_WORDED), let(full, check)).otherwise(F.lit(False))


def is_usable(
    employer: Column | str = "employer",
    dates: tuple[str, ...] = vocab.DATE_FIELDS,
    employees: Column | str = "employees",
) -> Column:
    """An employer of two letters or more and a date or a headcount (0 counts)."""
    known = F.coalesce(*dates, F.lit(None).cast("date")).isNotNull() | _col(employees).isNotNull()
    return F.coalesce(F.length(_col(employer)) >= 2, F.lit(False)) & known


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Per-source defaults where a field is NULL or empty text."""
    types = dict(df.dtypes)
    out = {}
    for name, value in defaults.items():
        if value in (None, ""):
            continue
        current = F.nullif(F.col(name), F.lit("")) if types[name] == "string" else F.col(name)
        out[name] = F.coalesce(current, F.lit(value).cast(types[name]))
    return df.withColumns(out) if out else df


def conform(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """All canonical columns in their types, missing ones NULL."""
    have = set(df.columns)
    fields = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in vocab.RECORD_SCHEMA
    ]
    return df.select(*fields, *extra)


def build_records(
    rows: DataFrame,
    as_of: dt.date | str,
    state: Column | str = "state",
    source_name: Column | str = "source_name",
    source_url: Column | str = "source_url",
    host: Column | str | None = None,
    dayfirst: bool = False,
    defaults: Mapping[str, object] | None = None,
    keep: Sequence[str] = ("doc_id", "frame_id", "row_ix"),
    caps: Mapping[str, int] | None = None,
) -> DataFrame:
    """Canonical records with a ``verdict``: ``ok``, ``junk`` or ``unusable``.

    Frames without an employer column yield nothing.  Every parser is a ``try``
    form, so a bad row can only lose a field or be rejected, never fail the job.  Texts
    are kept whole unless ``caps`` names a longest length for a field.
    """
    nums = "nums" in rows.columns
    keep = [c for c in keep if c in rows.columns]

    def by_field(source: str) -> Column:
        return F.map_from_entries(
            F.transform("mapping", lambda m: F.struct(m["field"], F.get(F.col(source), m["col"])))
        )

    has_employer = F.exists("mapping", lambda m: m["field"] == "employer")
    picked = stage(
        rows.where(has_employer),
        {
            "_state": _col(state),
            "_source": _col(source_name),
            "_url": resolve_link(source_url, "link", host),
            "raw": row_map("headers", "cells"),
            "v": by_field("cells"),
            **({"num": by_field("nums")} if nums else {}),
            "_repeat": is_repeated_header("cells", F.col("headers"), F.col("mapping")),
        },
        keep,
    )

    def text(name: str) -> Column:
        value = F.element_at("v", name)
        return F.substring(value, 1, caps[name]) if caps and name in caps else value

    def number(name: str) -> Column:
        return F.element_at("num", name)

    def date(value: Column, i: Column) -> Column:
        parsed = parse_date(value, as_of, dayfirst, unicode="done")
        if not nums:
            return parsed
        digits = F.get(F.array(*[number(n) for n in vocab.DATE_FIELDS]), i)
        return let(digits, lambda n: F.when(n.isNotNull(), parse_date_number(n, as_of)).otherwise(parsed))

    count = parse_count(F.element_at("v", "employees"), unicode="done")
    if nums:
        text_count = count
        count = let(number("employees"), lambda n: F.when(n.isNotNull(), count_from_number(n)).otherwise(text_count))

    plain = ("employer", "county", "address", "region", "union_name", "contact", "notes")
    typed = stage(
        picked,
        {
            **{n: text(n) for n in plain},
            "_city": text("city"),
            "industry": drop_bare_code(text("industry")),
            "zip_code": clean_zip(F.element_at("v", "zip_code"), unicode="done"),
            "_dates": F.transform(F.array(*[F.element_at("v", n) for n in vocab.DATE_FIELDS]), date),
            "employees": count,
            "notice_type": classify_type(F.element_at("v", "notice_type"), unicode="done"),
        },
        [*keep, F.col("_state").alias("state"), F.col("_source").alias("source_name"),
         F.col("_url").alias("source_url"), "raw", "_repeat"],
    )
    long_city = F.col("_city")
    whole = is_full_address(long_city)
    placed = typed.withColumns({
        **{n: F.get("_dates", F.lit(i)) for i, n in enumerate(vocab.DATE_FIELDS)},
        "city": F.when(~whole, strip_state("_city")),
        "address": F.when(whole, F.coalesce("address", long_city)).otherwise(F.col("address")),
        "zip_code": F.when(whole, F.coalesce("zip_code", address_zip(long_city))).otherwise(F.col("zip_code")),
        "_found": embedded_state("_city"),
        "state_name": state_name("state"),
    })
    placed = fill_defaults(placed, defaults or {})
    placed = placed.withColumns({
        "state": F.coalesce(F.nullif(F.col("state"), F.lit("")), "_found"),
        "notice_type": F.coalesce("notice_type", classify_type("notes", unicode="done")),
    })
    verdict = (
        F.when(is_junk_employer("employer") | F.col("_repeat"), "junk")
        .when(~is_usable(), "unusable")
        .otherwise("ok")
    )
    return placed.select(*keep, *vocab.CANONICAL_FIELDS, "raw", verdict.alias("verdict"))


def rows_to_records(rows: DataFrame, as_of: dt.date | str, **options) -> DataFrame:
    """Usable canonical records of framed rows."""
    return build_records(rows, as_of, **options).where("verdict = 'ok'").drop("verdict")


def rejected_rows(rows: DataFrame, as_of: dt.date | str, **options) -> DataFrame:
    """The quarantine: rows the funnel turned away, with the reason."""
    return build_records(rows, as_of, **options).where("verdict != 'ok'")


def coverage(records: DataFrame, by: tuple[str, ...] = (),
             fields: tuple[str, ...] = ("city", "county", "notice_date", "effective_date", "employees", "notice_type")
             ) -> DataFrame:
    """Filled count and percentage per field, low when at most half is filled.

    One aggregate over the records; the unpivot works on its single row per group.
    """
    sums = records.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count(F.col(f)).alias(f) for f in fields]
    )
    long = sums.unpivot([*by, "total"], list(fields), "field", "filled")
    pct = 100.0 * F.col("filled") / F.col("total")
    return long.where("total > 0").select(
        *by, "field", "filled", "total", F.round(pct, 1).alias("pct"), (pct <= 50).alias("low")
    )
