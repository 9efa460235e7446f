"""Date parsing as guarded column expressions.

``as_of`` is always passed in, so a result never depends on the wall clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.text import _col, clean_text, let

_MON = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"

# Leftmost match of each shape, most specific first.
_YMD = r"(?<![\d])(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
_NUM = r"(?<![\d/.-])(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)"
_DMY = rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[-\s]+(?:of\s+)?{_MON}\.?[-,\s]+'?(\d{{4}}|\d{{2}})(?!\d)"
_MDY = rf"(?i)\b{_MON}\.?[-\s]+(\d{{1,2}})(?:st|nd|rd|th)?[-,\s]+'?(\d{{4}}|\d{{2}})(?!\d)"
_MY = rf"(?i)\b{_MON}\.?[-,\s]+(\d{{4}})(?!\d)"
_NUM_MY = r"(?<![\d/.-])(\d{1,2})[-/.](\d{4})(?!\d)"

# All shapes at once: the first date in reading order, whatever its shape.
_ANY = "|".join(f"(?:{p})" for p in (_YMD, _NUM, _MDY, _DMY, _MY, _NUM_MY))

_SHAPE_HINT = r"(?i)\d[-/.]\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def as_date(value: dt.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def plausible_date(d: Column, as_of: dt.date | str | Column) -> Column:
    """Keep years from the first covered one to a few past ``as_of``."""
    top = F.year(as_date(as_of)) + vocab.MAX_YEAR_OFFSET
    return F.when(F.year(d).between(F.lit(vocab.MIN_YEAR), top), d)


def _build(year: Column, month: Column, day: Column) -> Column:
    """A date from digit strings, NULL when there is no such day."""
    return F.concat_ws(
        "-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")
    ).try_cast("date")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _full_year(y: Column, as_of: Column) -> Column:
    """Two digits mean the nearest century around ``as_of``; four stay."""
    century = F.floor(F.year(as_of) / 100) * 100
    guess = century + _int(y)
    near = (
        F.when(guess >= F.year(as_of) + 50, guess - 100)
        .when(guess < F.year(as_of) - 50, guess + 100)
        .otherwise(guess)
    )
    return F.when(F.length(y) == 4, y).otherwise(near.cast("string"))


def _month_no(word: Column) -> Column:
    names = F.array(*[F.lit(m[:3]) for m in vocab.MONTHS])
    return F.array_position(names, F.lower(F.substring(word, 1, 3))).cast("string")


def packed_date(c: Column | str) -> Column:
    """YYYYMMDD digits, not yet checked for plausibility."""
    return let(F.trim(_col(c).cast("string")), lambda text: F.when(
        text.rlike(r"^(19|20)\d{6}$"),
        _build(F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
    ))


def excel_serial_date(c: Column | str) -> Column:
    """Days since 1899-12-30 inside the serial range."""
    n = _col(c).cast("double")
    low, high = vocab.EXCEL_SERIAL_RANGE
    return F.when(n.between(low, high), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))


def parse_date_number(c: Column | str, as_of: dt.date | str | Column) -> Column:
    """A numeric cell: packed digits first, then a spreadsheet serial."""
    def dated(safe: Column) -> Column:
        packed = let(packed_date(safe.cast("bigint")), lambda d: plausible_date(d, as_of))
        return F.coalesce(packed, let(excel_serial_date(safe), lambda d: plausible_date(d, as_of)))

    return let(_col(c).cast("double"), lambda n: let(F.when(~F.isnan(n) & (F.abs(n) < 1e9), n), dated))


def parse_date(
    c: Column | str,
    as_of: dt.date | str | Column,
    dayfirst: bool = False,
    unicode: str = "jvm",
) -> Column:
    """The first date in reading order in a text cell, NULL when there is none or it is not plausible.

    Texts without any year are NULL.
    """
    c, now = _col(c).cast("string"), as_date(as_of)
    text = clean_text(c, unicode=unicode)
    text = F.regexp_replace(text, r"(?i)^(mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*[,\s]+", "")
    text = F.regexp_replace(text, r"(?i)\b\d{1,2}:\d{2}(:\d{2})?\s*(am|pm)?\b.*$", "")
    text = F.regexp_replace(text, r"^[ ,;]+|[ ,;]+$", "")
    # The usual cell is nothing but such digits; it needs no cleaning and no search.
    usual = let(F.split(c, "[-/.]"), lambda p: plausible_date(_numeric(p, p[2], dayfirst), now))
    return F.when(c.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\z"), usual).otherwise(
        let(text, lambda t: _date_in(t, now, dayfirst)))


def _numeric(p: Column, year: Column, dayfirst: bool) -> Column:
    # Month first unless that cannot be; dayfirst swaps the wish.
    day_leads = _int(p[1]) <= 12 if dayfirst else _int(p[0]) > 12
    first, second = F.when(day_leads, p[1]).otherwise(p[0]), F.when(day_leads, p[0]).otherwise(p[1])
    return _build(year, first, second)


def _date_in(text: Column, now: Column, dayfirst: bool) -> Column:
    first = F.regexp_extract(text, _ANY, 0)

    def parts(pattern: str) -> Column:
        # All groups of the leftmost match in one pass: "a/b/c" or the text itself.
        groups = 2 if pattern in (_MY, _NUM_MY) else 3
        marks = "\x01".join(f"${i + 1}" for i in range(groups))
        flags = "(?i)" if pattern.startswith("(?i)") else ""
        body = pattern.removeprefix("(?i)")
        return F.split(F.regexp_replace(first, f"{flags}^{body}$", marks), "\x01")

    def shape(pattern: str, build: Callable[[Column], Column]) -> Column:
        return let(parts(pattern), lambda p: F.when(F.size(p) > 1, build(p)))

    shapes = F.coalesce(
        shape(_YMD, lambda p: _build(p[0], p[1], p[2])),
        shape(_NUM, lambda p: _numeric(p, _full_year(p[2], now), dayfirst)),
        shape(_MDY, lambda p: _build(_full_year(p[2], now), _month_no(p[0]), p[1])),
        shape(_DMY, lambda p: _build(_full_year(p[2], now), _month_no(p[1]), p[0])),
        shape(_MY, lambda p: _build(p[1], _month_no(p[0]), F.lit("1"))),
        shape(_NUM_MY, lambda p: _build(p[1], p[0], F.lit("1"))),
    )
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}"),
        _build(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)),
    )
    # An implausible packed value is not a date in any other shape either; an
    # implausible ISO value ends the search.
    return let(
        F.coalesce(packed_date(text), iso, F.when(text.rlike(_SHAPE_HINT), shapes)),
        lambda d: plausible_date(d, now),
    )


def month_number(word: Column | str) -> Column:
    """Full English month name -> 1..12, else NULL."""
    names = F.array(*[F.lit(m) for m in vocab.MONTHS])
    return F.nullif(F.array_position(names, F.lower(F.trim(_col(word)))), F.lit(0).cast("bigint")).cast("int")


def month_start(year: Column, month: Column) -> Column:
    """First of the month, or of the year when no month is known."""
    return _build(year.cast("string"), F.coalesce(month, F.lit(1)).cast("string"), F.lit("1"))


def iso_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")
