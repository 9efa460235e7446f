"""Counts out of messy cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.text import _col, clean_text

NUMBER = r"\d[\d,]*(?:\.\d+)?"


def _in_range(x: Column) -> Column:
    return x.between(0, vocab.MAX_COUNT)


def count_from_number(c: Column | str) -> Column:
    """Half-even rounding and the plausibility range for a numeric cell."""
    value = F.bround(_col(c).cast("double"), 0)
    return F.when(~F.isnan(value) & _in_range(value), value.cast("int"))


def parse_count(c: Column | str, unicode: str = "jvm") -> Column:
    """Largest plausible number in the text, so a range gives its upper bound."""
    found = F.transform(
        F.regexp_extract_all(clean_text(c, unicode=unicode), F.lit(NUMBER), 0),
        lambda x: F.bround(F.replace(x, F.lit(","), F.lit("")).cast("double"), 0),
    )
    return F.array_max(F.filter(found, _in_range)).cast("int")


def first_count(c: Column | str) -> Column:
    """First number only, for fields where later text may run on."""
    first = F.regexp_extract(_col(c), r"\d[\d,]*", 0)
    return parse_count(F.nullif(first, F.lit("")), unicode="done")


def int_param(c: Column | str) -> Column:
    """Request parameter as an integer; anything else is NULL."""
    text = F.trim(_col(c))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def date_param(c: Column | str) -> Column:
    """Request parameter as an ISO date; anything else is NULL."""
    c = _col(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
