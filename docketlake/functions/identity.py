"""Content identity of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import _col, employer_key


def record_hash(
    state: Column | str = "state",
    employer: Column | str = "employer",
    city: Column | str = "city",
    notice_date: Column | str = "notice_date",
    effective_date: Column | str = "effective_date",
    employees: Column | str = "employees",
    key: Column | None = None,
) -> Column:
    """SHA-1 over the identity fields.

    Address, contact and notes stay out, so a cosmetic edit is not a new record.
    ``key`` takes an already computed employer key.
    """

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    return F.sha1(
        F.concat_ws(
            "|",
            F.upper(text(_col(state))),
            key if key is not None else employer_key(employer),
            F.regexp_replace(F.lower(text(_col(city))), r"[^a-z0-9]", ""),
            text(_col(notice_date)),
            text(_col(effective_date)),
            text(_col(employees)),
        )
    )
