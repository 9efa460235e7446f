"""Compute-once columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column], keep: Sequence[str | Column] | None = None) -> DataFrame:
    """Add columns through a one-row generator.

    The optimizer copies plain projected expressions into every later filter and
    projection that uses them.  That is right for cheap ones; for a header match or
    a date parse it would repeat the work.  A generator's output is never inlined.
    """
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    base = ["*"] if keep is None else keep
    return df.select(*base, F.inline(row))
