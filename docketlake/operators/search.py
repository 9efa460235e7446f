"""Filtered, sorted, paged search and its exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake import vocab


def _holds(column: str, needle: str, wildcards: bool) -> Column:
    if wildcards:
        # % and _ as typed by the user; a backslash has no special meaning.
        return F.lower(column).like(f"%{needle.lower()}%".replace("\\", "\\\\"))
    return F.lower(column).contains(needle.lower())


def search_filter(
    df: DataFrame,
    query: str | None = None,
    state: str | None = None,
    city: str | None = None,
    min_employees: int | None = None,
    since: dt.date | str | None = None,
    active_only: bool = False,
    text_columns: Sequence[str] = ("employer", "industry", "notes"),
    wildcards: bool = False,
) -> DataFrame:
    """AND of the given filters; plain-column ones reach the Parquet scan."""
    if query and query.strip():
        hit = None
        for c in text_columns:
            test = F.coalesce(_holds(c, query.strip(), wildcards), F.lit(False))
            hit = test if hit is None else hit | test
        df = df.where(hit)
    if state:
        df = df.where(F.col("state") == state.upper())
    if city and city.strip():
        df = df.where(_holds("city", city.strip(), wildcards))
    if min_employees is not None:
        df = df.where(F.col("employees") >= min_employees)
    if since is not None:
        df = df.where(F.col("notice_date") >= F.lit(str(since)).cast("date"))
    if active_only:
        df = df.where("is_active")
    return df


def sort_order(name: str = "notice_date_desc", tie: str = "hash") -> list[Column]:
    """Named sort mode; unknown names sort by date descending."""
    modes = {
        "notice_date_desc": F.desc_nulls_last("notice_date"),
        "notice_date_asc": F.asc_nulls_first("notice_date"),
        "employees_desc": F.desc_nulls_last("employees"),
        "employer_asc": F.asc("employer"),
    }
    return [modes.get(name, modes["notice_date_desc"]), F.asc(tie)]


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = vocab.PAGE_SIZE) -> DataFrame:
    """One page; Spark plans it as a per-task top-k, not a full sort."""
    skip = (max(1, page) - 1) * per_page
    return df.orderBy(*order).offset(skip).limit(per_page)


def search(df: DataFrame, order: str = "notice_date_desc", page: int = 1,
           per_page: int = vocab.PAGE_SIZE, tie: str = "hash", **filters) -> DataFrame:
    """A page of search results."""
    return page_of(search_filter(df, **filters), sort_order(order, tie), page, per_page)


def search_total(df: DataFrame, per_page: int = vocab.PAGE_SIZE, **filters) -> DataFrame:
    """Match count before paging and the number of pages (at least one)."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page))
    return search_filter(df, **filters).agg(F.count("*").alias("total")).withColumn(
        "total_pages", pages.cast("bigint")
    )


def latest(df: DataFrame, k: int = 12, by: str = "first_seen_at", tie: str = "hash") -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def distinct_values(df: DataFrame, column: str = "state") -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def export_rows(
    df: DataFrame,
    states: Sequence[str] | None = None,
    since: dt.date | str | None = None,
    active_only: bool = False,
    columns: Sequence[str] = (*vocab.CANONICAL_FIELDS, "first_seen_at"),
) -> DataFrame:
    """Canonical export: newest first, unknown dates last, then by state."""
    if states:
        df = df.where(F.col("state").isin(*[s.upper() for s in states]))
    return search_filter(df, since=since, active_only=active_only).orderBy(
        F.desc_nulls_last("notice_date"), "state"
    ).select(*columns)


def search_export(df: DataFrame, cap: int | None = None, tie: str = "hash", **filters) -> DataFrame:
    """Export of a search: the report's ten columns, all rows or the first ``cap``."""
    found, order = search_filter(df, **filters), sort_order("notice_date_desc", tie)
    rows = found.orderBy(*order) if cap is None else page_of(found, order, 1, cap)
    return rows.select(*vocab.SEARCH_EXPORT_FIELDS)


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with header and ISO dates, or JSON lines."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        writer.option("ignoreNullFields", "false").json(path)


def select_sources(sources: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """Sources of the given codes in order; unknown codes are an error.

    The check only brings back the unknown codes, at most as many as were asked.
    """
    if not codes:
        return sources.orderBy("state")
    wanted = sorted({c.strip().upper() for c in codes if c.strip()})
    asked = sources.sparkSession.createDataFrame([(c,) for c in wanted], "state string")
    unknown = [r.state for r in asked.join(sources, "state", "left_anti").orderBy("state").collect()]
    if unknown:
        raise KeyError(f"unknown state code(s): {', '.join(unknown)}")
    return sources.where(F.col("state").isin(*wanted)).orderBy("state")


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.select("state", "strategy", "source_name", "url").orderBy("state")
