"""HTML tables -> grid.

The markup scan is the one step Spark has no operator for: a small tag scanner
runs inside ``mapInPandas``, and only on pages that hold a
table at all.  Everything after the grid is column expressions.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake import vocab
from docketlake.session import batches_by_bytes

MAX_COLSPAN = 1000  # fixed value: the widest span of the table model
MAX_ROWSPAN = 65534  # fixed value: the longest one
OUT_CHARS = 1 << 20  # markup whose grids leave a worker together


def _span(value: str | None, top: int) -> int:
    digits = (value or "").strip()
    return max(1, min(int(digits), top)) if digits.isdigit() else 1


# Comments, script and style bodies, or one tag with its attributes.  A quote only opens
# a value right after "=", so an apostrophe in a bare value is a character like others.
_TAG = re.compile(
    r"<(?:!--.*?-->|(?i:script|style)\b.*?</(?i:script|style)\s*>"
    r"|(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)}


def _pieces(page: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """The text before each tag with the tag's slash, name and attributes; a page of some MB is not cut up at once."""
    if len(page) <= OUT_CHARS:
        parts = _TAG.split(page)
        yield from zip(parts[::4], parts[1::4], parts[2::4], parts[3::4])  # what follows the last tag is left
        return
    done = 0
    for tag in _TAG.finditer(page):
        yield page[done:tag.start()], *tag.groups()
        done = tag.end()


def _tables(page: str) -> list[list[dict]]:
    """Rows (link and cells) of every table, tables in document order."""
    tables: list[list[dict]] = []
    levels: list[dict] = []
    for text, closing, name, given in _pieces(page):
        if levels and text and not text.isspace():
            for level in levels:
                if level["cell"] is not None:
                    level["cell"]["text"].append(text)
        name = name.lower() if name else ""
        if name == "table":
            if not closing:
                rows: list[dict] = []
                tables.append(rows)
                levels.append({"rows": rows, "row": None, "cell": None})
            elif levels:
                levels.pop()
        elif not levels:
            continue
        elif name == "td" or name == "th":
            top = levels[-1]
            top["cell"] = None
            if not closing and top["row"] is not None:
                spans = _attributes(given) if given and "span" in given.lower() else {}
                top["cell"] = {
                    "text": [],
                    "cols": _span(spans.get("colspan"), MAX_COLSPAN) if spans else 1,
                    "rows": _span(spans.get("rowspan"), MAX_ROWSPAN) if spans else 1,
                }
                top["row"]["cells"].append(top["cell"])
        elif name == "tr":
            top = levels[-1]
            top["cell"] = top["row"] = None
            if not closing:
                top["row"] = {"link": None, "cells": []}
                top["rows"].append(top["row"])
        elif name == "a" and not closing:
            href = _attributes(given).get("href")
            for level in levels:
                if href is not None and level["row"] is not None and level["row"]["link"] is None:
                    level["row"]["link"] = href
    return tables


def _rectangle(rows: list[dict]) -> Iterator[tuple[list[str], str | None]]:
    """Grid rows by the table model: a cell takes the next free columns, and those below it for its span.

    ``taken`` maps a row to its filled columns.  Free columns before the last filled one are
    empty cells; blank rows are skipped.
    """
    taken: dict[int, dict[int, str]] = {}
    for r, row in enumerate(rows):
        here = taken.setdefault(r, {})
        column = 0
        for cell in row["cells"]:
            text = " ".join(html.unescape(" ".join(cell["text"])).split())
            if not text.isascii():
                text = unicodedata.normalize("NFKC", text)
            # A span ends with its table.
            below = [taken.setdefault(i, {}) for i in range(r, min(r + cell["rows"], len(rows)))]
            for _ in range(cell["cols"]):
                while column in here:
                    column += 1
                for line in below:
                    line[column] = text
        del taken[r]
        line = [here.get(c, "") for c in range(max(here, default=-1) + 1)]
        if any(c.strip() for c in line):
            yield line, row["link"]


def _scanner(keep: list[str]):
    columns = ["doc_id", "frame_id", "grid", "links", *keep]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for doc_id, page, *rest in batch[["doc_id", "html", *keep]].itertuples(index=False):
                for frame_id, rows in enumerate(_tables(page)):
                    filled = list(_rectangle(rows))
                    out.append((doc_id, frame_id, [c for c, _ in filled], [x for _, x in filled], *rest))
                size += len(page)
                if size >= OUT_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return scan


# Ship the scanner itself to the workers, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def html_frames(
    pages: DataFrame,
    doc_id: Column | str = "doc_id",
    markup: Column | str = "html",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per table: ``doc_id, frame_id, grid, links`` and the ``keep`` columns.

    ``grid`` is the rectangle of cell texts with spans expanded, ``links`` the first
    hyperlink of each row.  A page is parsed once and its tables stay together.
    A worker holds some MB of pages and the grids of one at a time, whatever their number.
    """
    batches_by_bytes(pages.sparkSession)
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    markup = F.col(markup) if isinstance(markup, str) else markup
    rows = pages.select(doc_id.cast("string").alias("doc_id"), markup.alias("html"), *keep).where(
        F.col("html").rlike(r"(?i)<table")
    )
    extra = [rows.schema[name] for name in keep]
    return rows.mapInPandas(_scanner(list(keep)), T.StructType([*vocab.FRAME_SCHEMA.fields, *extra]))


def html_tables(pages: DataFrame, doc_id: Column | str = "doc_id", markup: Column | str = "html") -> DataFrame:
    """Every table of every page as grid rows."""
    return explode_grid(html_frames(pages, doc_id, markup))


def explode_grid(frames: DataFrame) -> DataFrame:
    """Frames -> one row per table row."""
    return frames.select(
        "doc_id", "frame_id", F.posexplode(F.arrays_zip("grid", "links")).alias("row_ix", "row")
    ).select("doc_id", "frame_id", "row_ix", F.col("row.grid").alias("cells"), F.col("row.links").alias("link"))
