"""Raw grids -> framed rows: header detection, row shaping, frame choice.

Two forms of the same work:

* Landed payloads (a page, a file in a row) keep each frame in one row
  (``doc_id, frame_id, grid, links``).  :func:`shape_frames` finds the header and
  shapes the rows where they lie, without any shuffle; a frame is never larger
  than the payload it came from.
* Splittable scans of large files give a grid with one row per table row.  There
  the frame-level facts are small aggregates with map-side combine, and the rows
  are never gathered per frame, so one huge frame is just many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.staging import stage
from docketlake.functions.text import _col, clean_cell, clean_text, let
from docketlake.operators.headers import hinted_cells, map_headers, mapped_fields, may_name_fields, name_headers, normalize_header

FRAME_KEY = ["doc_id", "frame_id"]
MAPPING = "array<struct<col:int,field:string,score:int>>"


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def _mean_length(cells: Column) -> Column:
    total = F.aggregate(cells, F.lit(0), lambda n, c: n + F.length(c))
    return total / F.size(cells)


def web_header_score(cells: Column, mapping: Column | None = None) -> Column:
    """How much a web-table row looks like the header; NULL for under two cells.  ``mapping``: that of the cells, if known."""
    mapping = map_headers(cells) if mapping is None else mapping
    return let(
        _filled(cells),
        lambda full: F.when(
            F.size(full) >= 2,
            F.size(mapping) * 2.0
            - F.when(_mean_length(full) > 60, 3).otherwise(0)
            - F.when(
                F.size(F.array_distinct(F.transform(full, normalize_header))) < F.size(full) / 2, 2
            ).otherwise(0),
        ),
    )


def file_header_score(cells: Column, mapping: Column | None = None) -> Column:
    """The same for delimited files, where numbers speak against a header."""
    mapping = map_headers(cells) if mapping is None else mapping
    cleaned = F.filter(F.transform(cells, lambda c: clean_text(c, unicode="done")), lambda c: c.isNotNull())
    return let(
        cleaned,
        lambda full: F.when(F.size(full) < 2, F.lit(-10.0)).otherwise(
            F.size(mapping) * 2.0
            - F.when(_mean_length(full) > 60, 3).otherwise(0)
            - F.when(
                F.size(F.filter(full, lambda c: c.rlike(r"^[\d,.$%/\- ]+$"))) > F.size(full) / 2, 4
            ).otherwise(0)
        ),
    )


DEEP_SCORE = 4.0  # two mapped fields: what a row below the first ones needs to be the header


def _header_rule(kind: str) -> tuple[int, Callable[..., Column], float]:
    """First rows that are preferred, their score, and what it must exceed."""
    if kind == "web":
        return vocab.WEB_HEADER_SCAN, web_header_score, 0.0
    return vocab.FILE_HEADER_SCAN, file_header_score, 0.5


def detect_headers(
    grid: DataFrame,
    kind: str = "web",
    overrides: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per frame: ``header_ix, headers, mapping, fields, width``.

    The best of the first rows; when none of them scores, the best row below that maps at least
    two fields, however deep.  Otherwise a ``web`` frame has row 0, and a ``file`` frame
    has no header and is left out.  One aggregate over the rows, with one candidate of each
    kind per task and frame; data cells stop at one stem test.
    """
    scan, score, floor = _header_rule(kind)
    first = F.col("row_ix") < scan
    cells = F.col("cells")
    own = F.when(may_name_fields(cells) & (first | (hinted_cells(cells) >= 2)), score(cells))
    grid = stage(grid, {"_own": own}, [*FRAME_KEY, "row_ix", "cells"])
    own = F.col("_own")
    found = F.struct(own.alias("score"), (-F.col("row_ix")).alias("neg_ix"), "cells")
    head = F.when(first & (own > floor), found)
    deep = F.when(~first & (own >= DEEP_SCORE), found)
    top = F.when(F.col("row_ix") == 0, F.struct(F.lit(-100.0).alias("score"), F.lit(0).cast(grid.schema["row_ix"].dataType).alias("neg_ix"), "cells"))
    frames = (
        grid.select(*FRAME_KEY, F.size("cells").alias("n"), head.alias("head"), deep.alias("deep"), top.alias("top"))
        .groupBy(*FRAME_KEY)
        .agg(F.max("head").alias("head"), F.max("deep").alias("deep"), F.max("top").alias("top"), F.max("n").alias("width"),
             F.count("*").alias("n_rows"))
        .withColumn("head", F.coalesce("head", "deep", *(["top"] if kind == "web" else [])))
    )
    frames = frames.where("n_rows > 1") if kind == "web" else frames.where(F.col("head").isNotNull())
    padded = F.concat(
        F.col("head.cells"),
        F.array_repeat(F.lit(""), F.col("width") - F.size("head.cells")),
    )
    return (
        frames.select(
            *FRAME_KEY,
            (-F.col("head.neg_ix")).alias("header_ix"),
            name_headers(padded).alias("headers"),
            "width",
        )
        .transform(stage, {"mapping": map_headers("headers", overrides)})
        .withColumn("fields", mapped_fields("mapping"))
    )


def frame_rows(grid: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows below the header, padded to the frame width and cleaned.

    Carries the mapping along; rows without any value are dropped.
    """
    heads = frames.select(*FRAME_KEY, "header_ix", "width", "headers", "mapping", "fields")
    padded = F.concat(
        "cells", F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size("cells"))
    )
    body = grid.join(heads, FRAME_KEY).where(F.col("row_ix") > F.col("header_ix"))
    cleaned = F.transform(padded, clean_cell)
    keep = [c for c in body.columns if c not in ("cells", "header_ix", "width")]
    return stage(body, {"cells": cleaned}, keep).where(F.exists("cells", lambda c: c.isNotNull()))


def shape_frames(
    frames: DataFrame, kind: str = "web", overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Row-local header detection (as :func:`detect_headers`) and row shaping of whole frames.

    Adds ``header_ix, headers, mapping, fields, rows, n_rows, score`` and drops the
    grid.  Frames without a header (files), without data rows or of a single row
    (web) are left out; file frames lose their all-empty columns.
    """
    web = kind == "web"
    scan, score, floor = _header_rule(kind)

    def candidates(rows: Column, offset: int, least: Callable[[Column], Column]) -> Column:
        # A row without any field has no score above 0, which is below what any rule asks for.
        scored = F.transform(rows, lambda cells, i: F.when(may_name_fields(cells), let(
            map_headers(cells), lambda m: F.struct(score(cells, m).alias("score"), (-i - offset).alias("neg_ix"), m.alias("mapping")))))
        return F.array_max(F.filter(scored, lambda r: least(r["score"])))

    # The rest is only looked at when none of the first rows scores.
    rest = F.transform(F.slice("grid", scan + 1, F.size("grid")), lambda cells: F.when(hinted_cells(cells) >= 2, cells))
    deep = candidates(rest, scan, lambda v: v >= DEEP_SCORE)
    head = F.coalesce(candidates(F.slice("grid", 1, scan), 0, lambda v: v > floor), F.when(F.size("grid") > scan, deep))
    if web:
        head = F.coalesce(head, F.struct(
            F.lit(-100.0).alias("score"), F.lit(0).alias("neg_ix"), F.lit(None).cast(MAPPING).alias("mapping")))
    out = stage(frames, {
        "width": F.array_max(F.transform("grid", lambda r: F.size(r))),
        "head": head,
    })
    out = out.where(F.size("grid") > 1) if web else out.where(F.col("head").isNotNull())
    out = out.withColumn("header_ix", -F.col("head.neg_ix"))

    def padded(cells: Column, fill: Column) -> Column:
        return F.concat(cells, F.array_repeat(fill, F.col("width") - F.size(cells)))

    body = F.transform(
        F.slice("grid", F.col("header_ix") + 2, F.size("grid")),
        lambda cells, i: F.struct(
            (i + F.col("header_ix") + 1).alias("row_ix"),
            F.transform(padded(cells, F.lit(None).cast("string")), clean_cell).alias("cells"),
            F.get("links", i + F.col("header_ix") + 1).alias("link"),
        ),
    )
    head = padded(F.get("grid", F.col("header_ix")), F.lit(""))
    out = stage(out, {
        "headers": name_headers(head),
        "rows": F.filter(body, lambda r: F.exists(r["cells"], lambda c: c.isNotNull())),
    }).where(F.size("rows") > 0)
    # What the choice of the header found is the mapping, when its row gives the headers as they stand.
    found = F.when(F.col("headers") == F.get("grid", F.col("header_ix")), F.col("head.mapping"))
    if not web:
        # Score and choose on all headers, then leave out the empty columns.
        used = F.filter(
            F.sequence(F.lit(0), F.col("width") - 1),
            lambda i: F.exists("rows", lambda r: F.get(r["cells"], i).isNotNull()),
        )
        all_fields = mapped_fields(F.coalesce(found, map_headers("headers")))
        out = stage(out, {"all_fields": all_fields, "used": used}).withColumns({
            "headers": F.transform("used", lambda i: F.get("headers", i)),
            "rows": F.transform("rows", lambda r: F.struct(
                r["row_ix"].alias("row_ix"),
                F.transform(F.col("used"), lambda i: F.get(r["cells"], i)).alias("cells"),
                r["link"].alias("link"),
            )),
        })
    mapping = map_headers("headers", overrides)
    out = stage(out, {"mapping": mapping if overrides else F.coalesce(found, mapping)})
    out = stage(out, {"fields": mapped_fields("mapping"), "n_rows": F.size("rows")})
    total = (
        web_frame_score(F.col("fields"), F.col("n_rows")) if web
        else F.size("all_fields") * 100.0 + F.col("n_rows")
    )
    return out.withColumn("score", total).drop("grid", "links", "width", "head", "used")


def shaped_rows(shaped: DataFrame) -> DataFrame:
    """One row per shaped row, with the frame's headers and mapping."""
    keep = [c for c in shaped.columns if c != "rows"]
    return shaped.select(*keep, F.explode("rows").alias("r")).select(*keep, "r.*")


def row_map(headers: Column | str = "headers", cells: Column | str = "cells") -> Column:
    """A row as ``header -> value``; a repeated header keeps its last value."""
    headers, cells = _col(headers), _col(cells)
    names = F.array_distinct(headers)
    last = F.transform(
        names,
        lambda n: F.element_at(F.filter(cells, lambda _, i: F.get(headers, i) == n), -1),
    )
    unique = F.size(names) == F.size(headers)
    return F.when(unique, F.map_from_arrays(headers, cells)).otherwise(F.map_from_arrays(names, last))


def drop_empty_columns(rows: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Leave out file columns that hold no value in the whole frame, then re-map.

    The per-column flags are one small partial aggregate per frame.
    """
    used = (
        rows.select(
            *FRAME_KEY,
            F.explode(
                F.filter(
                    F.transform("cells", lambda c, i: F.when(c.isNotNull(), i)), lambda i: i.isNotNull()
                )
            ).alias("ix"),
        )
        .groupBy(*FRAME_KEY)
        .agg(F.sort_array(F.collect_set("ix")).alias("used"))
    )

    def keep(name: str) -> Column:
        return F.transform(F.col("used"), lambda i: F.get(F.col(name), i))

    return (
        rows.join(used, FRAME_KEY)
        .withColumns({"headers": keep("headers"), "cells": keep("cells")})
        .drop("used", "mapping")
        .transform(stage, {"mapping": map_headers("headers", overrides)})
    )


def web_frame_score(fields: Column, n_rows: Column) -> Column:
    """Signal of the mapped fields plus a logarithmic bonus for size."""
    signal = F.when(F.array_contains(fields, "employer"), 4.0).otherwise(0.0)
    for name in ("notice_date", "effective_date", "employees", "city", "county"):
        signal = signal + F.when(F.array_contains(fields, name), 1.5).otherwise(0.0)
    return F.when((signal > 0) & (n_rows > 0), signal * 10 + F.log10(n_rows + 1) * 5).otherwise(0.0)


def frame_stats(rows: DataFrame, kind: str = "web") -> DataFrame:
    """Row count and score per frame that yielded rows."""
    stats = rows.groupBy(*FRAME_KEY).agg(
        F.count("*").alias("n_rows"),
        F.any_value("fields").alias("fields"),
        F.any_value("headers").alias("headers"),
    )
    if kind == "web":
        score = web_frame_score(F.col("fields"), F.col("n_rows"))
    else:
        score = F.size("fields") * 100.0 + F.col("n_rows")
    return stats.withColumn("score", score)


def top_frames(stats: DataFrame, n: int = 1, min_score: float = 1.0) -> DataFrame:
    """The best frames per document; earlier frames win ties."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "frame_id")
    return (
        stats.withColumn("place", F.row_number().over(order))
        .where((F.col("place") <= n) & (F.col("score") >= min_score))
    )


def keep_frames(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    return rows.join(chosen.select(*FRAME_KEY), FRAME_KEY, "left_semi")


def merge_file_frames(stats: DataFrame) -> DataFrame:
    """Frames sharing the best frame's header signature; needs an employer column."""
    usable = stats.where(F.array_contains("fields", "employer")).withColumn(
        "signature", F.sort_array(F.transform("headers", normalize_header))
    )
    best = top_frames(usable, 1, 0.0).select("doc_id", "signature")
    return usable.join(best, ["doc_id", "signature"], "left_semi")


def stitch_by_width(grid: DataFrame) -> DataFrame:
    """Join frames of equal width into one per document and width.

    Row numbers are offsets from per-frame counts, so no frame is sorted whole.
    Rows are padded to the frame width by the caller of ``frame_rows``.
    """
    sizes = grid.groupBy(*FRAME_KEY).agg(
        F.max(F.size("cells")).alias("width"), (F.max("row_ix") + 1).alias("span")
    )
    before = Window.partitionBy("doc_id", "width").orderBy("frame_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = sizes.withColumn("offset", F.coalesce(F.sum("span").over(before), F.lit(0)))
    return grid.join(placed.drop("span"), FRAME_KEY).select(
        "doc_id",
        F.col("width").alias("frame_id"),
        (F.col("offset") + F.col("row_ix")).cast("int").alias("row_ix"),
        "cells",
        "link",
    )


def row_signature(cells: Column | str = "cells") -> Column:
    """Identity of a raw row: its non-null values in key order, link excluded."""
    return F.sha2(F.to_json(F.array_compact(cells)), 256)


def map_signature(row: Column | str) -> Column:
    """Row signature of a ``header -> value`` map, values in key order."""
    entries = F.sort_array(F.map_entries(row))
    return row_signature(F.transform(entries, lambda e: e["value"]))


def dedupe_rows(rows: DataFrame, scope: list[str], order: list[str], signature: Column) -> DataFrame:
    """First occurrence of each row signature within ``scope``.

    ``row_number() = 1`` lets Spark keep one row per key in every task before the
    shuffle, so a row repeated a billion times does not travel.
    """
    w = Window.partitionBy(*scope, "signature").orderBy(*order)
    return (
        rows.withColumn("signature", signature)
        .withColumn("place", F.row_number().over(w))
        .where("place = 1")
        .drop("place", "signature")
    )
