"""Keyed history: in-batch dedupe, upsert, backfill, soft delete, change feeds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.functions.identity import record_hash
from docketlake.functions.text import employer_key


def with_identity(records: DataFrame) -> DataFrame:
    """Add ``employer_key`` and ``hash``."""
    return records.withColumn("employer_key", employer_key("employer")).withColumn(
        "hash", record_hash(key=F.col("employer_key"))
    )


def dedupe_batch(batch: DataFrame, order: Sequence[str | Column], key: Sequence[str] = ("hash",)) -> DataFrame:
    """First occurrence per key; later duplicates are dropped, not merged.

    ``row_number() = 1`` is pre-limited inside each task before the shuffle, so a
    key that fills a third of the batch still sends one row per task.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return batch.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def _empty(c: Column, kind: str) -> Column:
    return F.nullif(c, F.lit("")).isNull() if kind == "string" else c.isNull()


def upsert(
    target: DataFrame,
    batch: DataFrame,
    now: dt.datetime | str | Column,
    backfill: Sequence[str] = vocab.BACKFILL_FIELDS,
    key: str = "hash",
) -> DataFrame:
    """The merged table plus ``change``: ``new``, ``updated``, ``seen`` or ``kept``.

    ``target`` and ``batch`` are unique by key.  New keys are inserted as active
    with all three stamps at ``now``; known keys get ``last_seen_at`` and
    ``updated_at``, become active again and take non-empty values for empty
    backfill fields.  One join on a unique hash, so there is no hot key.
    """
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    types = dict(target.dtypes)
    stamps = ("first_seen_at", "last_seen_at", "updated_at", "is_active")
    data = [c for c in target.columns if c not in stamps and c != key]
    t, s = target.alias("t"), batch.alias("s")
    known, seen = F.col(f"t.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()

    def fillable(name: str) -> Column:
        kind = types[name]
        return _empty(F.col(f"t.{name}"), kind) & ~_empty(F.col(f"s.{name}"), kind)

    fields = [f for f in backfill if f in data]
    changed = F.lit(False)
    for f in fields:
        changed = changed | fillable(f)

    def pick(name: str) -> Column:
        new, old = F.col(f"s.{name}"), F.col(f"t.{name}")
        take = ~known | (fillable(name) if name in fields else F.lit(False))
        return F.when(take, new).otherwise(old).alias(name)

    change = (
        F.when(~known, "new").when(~seen, "kept").when(changed, "updated").otherwise("seen")
    )
    touched = F.when(seen, now)
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(
        F.coalesce(f"t.{key}", f"s.{key}").alias(key),
        *[pick(c) for c in data],
        F.coalesce("t.first_seen_at", now).alias("first_seen_at"),
        F.coalesce(touched, "t.last_seen_at").alias("last_seen_at"),
        F.coalesce(touched, "t.updated_at").alias("updated_at"),
        (seen | F.coalesce("t.is_active", F.lit(False))).alias("is_active"),
        change.alias("change"),
    )


def upsert_stats(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inserted and backfilled row counts of an upsert."""
    return merged.groupBy(*by).agg(
        F.count_if(F.col("change") == "new").alias("rows_new"),
        F.count_if(F.col("change") == "updated").alias("rows_updated"),
    )


def deactivate_missing(target: DataFrame, seen: DataFrame, ok: DataFrame, scope: str = "state",
                       key: str = "hash") -> DataFrame:
    """Retire active rows of successfully read scopes that were not seen.

    ``ok`` holds the scopes whose source succeeded, so a failed source never
    retires anything.  Adds ``retired``.
    """
    marks = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    scopes = ok.select(scope).distinct().withColumn("_ok", F.lit(True))
    gone = F.col("_seen").isNull() & F.col("_ok").isNotNull() & F.col("is_active")
    return (
        target.join(marks, key, "left").join(scopes, scope, "left")
        .withColumn("retired", F.coalesce(gone, F.lit(False)))
        .withColumn("is_active", F.col("is_active") & ~F.col("retired"))
        .drop("_seen", "_ok")
        .select(*target.columns, "retired")
    )


def retire_kept(merged: DataFrame, ok: DataFrame, scope: str = "state") -> DataFrame:
    """``deactivate_missing`` for the outcome of ``upsert``: rows it ``kept`` are those its batch lacks.

    Only the few scopes of ``ok`` are joined, so that merged rows are not shuffled again.
    """
    scopes = ok.select(F.col(scope).alias("_scope")).distinct().withColumn("_ok", F.lit(True))
    gone = (F.col("change") == "kept") & F.col("_ok").isNotNull() & F.col("is_active")
    return (
        merged.join(scopes, F.col(scope) == F.col("_scope"), "left")
        .withColumn("retired", F.coalesce(gone, F.lit(False)))
        .withColumn("is_active", F.col("is_active") & ~F.col("retired"))
        .select(*merged.columns, "retired")
    )


def new_rows(batch: DataFrame, target: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of the batch the target does not hold yet."""
    return batch.join(target.select(key), key, "left_anti")


def existing_rows(target: DataFrame, batch: DataFrame, key: str = "hash") -> DataFrame:
    """Target rows the batch touches."""
    return target.join(batch.select(key), key, "left_semi")


_BITMAP = 32_768       # bits of one bitmap of ``bitmap_construct_agg``
KEY_BITS = 16          # bits a key: one in 16 rows of other keys passes
FILTER_KEYS = 64 << 20  # keys whose bitmaps are broadcast, 2 bytes each


def maybe_existing_rows(target: DataFrame, batch: DataFrame, n: int, key: str = "hash") -> DataFrame:
    """Target rows the batch, of ``n`` rows, touches, and some others: for a join that tells them apart anyway.

    Only bitmaps of the keys are broadcast, 2 bytes a key in place of the keys themselves, and nothing is shuffled
    before the rows are few.  A batch of more than ``FILTER_KEYS`` leaves the target as it is.
    """
    if n > FILTER_KEYS:
        return target
    maps = -(-max(n, 1) * KEY_BITS // _BITMAP)
    slot = F.pmod(F.xxhash64(key), F.lit(maps * _BITMAP))
    place = (slot % _BITMAP).alias("_place")
    number = F.floor(slot / _BITMAP).cast("int").alias("_map")
    bits = batch.select(number, place).groupBy("_map").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1
    return target.select("*", number, place).join(F.broadcast(bits), "_map").where(hit).select(*target.columns)


def run_history(results: DataFrame, stats: DataFrame) -> DataFrame:
    """Per-source results with the inserted and backfilled counts of the run."""
    return results.drop("rows_new").join(stats, "state", "left").withColumns({
        "rows_new": F.coalesce("rows_new", F.lit(0)),
        "rows_updated": F.coalesce("rows_updated", F.lit(0)),
    })
