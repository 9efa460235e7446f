"""Incremental ingest: a stream of records merged into the stored history."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketlake import vocab
from docketlake.operators.merge import dedupe_batch, maybe_existing_rows, retire_kept, upsert, with_identity
from docketlake.session import dealt
from docketlake.sources.tables import (
    commit_snapshot, folding, manifest, newest, part_of, read_runs, stored, vacuum, write_snapshot,
)


def first_seen(stream: DataFrame, key: Sequence[str] = ("hash",)) -> DataFrame:
    """First occurrence of each key over the whole stream."""
    return stream.dropDuplicates(list(key))


def first_seen_within(stream: DataFrame, event_time: str, key: Sequence[str] = ("hash",),
                      hours: int = vocab.LOOKBACK_HOURS) -> DataFrame:
    """First occurrence with state kept only for the lookback."""
    return stream.withWatermark(event_time, f"{hours} hours").dropDuplicatesWithinWatermark(list(key))


def merge_batch(
    batch: DataFrame,
    batch_id: int,
    path: str,
    now: dt.datetime | str | Column,
    order: Sequence[str],
    full_snapshot: bool = False,
    stream: str = "batch",
) -> None:
    """Upsert one micro-batch and commit it as the table's next version.

    What is written follows the batch: its own rows, those it retires, and the newest runs that are
    small beside it (``folding``).  Of the buckets of its states rows with a hash of the batch go into the
    merge, and one in 16 others, which it leaves out; row counts by bucket and bitmaps of the hashes, 2 bytes a
    row, are all that reaches the driver.  A batch that is lost before
    its manifest is written leaves the table as it was, and one that is replayed finds its rows there
    already: it inserts nothing and changes no first sighting.  The batch is evaluated once.  With
    ``full_snapshot`` the batch is a whole listing of its states: what is missing is retired, what
    returns becomes active again.  ``stream`` and ``batch_id`` name the folder.
    """
    spark = batch.sparkSession
    base, runs = manifest(spark, path)
    incoming = stored(dedupe_batch(with_identity(batch), order), "batch")
    rows = {r[0]: r[1] for r in incoming.groupBy(part_of("state")).count().collect()}  # at most PARTS rows
    if not rows:
        return
    columns = vocab.NOTICE_SCHEMA.names
    touched = {part: runs[part] for part in rows if part in runs}
    target = spark.createDataFrame([], vocab.NOTICE_SCHEMA)
    if touched:
        lying = read_runs(spark, path, touched, vocab.NOTICE_SCHEMA)
        # A whole listing is dealt by hash at once: that serves the choice of the newest row and the merge.
        lying = lying.repartition("hash") if full_snapshot else maybe_existing_rows(lying, incoming, sum(rows.values()))
        target = newest(lying) if any(len(found) > 1 for found in touched.values()) else lying
    merged = upsert(target.select(columns), incoming, now)
    folded = folding(runs, rows)
    beside = folded
    if not full_snapshot:
        merged = merged.where("change != 'kept'")
    if full_snapshot:
        # Buckets that are folded as a whole are in the merge with all their rows.
        whole = [part for part in touched if len(folded.get(part, [])) == len(runs[part])]
        beside = {part: found for part, found in folded.items() if part not in whole}
        merged = retire_kept(merged, incoming).where((F.col("change") != "kept") | F.col("retired") | part_of("state").isin(whole))
    delta = merged.select(columns)
    if beside:
        older = read_runs(spark, path, beside, vocab.NOTICE_SCHEMA)
        delta = newest(older.unionByName(delta.withColumn("_version", F.lit(base + 1).cast("long"))))
    folder = write_snapshot(delta, path, base + 1, f"{stream}-{batch_id}")
    commit_snapshot(spark, path, base + 1, folder, folded, runs)
    vacuum(spark, path)


def ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    now: dt.datetime | str | None = None,
    order: Sequence[str] = ("ingest_ix",),
    full_snapshot: bool = False,
) -> StreamingQuery:
    """Run all available input of a record stream into the history table.

    The checkpoint's path names the stream in the folders of its versions.
    """
    name = f"{zlib.crc32(checkpoint.encode()):08x}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        stamp = now if now is not None else F.current_timestamp()
        # A file that lands is one task, however many rows it packs, and the dedupe sorts them there.
        batch = dealt(batch, *order, "employer", "city")
        merge_batch(batch, batch_id, path, stamp, order, full_snapshot, name)

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
