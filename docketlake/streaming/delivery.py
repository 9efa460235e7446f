"""Alerts with messages and receipts: an outbox in two phases, so that a failed message is tried again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docketlake import vocab
from docketlake.operators.matching import (
    BLOCK, NOTICE_COLUMNS, active_subscriptions, by_block, by_need, eligible, few, filter_groups, group_digest, hits_left, hits_once,
    lookback_start, match_groups, packed_hits, recent_notices, unpacked,
)
from docketlake.sources.tables import append, has_batch, read_appended, stored

# A notice that met a group of subscriptions; ``told`` are ids of the block that earlier batches booked for it.
HIT_SCHEMA = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("employer", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("employees", T.IntegerType()),
    T.StructField("notice_date", T.DateType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("first_seen_at", T.TimestampType()),
    T.StructField("no", T.LongType()),
    T.StructField("told", T.ArrayType(T.ShortType())),
])
# The members that a batch has messages for in a group of its own or of an earlier batch (``made``), for
# hits seen from ``since`` on; ``until`` and ``most`` bound the days and headcounts of the group's hits.
GROUP_SCHEMA = T.StructType([
    T.StructField("made", T.LongType()),
    T.StructField("no", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("members", T.ArrayType(T.StructType([
        T.StructField("at", T.ShortType()),
        T.StructField("need", T.IntegerType()),
        T.StructField("due", T.BooleanType()),
    ]))),
    T.StructField("since", T.TimestampType()),
    T.StructField("until", T.TimestampType()),
    T.StructField("most", T.IntegerType()),
])
MESSAGE_SCHEMA = T.StructType([
    T.StructField("subscription_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("unsubscribe_token", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
])
RECEIPT_SCHEMA = T.StructType([
    T.StructField("subscription_id", T.LongType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
])


def _columns(schema: T.StructType) -> list:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]


def _booked(batch: DataFrame, schema: T.StructType, path: str, batch_id: int) -> DataFrame:
    """Write a batch's rows and read back what was written."""
    append(batch.select(*_columns(schema)), path, batch_id)
    return batch.sparkSession.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")


def deliver_batch(
    batch: DataFrame,
    batch_id: int,
    subs: DataFrame,
    outbox: str,
    now: dt.datetime | str,
    send: Callable[[DataFrame], DataFrame],
    lookback_hours: float = vocab.LOOKBACK_HOURS,
) -> None:
    """Alert one micro-batch: book what is due, write the messages, send them, book the receipts.

    Due are matches of this batch and pairs of earlier ones that no receipt confirms, as long
    as the notice lies in the lookback and the subscription is active.  ``send`` gets the messages
    (``subscription_id, email, unsubscribe_token, n, subject, body``) and returns ``subscription_id, ok,
    error``; a message without a row there counts as not sent.  It runs where its plan runs, in tasks.

    Pairs are never written or shuffled: booked are notices with the group of subscriptions they met, once, and
    by batch the members of each group that it has messages for.  A failed message is one member less
    confirmed, whatever the number of its notices.  ``now`` must not go back from batch to batch.

    A batch with receipts is finished and a replay of it sends nothing.  A driver lost after sending and
    before the receipts sends that batch again under the same batch number, so delivery is at
    least once.
    """
    spark = batch.sparkSession
    if has_batch(spark, f"{outbox}/receipts", batch_id):
        return
    people = active_subscriptions(subs)
    recent = recent_notices(batch, now, lookback_hours)
    groups = stored(filter_groups(people).withColumn("_group", F.monotonically_increasing_id()), "groups")
    hits = hits_once(match_groups(recent, few(groups), carry=NOTICE_COLUMNS), NOTICE_COLUMNS)
    again = recent_notices(_hits(spark, outbox, batch_id), now, lookback_hours).join(recent.select("hash").distinct(), "hash", "left_semi")
    told = by_block(_booked_ids(again, _groups(spark, outbox, batch_id).where("made = batch_id")), "hash")
    found = hits.join(told, ["hash", "block"], "left").withColumnsRenamed({"_group": "no", "_sent": "told"})
    found = _booked(found, HIT_SCHEMA, f"{outbox}/hits", batch_id)
    own = groups.select("_group", "block", "ats", "needs").join(
        found.groupBy(F.col("no").alias("_group")).agg(F.max("first_seen_at").alias("until"), F.max("employees").alias("most")), "_group")
    fresh = own.select(
        F.lit(batch_id).alias("made"), F.col("_group").alias("no"), "block",
        F.transform("ats", lambda at, i: F.struct(
            at.alias("at"), F.get("needs", i - F.size("ats") + F.size("needs")).alias("need"), F.lit(True).alias("due"))).alias("members"),
        "until", "most")
    since = lookback_start(now, lookback_hours)
    waiting = _waiting(spark, outbox, batch_id, people).where(F.col("until") >= since)
    _booked(fresh.unionByName(waiting).withColumn("since", since), GROUP_SCHEMA, f"{outbox}/groups", batch_id)
    due = stored(_due(_groups(spark, outbox).where(F.col("batch_id") == batch_id)), "due")
    met = _new(_hits(spark, outbox, batch_id + 1), few(due), [*NOTICE_COLUMNS, "since"]).where("first_seen_at >= since")
    met = stored(met.drop("since", "ats"), "met")
    address = subs.select(F.col("id").alias("subscription_id"), "email", "unsubscribe_token")
    messages = _booked(group_digest(met, due, ["made", "no"]).join(address, "subscription_id"), MESSAGE_SCHEMA, f"{outbox}/messages", batch_id)
    _booked(send(messages).withColumn("sent_at", F.lit(now).cast("timestamp")), RECEIPT_SCHEMA, f"{outbox}/receipts", batch_id)


def _due(groups: DataFrame) -> DataFrame:
    """The members of groups that are due, as ``by_need`` has them."""
    members = F.transform(F.filter("members", lambda m: m["due"]), lambda m: F.struct(m["need"].alias("need"), m["at"].alias("at")))
    return groups.select("made", "no", "block", "since", *by_need(members))


def _new(hits: DataFrame, groups: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``hits_left`` of booked hits: members whose minimum the headcount meets and that were not booked with the notice before."""
    left = F.filter(F.slice("ats", 1, F.col("reach")), lambda at: ~F.array_contains("told", at))
    return hits_left(hits.withColumnRenamed("batch_id", "made"), groups, ["made", "no"], carry, F.col("employees"),
                     F.when(F.col("told").isNotNull(), left))


def _booked_ids(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Ids that earlier batches booked for their notices, packed: ``hash, block, ats``."""
    return packed_hits(_new(hits, _due(groups), ["hash"]), ["hash"])


def _waiting(spark: SparkSession, outbox: str, batch_id: int, people: DataFrame) -> DataFrame:
    """Groups of the batch before with the members that have no receipt from it.

    Each batch takes over what is left of the one before, so that one holds all that waits.  A
    member whose minimum no notice of the group reaches has nothing to wait for.  Inactive members stay, without messages.
    """
    known = _groups(spark, outbox, batch_id)
    last = known.agg(F.max("batch_id")).first()[0]  # one number
    receipts = _receipts(spark, outbox, batch_id).where("ok")
    if last is None:
        known, receipts = known.where("false"), receipts.where("false")
    else:
        known, receipts = known.where(F.col("batch_id") == last), receipts.where(F.col("batch_id") == last)
    active = people.select(F.col("id").alias("subscription_id"), F.lit(True).alias("_active"))
    members = known.select("made", "no", "block", "until", "most", F.explode("members").alias("m")).where(eligible(F.col("m"), F.col("most")))
    left = members.withColumn("subscription_id", F.col("block") * BLOCK + F.col("m.at")) \
        .join(receipts.select("subscription_id"), "subscription_id", "left_anti").join(active, "subscription_id", "left")
    member = F.struct("m.at", "m.need", F.coalesce("_active", F.lit(False)).alias("due"))
    return left.groupBy("made", "no", "block", "until", "most").agg(F.collect_list(member).alias("members"))


def run_deliveries(
    stream: DataFrame,
    load_subs: Callable[[], DataFrame],
    outbox: str,
    checkpoint: str,
    now: dt.datetime | str,
    send: Callable[[DataFrame], DataFrame],
    lookback_hours: float = vocab.LOOKBACK_HOURS,
) -> StreamingQuery:
    """Deliver alerts on all available input; subscriptions are read again per batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        deliver_batch(batch, batch_id, load_subs(), outbox, now, send, lookback_hours)

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def delivery_log(spark: SparkSession, outbox: str) -> DataFrame:
    """One row per subscription and notice: ``attempts``, ``sent_at`` (NULL while undelivered), ``error`` of the last attempt."""
    # The messages of each member of a group, whatever the number of its notices.
    receipts = _receipts(spark, outbox).groupBy("batch_id", "subscription_id").agg(
        F.min(F.when(F.col("ok"), F.col("sent_at"))).alias("sent_at"), F.max("error").alias("error"))
    due = _groups(spark, outbox).select("batch_id", "made", "no", "block", "since", F.explode("members").alias("m")).where("m.due")
    due = due.withColumn("subscription_id", F.col("block") * BLOCK + F.col("m.at")).join(receipts, ["batch_id", "subscription_id"], "left")
    tries = due.groupBy("made", "no", "block", "subscription_id").agg(
        F.first("m.at").alias("at"), F.first("m.need").alias("need"),
        F.array_sort(F.collect_list(F.struct("batch_id", "since", "sent_at", "error"))).alias("tries"))
    # Members of a group with equal tries are told together what became of a notice.
    log = stored(tries.groupBy("made", "no", "block", "tries").agg(F.collect_list(F.struct("need", "at")).alias("members"))
                 .select("made", "no", "block", "tries", *by_need(F.col("members"))), "tries")
    near = few(log)

    def tried(hits: DataFrame, *columns: Column) -> DataFrame:
        met = _new(hits, near, ["hash", "first_seen_at", "tries"])
        took = F.filter("tries", lambda t: t["since"] <= F.col("first_seen_at"))
        met = met.withColumn("tries", took).where(F.size("tries") > 0)
        return unpacked(packed_hits(met, ["hash", "tries"]).select("hash", *columns, "block", "ats"))

    hits = _hits(spark, outbox).select("batch_id", "no", "hash", "first_seen_at", "employees", "told")
    # A notice that several batches booked may have been tried for a subscription in more than one row.
    many = hits.groupBy("hash").agg((F.min("batch_id") < F.max("batch_id")).alias("_many")).where("_many").select("hash")
    out = [F.size("tries").cast("long").alias("attempts"), F.array_min(F.col("tries.sent_at")).alias("sent_at"),
           F.element_at("tries", -1)["error"].alias("error")]
    once = tried(hits.join(many, "hash", "left_anti"), *out)
    more = tried(hits.join(many, "hash", "left_semi"), F.col("tries")).groupBy("subscription_id", "hash") \
        .agg(F.array_sort(F.flatten(F.collect_list("tries"))).alias("tries")).select("subscription_id", "hash", *out)
    return once.unionByName(more)


def _hits(spark: SparkSession, outbox: str, below: int | None = None) -> DataFrame:
    return read_appended(spark, f"{outbox}/hits", HIT_SCHEMA, below, numbered=True)


def _groups(spark: SparkSession, outbox: str, below: int | None = None) -> DataFrame:
    return read_appended(spark, f"{outbox}/groups", GROUP_SCHEMA, below, numbered=True)


def _receipts(spark: SparkSession, outbox: str, below: int | None = None) -> DataFrame:
    return read_appended(spark, f"{outbox}/receipts", RECEIPT_SCHEMA, below, numbered=True)
