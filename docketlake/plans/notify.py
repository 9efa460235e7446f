"""One alert cycle in batch: match, digest, ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake import vocab
from docketlake.operators.matching import NOTICE_COLUMNS, active_subscriptions, group_digest, open_hits, packed_hits, recent_notices, unpacked
from docketlake.sources.tables import stored


def alert_cycle(
    notices: DataFrame,
    subs: DataFrame,
    ledger: DataFrame,
    now: dt.datetime | str,
    lookback_hours: float = vocab.LOOKBACK_HOURS,
) -> tuple[DataFrame, DataFrame]:
    """``(messages, ledger_rows)``; append the ledger rows once messages are written.

    Matches are computed once and stored as notices with the groups of subscriptions they meet; messages and ledger rows read them
    back, and pairs are made for the ledger rows alone.  The ledger may be packed.
    """
    hits, groups = open_hits(recent_notices(notices, now, lookback_hours), active_subscriptions(subs), ledger, NOTICE_COLUMNS)
    found = stored(hits.drop("ats"), "matches")
    messages = group_digest(found, groups).join(
        subs.select(F.col("id").alias("subscription_id"), "email", "unsubscribe_token"), "subscription_id"
    )
    booked = unpacked(packed_hits(found.join(groups.select("_group", "ats"), "_group"), ["hash"])) \
        .withColumn("sent_at", F.lit(now).cast("timestamp"))
    return messages, booked
