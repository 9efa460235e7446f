"""Chat formatting of multi-party dialogues, seen from every participant in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
TURNS_PER_PART = 512   # a longer dialogue continues in further parts of its own rows
UNNAMED = "unknown"
TURN_END = "\n"


def _speaker(role: Column) -> Column:
    """Speaker of a turn: lower case, without surrounding spaces; none is ``unknown``."""
    name = F.lower(F.trim(role))
    return F.when(F.coalesce(name, F.lit("")) == "", UNNAMED).otherwise(name)


def rotate_perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text", turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Every dialogue once for every participant, with that speaker as the assistant.

    Columns: ``conversation``, ``part``, ``participant``, ``messages`` (role, name, content in
    turn order), ``rendered`` (the text of the part) and ``masks`` (begin, end): the character
    ranges of ``rendered`` to be learned, that is what the participant says, with its end mark.
    Other speakers become users under their own name; ``system`` turns stay system messages and
    take no perspective, so a dialogue of system turns only gives no row.

    This operator is general: notices hold no dialogues.  Turns are ordered by number, then
    speaker, then text; repeated turns are kept.  NULL turns come first, NULL texts are empty,
    NULL or blank roles are the speaker ``unknown``; rows of a NULL conversation are one
    dialogue.  Other columns are ignored.

    Participants are gathered with partial aggregates and turns per ``turns_per_part`` turn
    numbers, so no task holds a whole dialogue of any length; parts are rows of their own.
    """
    rows = turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), _speaker(F.col(role)).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col(turn) / turns_per_part), F.lit(0)).cast("long").alias("part"))
    people = rows.where(F.col("speaker") != SYSTEM).select("conversation", "speaker").distinct() \
        .withColumnsRenamed({"conversation": "_conversation", "speaker": "participant"})
    parts = rows.groupBy("conversation", "part").agg(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    seen = parts.join(people, parts["conversation"].eqNullSafe(people["_conversation"])).drop("_conversation")

    def message(t: Column) -> Column:
        own, frame = t["speaker"] == F.col("participant"), t["speaker"] == SYSTEM
        kind = F.when(frame, "system").when(own, "assistant").otherwise("user")
        return F.struct(kind.alias("role"), F.when(frame | own, F.lit(None)).otherwise(t["speaker"]).alias("name"),
                        t["text"].alias("content"))

    def head(m: Column) -> Column:
        return F.concat(F.lit("<|"), m["role"], F.coalesce(F.concat(F.lit(" name="), m["name"]), F.lit("")), F.lit("|>"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("masks"))

    def advance(state: Column, m: Column) -> Column:
        begin = state["at"] + F.length(head(m))
        end = begin + F.length(m["content"]) + len(TURN_END)
        mine = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["role"] == "assistant", F.concat(state["masks"], mine))
                        .otherwise(state["masks"]).alias("masks"))

    return (seen.withColumn("messages", F.transform("turns", message))
            .select("conversation", "part", "participant", "messages",
                    F.array_join(F.transform("messages", lambda m: F.concat(head(m), m["content"], F.lit(TURN_END))), "").alias("rendered"),
                    F.aggregate("messages", start, advance, lambda s: s["masks"]).alias("masks")))
