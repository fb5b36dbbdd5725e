"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

Method
    Turns of a conversation are one array in the order of turn, role and text. The longest common prefix of the two arrays is
    rendered once as the prompt; what follows in each is its completion. A completion's mask lists the spans of characters
    to learn from: the text and end mark of its assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def conversations_as_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>: one row for each conversation. Null roles and texts are empty; a null turn comes first."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    ordered = F.filter("turns", lambda t: t["turn"].isNull()), F.filter("turns", lambda t: t["turn"].isNotNull())
    return grouped.select("conv_id", F.transform(F.concat(*ordered), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def last_assistant(turns: Column) -> Column:
    """Index from 0 of the last assistant turn; -1 without one."""
    places = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i).otherwise(-1)), lambda i: i >= 0)
    return F.coalesce(F.array_max(places), F.lit(-1))


def with_last_reply(turns: Column, reply: Column) -> Column:
    """turns with the text of the last assistant turn replaced; as they are without one or without a reply."""
    at = last_assistant(turns)
    return F.transform(F.array(F.struct(at.alias("at"), turns.alias("turns"))), lambda x: F.transform(x["turns"], lambda t, i: F.struct(t["role"].alias("role"), F.when((i == x["at"]) & reply.isNotNull(), reply).otherwise(t["text"]).alias("text"))))[0]


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(f"{END}\n"))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns: Column) -> Column:
    """start:end of the characters to learn from, comma-joined, in a rendering of turns."""
    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + F.char_length(t["role"]) + len(START) + 1
        b = a + F.char_length(t["text"]) + len(END)
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.when(acc["spans"] == "", "").otherwise(","), a.cast("string"), F.lit(":"), b.cast("string"))).otherwise(acc["spans"])
        return F.struct((b + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.when(p["a"].eqNullSafe(p["b"]), None).otherwise(i))
    return F.coalesce(F.array_min(pairs), F.greatest(F.size(a), F.size(b)))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for each row of pairs.

    pairs: pair_id, chosen, rejected (arrays of struct<role, text>); null arrays are empty. Where both are the same, all turns are the
    prompt and both completions are empty; where one begins the other, its completion is empty. Repeated rows are formatted alike. Null roles
    and texts must be empty strings, as conversations_as_arrays() makes them; other columns are ignored. Conversations and texts of any length
    are rendered whole; an empty table gives an empty result.
    """
    kind = "array<struct<role:string,text:string>>"
    rows = pairs.select("pair_id", *(F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c in ("chosen", "rejected")))
    rows = rows.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    tail = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    return rows.select(
        "pair_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"), text_of(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        text_of(tail("chosen")).alias("chosen"), text_of(tail("rejected")).alias("rejected"), mask_of(tail("chosen")).alias("chosen_mask"), mask_of(tail("rejected")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation, rejected has the last assistant reply of the next one.

    The next conversation has the conv_id that is larger by 1, or else the smallest of all. A turn without a conv_id is a conversation of its
    own, with pair_id null. Conversations of any length are whole; equal turns stay as often as they occur; an empty table gives an empty result.
    Only the texts of last replies are dealt out a second time.
    """
    known = turns.where("conv_id is not null")
    conv = conversations_as_arrays(known)
    one = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = turns.where("conv_id is null").select("conv_id", F.array(one).alias("turns"))
    # conversations order their turns by turn, role and text: among assistant turns the greatest is the last
    last = F.max(F.when(F.col("role") == "assistant", F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))["text"]
    reply = known.groupBy((F.col("conv_id") - 1).alias("before")).agg(last.alias("next_reply")).withColumn("has_next", F.lit(True))
    first = known.where(F.col("conv_id") == known.agg(F.min("conv_id")).scalar()).agg(last).scalar()
    rows = conv.join(reply, conv["conv_id"] == reply["before"], "left").select("conv_id", "turns", "next_reply", "has_next")
    rows = rows.unionByName(alone, allowMissingColumns=True).withColumn("first_reply", first)
    other = F.when(F.col("has_next"), F.col("next_reply")).otherwise(F.col("first_reply"))
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), with_last_reply(F.col("turns"), other).alias("rejected"))
