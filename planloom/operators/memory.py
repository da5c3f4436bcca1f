"""Conversation summaries and fact search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.ordered import first_n


def old_turns(messages: DataFrame, keep: int) -> DataFrame:
    """All but the newest ``keep`` turns of each conversation.

    The cut is the ``keep``-th newest turn (a bounded top-n per conversation), so no conversation is sorted whole.
    """
    cut = first_n(messages.select("conv_id", "turn"), ["conv_id"], [F.desc("turn")], keep).groupBy("conv_id").agg(
        F.min("turn").alias("cut"))
    return messages.join(cut, "conv_id").where(F.col("turn") < F.col("cut")).drop("cut")


def summarize_conversation(messages: DataFrame, keep: int = 6, topics: int = 3, topic_chars: int = 50,
                           max_tokens: int = 200, error_role: str = "tool", actions: int = 10) -> DataFrame:
    """Summary of the old turns per conversation: first distinct topics, first ``actions`` distinct actions, error count, tokens saved.

    ``messages``: (conv_id, turn, role, text), and the assistant's actions as ``tool_calls`` (array of names) where there are
    any. The first distinct topics and actions come from a minimum turn for each, followed by a top-n, so a long conversation
    is never collected.
    """
    old = old_turns(messages, keep)
    topic = F.trim(F.substring("text", 1, topic_chars))
    firsts = old.where("role = 'user'").withColumn("topic", topic).where(F.length("topic") > 0).groupBy(
        "conv_id", "topic").agg(F.min("turn").alias("turn"))
    few = first_n(firsts, ["conv_id"], [F.col("turn")], topics)
    listed = few.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "topic"))).alias("t"))
    listed = listed.withColumn("acts", F.lit(None).cast("string"))
    if "tool_calls" in messages.columns:
        calls = old.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("tool_calls").alias("pos", "act"))
        done = calls.groupBy("conv_id", "act").agg(F.min(F.struct("turn", "pos")).alias("at"))
        named = first_n(done, ["conv_id"], [F.col("at"), F.col("act")], actions).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "act"))).alias("l"))
        named = named.select("conv_id", F.array_join(F.transform("l", lambda s: s["act"]), ", ").alias("acts"))
        listed = listed.drop("acts").join(named, "conv_id", "full_outer")
    bad = F.contains(F.lower("text"), F.lit("error")) | F.contains(F.lower("text"), F.lit("failed"))
    totals = old.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages_summarized"),
        F.sum(F.floor(F.length("text") / 4)).cast("long").alias("old_tokens"),
        F.count_if((F.col("role") == error_role) & bad).alias("errors"))
    joined = F.array_join(F.transform("t", lambda s: s["topic"]), "; ")
    parts = F.concat_ws(". ", F.when(F.col("t").isNotNull(), F.concat(F.lit("Topics: "), joined)),
                        F.concat(F.lit("Actions: "), "acts"),
                        F.when(F.col("errors") > 0, F.concat(F.lit("Errors encountered: "), F.col("errors").cast("string"))))
    text = F.when(parts == "", "[Previous conversation context]").otherwise(parts)
    cap = max_tokens * 4
    text = F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap - 3), F.lit("..."))).otherwise(text)
    return totals.join(listed, "conv_id", "left").withColumn("summary", text).select(
        "conv_id", "messages_summarized", "errors", "summary",
        (F.col("old_tokens") - F.floor(F.length("summary") / 4)).alias("tokens_saved"))


def facts_keyword(facts: DataFrame, q: str) -> DataFrame:
    """Case-insensitive match on key or JSON value."""
    return facts.where(F.contains(F.lower("key"), F.lit(q.lower())) | F.contains(F.lower("value"), F.lit(q.lower())))


def merge_relevant(facts: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    """Facts plus the hits that are not among them."""
    return facts.unionByName(hits.join(facts.select(key), key, "left_anti").select(*facts.columns))
