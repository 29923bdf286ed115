"""Adjudication in batches, and a loop that repairs a taxonomy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("accept_llm", "accept_vendor", "accept_heuristic", "other_leaf", "ambiguous_both", "duplicate", "pii_confirmed", "skip")
MOST_REPAIRS = 3


def adjudicate(answers: DataFrame, views: DataFrame) -> DataFrame:
    """Log rows of answers (doc_id, ordinal, decision, leaf, seconds) on views (doc_id, a_label, b_label, vendor): the final
    label is the accepted one, or the leaf chosen. Answers with an unknown action, or without a leaf where one is needed, are left out."""
    final = F.when(F.col("decision") == "accept_llm", F.col("a_label")).when(F.col("decision") == "accept_vendor", F.col("vendor")).when(F.col("decision") == "accept_heuristic", F.col("b_label")).when(F.col("decision") == "other_leaf", F.col("leaf"))
    good = F.col("decision").isin(*ACTIONS) & ((F.col("decision") != "other_leaf") | F.col("leaf").isNotNull())
    return answers.where(good).join(views, "doc_id").select("doc_id", "ordinal", "decision", final.alias("final_label"), F.bround("seconds", 2).alias("seconds"))


def pending(queue: DataFrame, log: DataFrame) -> DataFrame:
    """The queue without what has been decided; a skip decides nothing."""
    return queue.join(log.where("decision <> 'skip'").select("doc_id").distinct(), "doc_id", "left_anti")


def screens(queue: DataFrame, tickets: DataFrame, labels: DataFrame, flags: DataFrame) -> DataFrame:
    """What a reviewer sees of each document of queue (doc_id, reason, place), in one join for all of them.

    The columns of tickets (doc_id, ...), a_label, a_confidence, a_rationale and
    b_label of its newest labels (doc_id, source, label, confidence, rationale;
    source a or b), and its flags (doc_id, flag_type, detail) as an array by type.
    """
    side = lambda c, s: F.max(F.when(F.col("source") == s, F.col(c)))
    queued = queue.select("doc_id")
    both = labels.join(queued, "doc_id", "left_semi").groupBy("doc_id").agg(side("label", "a").alias("a_label"), side("confidence", "a").alias("a_confidence"), side("rationale", "a").alias("a_rationale"), side("label", "b").alias("b_label"))
    found = flags.join(queued, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("flag_type", "detail"))).alias("flags"))
    return queue.join(tickets, "doc_id", "left").join(both, "doc_id", "left").join(found, "doc_id", "left")


def progress(log: DataFrame) -> DataFrame:
    """How many decisions there are, on how many documents, and the last one's place."""
    return log.agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct("doc_id").alias("documents"), F.max("ordinal").alias("last"))


def undo(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log without the given entries (doc_id, ordinal)."""
    return log.join(entries.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti")


def unconfirmed(log: DataFrame, floor: float) -> DataFrame:
    """Decisions faster than the floor that nobody has confirmed."""
    return log.where((F.col("seconds") < floor) & ~F.coalesce("confirmed", F.lit(False)))


def repaired(proposal, problems: Callable[[object], list[str]], repair: Callable[[object, list[str]], object], most: int = MOST_REPAIRS):
    """A proposal without problems after at most `most` repairs, and how many it took; ValueError if there are any left."""
    for attempt in range(most + 1):
        if not (found := problems(proposal)):
            return proposal, attempt
        if attempt < most:
            proposal = repair(proposal, found)
    raise ValueError(f"{len(found)} problems left: {'; '.join(found)}")
