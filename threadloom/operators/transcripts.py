"""Transcript statistics, ordering classes, alternation checks and message trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from .model import CONVERSATION, KEY, role_word


def participant_stats(messages: DataFrame) -> DataFrame:
    """Per participant and over all: conversations, messages, characters, words, longest, median length.

    Rows without a full key are left out; a message sent several times counts once.
    """
    once = messages.where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEY).agg(F.min_by("content", "row_id").alias("content"))
    per = once.groupBy(*CONVERSATION).agg(
        F.count("*").alias("length"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"), F.sum(word_count(F.col("content"))).alias("words")
    )
    total = per.groupingSets([[F.col("participant")], []], F.col("participant")).agg(
        F.count("*").alias("conversations"), F.sum("length").alias("messages"), F.sum("chars").alias("chars"), F.sum("words").alias("words"),
        F.max("length").alias("longest"), F.percentile("length", F.lit(0.5)).alias("median_length"),
    )
    return total.withColumn("participant", F.coalesce("participant", F.lit("TOTAL")))


def ordering_of_records(records: DataFrame, least: float = 0.9) -> DataFrame:
    """Ordering class and flags of each participant by coverage.

    full_dated where at least ``least`` of the messages have a time or of the conversations a date, then
    global_order where messages have an index, else conversation_only. A message sent again counts once.
    """
    filled = lambda name: F.trim(F.coalesce(name, F.lit(""))) != ""
    chats = records.where("participant IS NOT NULL AND source_path IS NOT NULL AND chat_index IS NOT NULL")
    by_message = chats.where("message_index IS NOT NULL").groupBy(*KEY).agg(F.max(filled("timestamp")).alias("t"))
    m = by_message.groupBy("participant").agg(F.count("*").alias("messages"), F.avg(F.col("t").cast("int")).alias("ts"))
    c = chats.groupBy(*CONVERSATION).agg(F.max(filled("chat_date")).alias("d")).groupBy("participant").agg(F.avg(F.col("d").cast("int")).alias("dates"))
    ts, dates, n = (F.coalesce(x, F.lit(0)) for x in ("ts", "dates", "messages"))
    kind = F.when(((ts >= least) & (ts > 0)) | ((dates >= least) & (dates > 0)), "full_dated").when(n > 0, "global_order").otherwise("conversation_only")
    return c.join(m, "participant", "left").select(
        "participant", kind.alias("ordering_type"), (ts > 0).alias("has_timestamps"), (dates > 0).alias("has_conversation_dates"), (n > 0).alias("has_message_indices")
    )


def ordering_of_transcripts(messages: DataFrame) -> DataFrame:
    """Ordering class of each participant by its files (A37): any date makes full_dated, else one file makes
    global_order, else conversation_only; unknown without messages. A label that is not blank is a date here."""
    dated = (F.trim(F.coalesce("timestamp", F.lit(""))) != "") | (F.trim(F.coalesce("chat_date", F.lit(""))) != "")
    per = messages.where("participant IS NOT NULL").groupBy("participant").agg(
        F.count_if(F.col("chat_index").isNotNull() & F.col("message_index").isNotNull()).alias("n"), F.max(dated).alias("dated"), F.count_distinct("source_path").alias("files")
    )
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("dated"), "full_dated").when(F.col("files") == 1, "global_order").otherwise("conversation_only")
    return per.select("participant", kind.alias("ordering_type"))


def daily(df: DataFrame, ts: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts per day and kind."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def alternation(messages: DataFrame) -> DataFrame:
    """Whether a conversation has two messages, starts with the user and alternates."""
    w = Window.partitionBy(*CONVERSATION).orderBy("message_index")
    steps = messages.withColumns({"before": F.lag("role").over(w), "rn": F.row_number().over(w)})
    return steps.groupBy(*CONVERSATION).agg(
        F.count("*").alias("length"), F.max_by("role", -F.col("rn")).alias("first_role"), F.count_if(F.col("role").eqNullSafe(F.col("before")) & (F.col("rn") > 1)).alias("repeats")
    ).select(*CONVERSATION, ((F.col("length") >= 2) & (F.coalesce(F.col("first_role"), F.lit("")) == "user") & (F.col("repeats") == 0)).alias("valid"))


def longest_path(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, turns): the root-to-leaf path with the most scoring turns of every tree.

    ``nodes`` has tree, node, parent, rank (order among siblings), turn (0/1); of leaves with equal turns the one
    met first in the order of siblings wins. Every node's known chain of ancestors doubles per round, one
    equi-join each, so as many rounds run as the depth of the deepest tree has binary digits. Nodes on a
    cycle never reach a root: they are those still open when chains as long as all nodes were followed, and drop out.
    The order of siblings is compared by the ranks at the forks of the path, so a chain carries none.
    """
    from ..runtime import staged

    # up: the ancestor reached so far; gain: turns from the node up to, not including, that ancestor.
    # A stated parent that is not there makes a root, and roots are each other's siblings.
    there = nodes.select("tree", F.col("node").alias("parent"), F.col("node").alias("_p"))
    nodes = nodes.join(there, ["tree", "parent"], "left").withColumn("parent", F.col("_p")).drop("_p")
    fork = F.when(F.count("*").over(Window.partitionBy("tree", "parent")) > 1, F.array("rank")).otherwise(F.array().cast("array<int>"))
    state = staged(nodes.select("tree", "node", F.col("parent").alias("up"), F.col("turn").cast("bigint").alias("gain"), fork.alias("ranks")), "paths")
    known = nodes.select("tree", F.col("node").alias("up"))
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= longest:
        still = state.join(known, ["tree", "up"], "left_semi").agg(F.count("*")).first()[0]
        if not still:
            break
        a, b = state.alias("a"), state.alias("b")
        state = staged(
            a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.node")), "left").select(
                F.col("a.tree").alias("tree"), F.col("a.node").alias("node"), F.when(F.col("b.node").isNull(), F.col("a.up")).otherwise(F.col("b.up")).alias("up"),
                (F.col("a.gain") + F.coalesce("b.gain", F.lit(0))).alias("gain"), F.concat(F.coalesce("b.ranks", F.array().cast("array<int>")), F.col("a.ranks")).alias("ranks"),
            ), "paths",
        )
        reach *= 2
    rooted = state.join(known, ["tree", "up"], "left_anti")
    leaves = rooted.join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    return leaves.groupBy("tree").agg(F.min_by("node", F.struct(-F.col("gain"), F.col("ranks"))).alias("leaf"), F.max("gain").alias("turns"))


def with_roles(messages: DataFrame) -> DataFrame:
    return messages.withColumn("role", role_word(F.col("role")))
