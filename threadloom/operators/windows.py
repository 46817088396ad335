"""Window and sequence operators over conversations and dated messages.

Frames are declared, so Spark sorts once per (partition, order) and streams the frame. Null order
values sort first and take part in row frames; null measures are skipped by the aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import CONVERSATION, KEY


def rolling_rows(df: DataFrame, by: list[str], order: list[str], value: str, n: int, how: str = "mean") -> DataFrame:
    """Trailing n rows, the current one included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("rolling", (F.avg if how == "mean" else F.sum)(value).over(w))


def rolling_time(df: DataFrame, by: list[str], ts: str, value: str, seconds: int, how: str = "mean") -> DataFrame:
    """Rows with a timestamp in [t - seconds, t]; equal timestamps belong to each other's windows."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("rolling", (F.avg if how == "mean" else F.sum)(value).over(w))


def rolling_time_no_peers(df: DataFrame, by: list[str], ts: str, tiebreak: str, value: str, seconds: int) -> DataFrame:
    """As ``rolling_time`` without rows of the same timestamp that come later by ``tiebreak``.

    The range mean is corrected by the later peers' sum and count.
    """
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    later = Window.partitionBy(*by, ts).orderBy(tiebreak).rowsBetween(1, Window.unboundedFollowing)
    total = F.sum(value).over(w) - F.coalesce(F.sum(value).over(later), F.lit(0.0))
    n = F.count(value).over(w) - F.count(value).over(later)
    return df.withColumn("rolling", F.when(n > 0, total / n))


def conversation_places(messages: DataFrame) -> DataFrame:
    """(conversation, slot, before): its number among the participant's conversations and the messages before it.

    Only this table of conversations is sorted per participant, so one who holds much of all messages is no
    task of messages.
    """
    w = Window.partitionBy("participant").orderBy("source_path", "chat_index")
    sizes = messages.groupBy(*CONVERSATION).agg(F.count_distinct("message_index").alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(*CONVERSATION, (F.row_number().over(w) - 1).alias("slot"), before.alias("before"))


def with_places(df: DataFrame, places: DataFrame) -> DataFrame:
    """``df`` with slot and before; null parts of a conversation's key equal each other."""
    p = places.select(*[F.col(c).alias("_" + c) for c in CONVERSATION], "slot", "before")
    return df.join(p, [df[c].eqNullSafe(p["_" + c]) for c in CONVERSATION]).drop(*["_" + c for c in CONVERSATION])


def positions(messages: DataFrame) -> DataFrame:
    """Messages with their number among the participant's messages, from 0."""
    within = Window.partitionBy(*CONVERSATION).orderBy("message_index")
    return with_places(messages, conversation_places(messages)).withColumn("position", F.col("before") + F.row_number().over(within) - 1).drop("slot", "before")


def series(scored: DataFrame, n: int) -> DataFrame:
    """Per participant and annotation: global message number from 0 and trailing share of positives."""
    within = Window.partitionBy(*CONVERSATION).orderBy("message_index")
    numbered = with_places(scored, conversation_places(scored)).withColumn("position", F.col("before") + F.dense_rank().over(within) - 1)
    placed = numbered.drop("slot", "before").withColumn("hit", F.col("is_pos").cast("double"))
    return rolling_rows(placed, ["participant", "annotation_id"], ["position"], "hit", n)


def grid(series_: DataFrame, by: list[str], x: str, y: str, bins: int) -> DataFrame:
    """Linear interpolation of each series on ``bins`` points from its first to its last x.

    Each pair of neighbours yields the grid points between them, so no series is gathered.
    """
    w = Window.partitionBy(*by)
    o = w.orderBy(x)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    scaled = series_.select(*by, x, y, F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias("u"))
    segs = scaled.select(*by, "u", F.col(y).alias("y0"), F.lead("u").over(o).alias("u1"), F.lead(y).over(o).alias("y1"), F.row_number().over(o).alias("rn"), F.count("*").over(w).alias("n"))
    last = bins - 1
    start = F.when(F.col("rn") == 1, F.lit(0)).otherwise((F.floor(F.col("u") * last) + 1).cast("int"))
    stop = F.when(F.col("u1").isNull() | (F.col("rn") == F.col("n") - 1), F.lit(last)).otherwise(F.floor(F.col("u1") * last).cast("int"))
    alone = F.col("n") == 1
    kept = segs.where(alone | F.col("u1").isNotNull()).withColumns({"start": start, "stop": stop}).where("start <= stop")
    points = kept.select("*", F.explode(F.sequence("start", "stop")).alias("bin"))
    at = F.col("bin") / F.lit(float(last))
    value = F.when(alone | (F.col("u1") == F.col("u")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("u")) / (F.col("u1") - F.col("u")))
    return points.select(*by, "bin", value.alias("value"))


def mean_curve(gridded: DataFrame, by: list[str], z: float = 1.96) -> DataFrame:
    """Mean over series per group and bin with a sample-SE interval."""
    half = F.coalesce(z * F.stddev_samp("value") / F.sqrt(F.count("*")), F.lit(0.0))
    return gridded.groupBy(*by, "bin").agg(F.count("*").alias("series"), F.avg("value").alias("mean"), (F.avg("value") - half).alias("low"), (F.avg("value") + half).alias("high"))


def span_reached(positives: DataFrame, m: int, span: int) -> DataFrame:
    """Conversations where some m positives lie within ``span`` places."""
    w = Window.partitionBy("annotation_id", *CONVERSATION).orderBy("message_index")
    close = F.lead("message_index", m - 1).over(w) - F.col("message_index") <= span
    return positives.withColumn("close", F.coalesce(close, F.lit(False))).groupBy("annotation_id", *CONVERSATION).agg(F.max("close").alias("reached"))


def gap_sessions(positives: DataFrame, k: int) -> DataFrame:
    """Runs of positives whose gaps are at most k: one row per run with its size."""
    w = Window.partitionBy("annotation_id", *CONVERSATION).orderBy("message_index")
    start = F.when(F.col("message_index") - F.lag("message_index").over(w) <= k, 0).otherwise(1)
    runs = positives.withColumn("start", start).withColumn("run", F.sum("start").over(w))
    return runs.groupBy("annotation_id", *CONVERSATION, "run").agg(F.count("*").alias("hits"), F.min("message_index").alias("first_place"))


def mean_with_errors(counts: DataFrame, by: list[str], value: str = "hits", cluster: str = "participant") -> DataFrame:
    """Mean, sample SD, naive SE and cluster SE with factor G/(G-1) (A15): two aggregations, no gathering."""
    inner = counts.groupBy(*by, cluster).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = Window.partitionBy(*by)
    mean = F.sum("s").over(total) / F.sum("n").over(total)
    resid = inner.withColumn("mean", mean).withColumn("r", F.col("s") - F.col("n") * F.col("mean"))
    n, g = F.sum("n"), F.count("*")
    var = (F.sum("q") - n * F.first("mean") * F.first("mean")) / (n - 1)
    sd = F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
    return resid.groupBy(*by).agg(
        n.alias("n"), g.alias("clusters"), F.first("mean").alias("mean"), sd.alias("sd"), (sd / F.sqrt(n)).alias("se"),
        F.when(g > 1, F.sqrt(F.sum(F.col("r") * F.col("r"))) / n * F.sqrt(g / (g - 1))).alias("cluster_se"),
    )


def next_k(positives: DataFrame, k: int) -> DataFrame:
    """Later positives of the conversation within k places, per positive."""
    w = Window.partitionBy("annotation_id", *CONVERSATION).orderBy("message_index").rangeBetween(1, k)
    return positives.withColumn("following", F.count("*").over(w))


def pmf(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Probability of each count."""
    c = counts.groupBy(*by, value).agg(F.count("*").alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def lengths(messages: DataFrame) -> DataFrame:
    """Messages per conversation."""
    return messages.groupBy(*CONVERSATION).agg(F.count("*").alias("length"))


def remaining(messages: DataFrame) -> DataFrame:
    """Place, remaining messages, their log and the share of time gone; the last message is dropped."""
    conv = Window.partitionBy(*CONVERSATION)
    placed = messages.withColumns({"place": F.row_number().over(conv.orderBy("message_index")), "length": F.count("*").over(conv)})
    left = F.col("length") - F.col("place")
    return placed.where(left > 0).select(*KEY, "role", "place", left.alias("left"), F.ln(left).alias("log_left"), ((F.col("place") - 1) / (F.col("length") - 1)).alias("time_share"))


def turn_index(messages: DataFrame) -> DataFrame:
    """Running number of user messages from 0, null before the first."""
    w = Window.partitionBy(*CONVERSATION).orderBy("message_index").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    return messages.withColumn("turn", F.when(n > 0, n - 1))


def preceding_range(messages: DataFrame, n: int) -> DataFrame:
    """Earlier messages whose index is within n before (J14): their indices in order."""
    w = Window.partitionBy(*CONVERSATION).orderBy("message_index").rangeBetween(-n, -1)
    return messages.withColumn("before", F.collect_list("message_index").over(w))


def preceding_skipping(messages: DataFrame, depth: int, skip: Column) -> DataFrame:
    """Back to ``depth`` messages that are not skipped; skipped ones in between are included.

    Returns (key, first_index, size): a contiguous stretch before the message, found by running counts.
    """
    w = Window.partitionBy(*CONVERSATION).orderBy("message_index")
    up_to = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = messages.withColumns({
        "rn": F.row_number().over(w), "kept": F.coalesce(F.sum(F.when(skip, 0).otherwise(1)).over(up_to), F.lit(0)),
        "counts": ~skip,
    })
    # The stretch starts at the row whose running count is depth less; that row is an equi-join away.
    starts = counted.where("counts").select(*CONVERSATION, F.col("kept").alias("_k"), F.col("rn").alias("start_rn"), F.col("message_index").alias("start_index"))
    first = counted.groupBy(*CONVERSATION).agg(F.min("message_index").alias("first_of_all"))
    want = counted.withColumn("_k", F.greatest(F.col("kept") - depth, F.lit(-1)))
    joined = want.join(first, list(CONVERSATION)).join(starts, [*CONVERSATION, "_k"], "left")
    whole = F.col("kept") < depth
    return joined.select(
        *KEY, F.when(F.col("rn") == 1, None).when(whole, F.col("first_of_all")).otherwise(F.col("start_index")).alias("first_index"),
        F.when(whole, F.col("rn") - 1).otherwise(F.col("rn") - F.col("start_rn")).cast("int").alias("size"),
    )


def slice_around(messages: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Messages within ``before``/``after`` places of an anchor of their conversation."""
    a = anchors.withColumnRenamed("message_index", "anchor")
    d = F.col("message_index") - F.col("anchor")
    return messages.join(a, list(CONVERSATION)).where(d.between(-before, after)).withColumn("offset", d)


def first_anchor(positives: DataFrame) -> DataFrame:
    """Earliest positive of each conversation and annotation."""
    return positives.groupBy("annotation_id", *CONVERSATION).agg(F.min("message_index").alias("message_index"))


def first_conversations(messages: DataFrame, n: int) -> DataFrame:
    """Messages of the first n conversations of each participant."""
    return with_places(messages, conversation_places(messages).where(F.col("slot") < n)).drop("slot", "before")


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of each value in its group's total; zero totals stay zero."""
    t = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn("share", F.when(t != 0, F.col(value) / t).otherwise(F.lit(0.0)))


def stopped(scored: DataFrame, limit: int = 10) -> DataFrame:
    """Conversations that a prefilter would stop: no positive among their first ``limit`` scored messages."""
    w = Window.partitionBy("annotation_id", *CONVERSATION).orderBy("message_index")
    head = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    return head.groupBy("annotation_id", *CONVERSATION).agg(F.count("*").alias("seen"), F.max("is_pos").alias("hit")).where(f"seen = {limit} AND NOT hit")


def sequence_points(messages: DataFrame) -> DataFrame:
    """Fractional x position of each message within its conversation's slot."""
    conv = Window.partitionBy(*CONVERSATION)
    within = (F.row_number().over(conv.orderBy("message_index")) - 1) / F.count("*").over(conv)
    return with_places(messages, conversation_places(messages)).withColumn("x", F.col("slot") + within).drop("slot", "before")


def top_curves(series_: DataFrame, who: str, label: str, group: str, x: str, y: str, n: int) -> DataFrame:
    """The n groups of each ``who`` with the largest area under their summed curves, zero outside a curve's own range.

    Curves are interpolated at all places of ``who``. The sum of a straight piece over the places inside it needs only
    their number and their sum, which prefix counts give, so no curve is unfolded: two aggregations and one window per curve.
    """
    places = series_.select(who, x).distinct()
    order = Window.partitionBy(who).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    prefix = places.select(who, x, F.count("*").over(order).alias("k"), F.sum(F.col(x).cast("double")).over(order).alias("s"))
    curve = Window.partitionBy(who, label).orderBy(x)
    at = series_.join(prefix, [who, x])
    pieces = at.select(
        who, group, F.col(x).cast("double").alias("x0"), F.col(y).alias("y0"), "k", "s",
        F.lead(F.col(x).cast("double")).over(curve).alias("x1"), F.lead(y).over(curve).alias("y1"), F.lead("k").over(curve).alias("k1"), F.lead("s").over(curve).alias("s1"),
    )
    inside, total = F.col("k1") - 1 - F.col("k"), F.col("s1") - F.col("x1") - F.col("s")
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    area = F.col("y0") + F.when(F.col("x1").isNotNull() & (inside > 0), inside * F.col("y0") + slope * (total - inside * F.col("x0"))).otherwise(0.0)
    sums = pieces.withColumn("_a", area).groupBy(who, group).agg(F.round(F.sum("_a"), 6).alias("area"))
    rank = F.row_number().over(Window.partitionBy(who).orderBy(F.desc("area"), group))
    return sums.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
