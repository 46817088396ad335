"""Forward-window dynamics of labels: what follows what within the next K messages.

Per message the labels of its next K rows are unfolded from K leads, so a conversation is sorted once
and nothing is gathered; sources are expanded only after that, and counted with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import CONVERSATION, KEY
from .rates import beta_sd, ratio


def label_sets(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """Every message with the sorted array of its positive in-scope labels."""
    sets = scored.where("is_pos AND in_scope").groupBy(*KEY).agg(F.array_sort(F.collect_set("annotation_id")).alias("labels"))
    return messages.join(sets, list(KEY), "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def windows(labelled: DataFrame, k: int) -> DataFrame:
    """``window``: distinct labels within the next k rows (k = 0: of the message itself); ``ahead``: rows there."""
    if k == 0:
        return labelled.withColumns({"window": F.col("labels"), "ahead": F.lit(1)})
    w = Window.partitionBy(*CONVERSATION).orderBy("message_index")
    leads = F.array(*[F.lead("labels", s).over(w) for s in range(1, k + 1)])
    return labelled.withColumn("_l", leads).select(
        "*", F.array_distinct(F.flatten(F.filter("_l", lambda x: x.isNotNull()))).alias("window"), F.size(F.filter("_l", lambda x: x.isNotNull())).alias("ahead")
    ).drop("_l")


def pair_counts(windowed: DataFrame, role: str | None = None) -> DataFrame:
    """(x, y, successes): source messages with x whose forward window holds y; trials per x."""
    rows = windowed if role is None else windowed.where(F.col("role") == role)
    source = rows.where("ahead > 0").select(F.explode("labels").alias("x"), "window")
    trials = source.groupBy("x").agg(F.count("*").alias("trials"))
    hits = source.select("x", F.explode("window").alias("y")).groupBy("x", "y").agg(F.count("*").alias("successes"))
    return hits.join(trials, "x")


def complement_counts(windowed: DataFrame, in_scope: DataFrame) -> DataFrame:
    """As ``pair_counts`` for sources ``not:x``: in-scope messages without the label, unscored ones included."""
    base = in_scope.select(*KEY, "annotation_id").join(windowed.where("ahead > 0").select(*KEY, "labels", "window"), list(KEY))
    absent = base.where(~F.array_contains("labels", F.col("annotation_id"))).select(F.concat(F.lit("not:"), "annotation_id").alias("x"), "window")
    trials = absent.groupBy("x").agg(F.count("*").alias("trials"))
    hits = absent.select("x", F.explode("window").alias("y")).groupBy("x", "y").agg(F.count("*").alias("successes"))
    return hits.join(trials, "x")


def posterior(counts: DataFrame, prior: Column, strength: float = 2.0) -> DataFrame:
    """Beta posterior with prior mean ``prior`` and weight ``strength``: mean, SD, log lift."""
    a, b = F.col("successes") + strength * prior, F.col("trials") - F.col("successes") + strength * (1 - prior)
    mean = a / (a + b)
    return counts.withColumns({"mean": mean, "sd": beta_sd(a, b), "log_lift": F.when(prior > 0, F.ln(mean / prior))})


def window_base(windowed: DataFrame) -> DataFrame:
    """Share of messages with a forward window that holds y."""
    rows = windowed.where("ahead > 0")
    n = rows.agg(F.count("*").alias("n"))
    return rows.select(F.explode("window").alias("y")).groupBy("y").agg(F.count("*").alias("c")).crossJoin(n).select("y", (F.col("c") / F.col("n")).alias("p_window"))


def matrix(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """Dense x by y table over the label list (A23); its size is the square of the number of labels."""
    dense = ids.select(F.col("annotation_id").alias("x")).crossJoin(ids.select(F.col("annotation_id").alias("y")))
    return dense.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("successes", F.lit(0)).alias("successes"), F.coalesce("trials", F.lit(0)).alias("trials"))


def top_pairs(counts: DataFrame, base: DataFrame, k: int, min_n: int = 1, min_c: int = 1, rows: int = 200) -> DataFrame:
    """Pairs by enrichment, count and trials, ties by name; k = 0 leaves x = y out."""
    e = counts.join(base, "y").withColumn("enrichment", ratio(F.col("successes") / F.col("trials"), F.col("p_window")))
    if k == 0:
        e = e.where("x <> y")
    e = e.where(f"trials >= {min_n} AND successes >= {min_c}").withColumn("enrichment", F.round("enrichment", 6))
    return e.orderBy(F.desc("enrichment"), F.desc("successes"), F.desc("trials"), "x", "y").limit(rows)


def triples(windowed: DataFrame) -> DataFrame:
    """(x, y, z, trials_xy, successes): windows after x that hold both y and z."""
    src = windowed.where("ahead > 0").select(F.explode("labels").alias("x"), "window")
    xy = src.select("x", F.explode("window").alias("y"), "window")
    trials = xy.groupBy("x", "y").agg(F.count("*").alias("trials_xy"))
    hits = xy.select("x", "y", F.explode("window").alias("z")).groupBy("x", "y", "z").agg(F.count("*").alias("successes"))
    return hits.join(trials, ["x", "y"])


def effects(p: Column, q: Column) -> dict[str, Column]:
    """Difference, risk ratio and odds ratio, null where they are not defined."""
    return {"delta": p - q, "risk_ratio": ratio(p, q), "odds_ratio": F.when((q > 0) & (q < 1) & (p < 1), (p / (1 - p)) / (q / (1 - q)))}


def baseline_within(p: Column, k: int) -> Column:
    """Chance of at least one in k independent tries."""
    return 1 - F.pow(1 - p, F.lit(k))


def log_matrix(pairs: DataFrame, k: str, x: str, y: str, value: str) -> DataFrame:
    """log2 of ``value`` for every k and every two ids of the table, 0 where it is absent or not above 0, and for k = 0 on the diagonal.

    The result has a row per cell of a matrix, so ids are labels, never records.
    """
    ids = pairs.select(F.col(x).alias("_i")).union(pairs.select(y)).where("_i IS NOT NULL").distinct()
    cells = pairs.select(k).distinct().join(ids.withColumnRenamed("_i", x)).join(ids.withColumnRenamed("_i", y))
    known = pairs.groupBy(k, x, y).agg(F.max(value).alias("_v"))
    off = ~((F.col(k) == 0) & (F.col(x) == F.col(y)))
    return cells.join(known, [k, x, y], "left").select(k, x, y, F.when(off & (F.col("_v") > 0), F.log2("_v")).otherwise(0.0).alias("value"))


def triple_panel(windowed: DataFrame) -> DataFrame:
    """Per x and y every z with P(z | x), P(z | x, y), the change and its place by size of change, ties by name."""
    one = pair_counts(windowed)
    base = one.select("x", F.col("y").alias("z"), (F.col("successes") / F.col("trials")).alias("given_x"))
    three = triples(windowed).where("z <> y").select("x", "y", "z", (F.col("successes") / F.col("trials_xy")).alias("given_xy"))
    both = three.join(base, ["x", "z"]).withColumn("change", F.col("given_xy") - F.col("given_x"))
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc(F.round(F.abs("change"), 9)), "z"))
    return both.withColumn("place", place).select("x", "y", "z", "given_x", "given_xy", "change", "place")
