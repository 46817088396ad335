"""Frequencies, rates and coverage. Ratios are null where nothing was counted; results keep raw doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import CONVERSATION, KEY

Z95 = 1.96


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def beta_sd(a: Column, b: Column) -> Column:
    """Standard deviation of a Beta distribution, null for parameters that are none (F32).

    In doubles: the cube of two million counts overflows 64 bits.
    """
    a, b = a.cast("double"), b.cast("double")
    s = a + b
    return F.when((a > 0) & (b > 0), F.sqrt(a * b / (s * s * (s + 1))))


def beta_ci(a: Column, b: Column, z: float = Z95) -> tuple[Column, Column]:
    """Normal interval of a Beta mean, clamped to [0, 1]."""
    mean, sd = ratio(a, a + b), beta_sd(a, b)
    return F.greatest(F.lit(0.0), mean - z * sd), F.least(F.lit(1.0), mean + z * sd)


def _n(condition: str) -> Column:
    return F.count_if(F.expr(condition))


def frequencies(scored: DataFrame, at_least: int = 3) -> DataFrame:
    """Per annotation: rates pooled over scored messages (all, user, assistant), and the mean and
    population SD of participants' own rates, with the share of participants with ``at_least`` positives (A08)."""
    by_role = scored.where("in_scope").groupBy("annotation_id", "participant").agg(
        F.count("*").alias("n"), _n("is_pos").alias("pos"),
        _n("role = 'user'").alias("nu"), _n("is_pos and role = 'user'").alias("pu"),
        _n("role = 'assistant'").alias("na"), _n("is_pos and role = 'assistant'").alias("pa"),
    )
    own = F.col("pos") / F.col("n")
    return by_role.groupBy("annotation_id").agg(
        F.sum("n").alias("messages"), F.sum("pos").alias("positives"),
        ratio(F.sum("pos"), F.sum("n")).alias("rate_all"), ratio(F.sum("pu"), F.sum("nu")).alias("rate_user"),
        ratio(F.sum("pa"), F.sum("na")).alias("rate_assistant"),
        F.count("*").alias("participants"), F.avg(own).alias("participant_mean"), F.stddev_pop(own).alias("participant_sd"),
        (F.count_if(F.col("pos") >= at_least) / F.count("*")).alias("share_with_k"),
    )


def any_positive(scored: DataFrame, members: Column) -> DataFrame:
    """Per in-scope message of any member: whether one of them is positive (A09, A10). A key that stands with two roles is one message."""
    return scored.where(members & F.col("in_scope")).groupBy(*KEY).agg(F.max("is_pos").alias("hit"))


def set_summary(messages: DataFrame, z: float = Z95) -> DataFrame:
    """Pooled Beta(1+pos, 1+neg) mean and interval, and participants' mean with a sample-SD interval."""
    per = messages.groupBy("participant").agg(F.count("*").alias("n"), _n("hit").alias("pos"))
    own = F.col("pos") / F.col("n")
    a, b = F.sum("pos") + 1, F.sum(F.col("n") - F.col("pos")) + 1
    low, high = beta_ci(a, b, z)
    half = F.coalesce(z * F.stddev_samp(own) / F.sqrt(F.count("*")), F.lit(0.0))
    return per.agg(
        F.sum("n").alias("messages"), F.sum("pos").alias("positives"), (a / (a + b)).alias("beta_mean"), low.alias("beta_low"), high.alias("beta_high"),
        F.count("*").alias("participants"), F.avg(own).alias("mean_rate"),
        F.greatest(F.lit(0.0), F.avg(own) - half).alias("mean_low"), F.least(F.lit(1.0), F.avg(own) + half).alias("mean_high"),
    )


def positive_counts(scored: DataFrame) -> DataFrame:
    """Positives, total and fraction per annotation."""
    return scored.groupBy("annotation_id").agg(
        _n("is_pos").alias("positives"), F.count("*").alias("total"), ratio(_n("is_pos"), F.count("*")).alias("fraction")
    )


def with_total(scored: DataFrame) -> DataFrame:
    """Per annotation and over all: rows, distinct messages, positive rates (A04, A35 style total row)."""
    grouped = scored.groupingSets([[F.col("annotation_id")], []], F.col("annotation_id")).agg(
        F.count("*").alias("rows"), F.count_distinct(*KEY).alias("messages"), _n("score > 0").alias("above_zero"),
        ratio(_n("score > 0"), F.count("*")).alias("above_zero_rate"), ratio(_n("is_pos"), F.count("*")).alias("positive_rate"),
    )
    return grouped.withColumn("annotation_id", F.coalesce("annotation_id", F.lit("ALL")))


def participant_rates(in_scope: DataFrame, scored: DataFrame) -> DataFrame:
    """Positives over all in-scope messages, unscored ones included, per participant and annotation."""
    denominators = in_scope.groupBy("participant", "annotation_id").agg(F.count("*").alias("in_scope"))
    hits = scored.where("in_scope").groupBy("participant", "annotation_id").agg(_n("is_pos").alias("positives"))
    return denominators.join(hits, ["participant", "annotation_id"], "left").select(
        "participant", "annotation_id", "in_scope", F.coalesce("positives", F.lit(0)).alias("positives"),
        (F.coalesce("positives", F.lit(0)) / F.col("in_scope")).alias("rate"),
    )


def covered(rates: DataFrame, least_per_participant: int, least_per_annotation: int) -> DataFrame:
    """Participants with enough annotations, then annotations with enough of those participants."""
    kept = rates.withColumn("c", F.count("rate").over(Window.partitionBy("participant"))).where(F.col("c") >= least_per_participant)
    return kept.withColumn("c", F.count("rate").over(Window.partitionBy("annotation_id"))).where(F.col("c") >= least_per_annotation).drop("c")


def z_scores(rates: DataFrame, row: str = "annotation_id") -> DataFrame:
    """Standard scores within a row by population SD, 0 where it does not vary."""
    w = Window.partitionBy(row)
    sd = F.stddev_pop("rate").over(w)
    return rates.withColumn("z", F.when(sd > 0, (F.col("rate") - F.avg("rate").over(w)) / sd).otherwise(0.0))


def onset(scored: DataFrame, in_scope: DataFrame, k: int = 2) -> DataFrame:
    """Lifetime position of the k-th positive among a participant's in-scope messages: mean, population
    SE and share of participants that reach it (A19)."""
    order = ["source_path", "chat_index", "message_index"]
    w = Window.partitionBy("participant", "annotation_id").orderBy(*order)
    flags = in_scope.join(scored.select(*KEY, "annotation_id", "is_pos"), [*KEY, "annotation_id"], "left")
    placed = flags.withColumns({"place": F.row_number().over(w), "seen": F.sum(F.coalesce(F.col("is_pos"), F.lit(False)).cast("int")).over(w)})
    first = placed.where(F.col("is_pos") & (F.col("seen") == k)).select("participant", "annotation_id", "place")
    base = in_scope.select("participant", "annotation_id").distinct()
    return base.join(first, ["participant", "annotation_id"], "left").groupBy("annotation_id").agg(
        F.count("*").alias("participants"), F.count("place").alias("reached"), F.avg("place").alias("mean_onset"),
        (F.stddev_pop("place") / F.sqrt(F.count("place"))).alias("se_onset"), (F.count("place") / F.count("*")).alias("share"),
    )


def base_rates(in_scope: DataFrame, scored: DataFrame) -> DataFrame:
    """Messages with Y over all in-scope messages."""
    total = in_scope.groupBy("annotation_id").agg(F.count("*").alias("in_scope"))
    hits = scored.where("in_scope").groupBy("annotation_id").agg(_n("is_pos").alias("positives"))
    return total.join(hits, "annotation_id", "left").select(
        "annotation_id", "in_scope", F.coalesce("positives", F.lit(0)).alias("positives"), (F.coalesce("positives", F.lit(0)) / F.col("in_scope")).alias("base_rate")
    )


def conversation_counts(scored: DataFrame, least: int = 1) -> DataFrame:
    """Positives, totals, first and last positive place per conversation."""
    place = F.when(F.col("is_pos"), F.col("message_index"))
    return scored.groupBy("annotation_id", *CONVERSATION).agg(
        F.count("*").alias("total"), _n("is_pos").alias("positives"), F.min(place).alias("first_pos"), F.max(place).alias("last_pos")
    ).where(F.col("positives") >= least)


def superset_coverage(in_scope: DataFrame, scored: DataFrame) -> DataFrame:
    """Messages per role, and those scored for all annotations relevant to them."""
    relevant = in_scope.groupBy(*KEY, "role").agg(F.collect_set("annotation_id").alias("want"))
    have = scored.groupBy(*KEY).agg(F.collect_set("annotation_id").alias("have"))
    full = relevant.join(have, list(KEY), "left").withColumn("full", F.size(F.array_except("want", F.coalesce("have", F.array().cast("array<string>")))) == 0)
    return full.groupBy("role").agg(F.count("*").alias("messages"), _n("full").alias("fully_covered"))


def scope_coverage(in_scope: DataFrame, scored: DataFrame) -> DataFrame:
    """Histogram of (annotations in scope, of these scored) over messages."""
    want = in_scope.groupBy(*KEY).agg(F.count("*").alias("in_scope"))
    have = scored.where("in_scope").groupBy(*KEY).agg(F.count("*").alias("non_null"))
    return want.join(have, list(KEY), "left").groupBy("in_scope", F.coalesce("non_null", F.lit(0)).alias("non_null")).agg(F.count("*").alias("messages"))


def match_cutoffs(scored: DataFrame) -> DataFrame:
    """Positives at each cutoff 1 to 10 (K03, A54 sweep): one exploded pass, no cross join."""
    top = F.least(F.lit(10), F.col("score").cast("int"))
    hit = scored.where("score >= 1").select("annotation_id", F.explode(F.sequence(F.lit(1), top)).alias("score_cutoff"))
    return hit.groupBy("annotation_id", "score_cutoff").agg(F.count("*").alias("positives"))
