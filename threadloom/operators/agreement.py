"""Agreement of raters: pairwise counts, kappas, majority, confusion, cutoff choice.

``values`` has item columns, ``annotator`` and a boolean ``label``. Null labels are no answer. Ratios
are null where they are not defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rates import ratio

ITEM = ("dataset_path", "sequence_index", "annotation_id")


def last_labels(labels: DataFrame) -> DataFrame:
    """The latest yes/no label of an annotator on an item."""
    word = F.lower(F.trim("label"))
    yes_no = labels.select(*ITEM, "annotator", "labelled_at", "label_id", word.alias("w")).where("w IN ('yes', 'no')")
    return yes_no.groupBy(*ITEM, "annotator").agg((F.max_by("w", F.struct("labelled_at", "label_id")) == "yes").alias("label"))


def model_labels(items: DataFrame, cutoffs: DataFrame, name: str = "llm") -> DataFrame:
    """Scores of the items as labels of one more annotator."""
    kept = items.where("llm_score IS NOT NULL").join(cutoffs, "annotation_id")
    return kept.groupBy(*ITEM).agg(F.max("llm_score").alias("s"), F.max("cutoff").alias("c")).select(
        *ITEM, F.lit(name).alias("annotator"), (F.bround(F.col("s").cast("double")) >= F.col("c")).alias("label")
    )


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa, null without items or where chance agreement is complete."""
    n = n11 + n10 + n01 + n00
    po = (n11 + n00) / n
    pe = ((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n)
    return F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe))


def pairwise(values: DataFrame) -> DataFrame:
    """2 x 2 counts and kappa of every annotator pair on the items both labelled."""
    a = values.select(*ITEM, F.col("annotator").alias("a"), F.col("label").alias("la"))
    b = values.select(*ITEM, F.col("annotator").alias("b"), F.col("label").alias("lb"))
    j = a.join(b, list(ITEM)).where("a < b").groupBy("a", "b").agg(
        F.count_if(F.expr("la AND lb")).alias("yes_yes"), F.count_if(F.expr("la AND NOT lb")).alias("yes_no"),
        F.count_if(F.expr("NOT la AND lb")).alias("no_yes"), F.count_if(F.expr("NOT la AND NOT lb")).alias("no_no"),
    )
    c = [F.col(x) for x in ("yes_yes", "yes_no", "no_yes", "no_no")]
    return j.withColumns({"agreement": ratio(c[0] + c[3], c[0] + c[1] + c[2] + c[3]), "kappa": kappa(*c)})


def votes(values: DataFrame) -> DataFrame:
    """Raters and yes votes per item."""
    return values.groupBy(*ITEM).agg(F.count("label").alias("raters"), F.count_if(F.col("label")).alias("yes"))


def fleiss(values: DataFrame) -> DataFrame:
    """Fleiss' kappa over the items with the most raters, null if one class only; unanimous items."""
    v = votes(values)
    top = v.agg(F.max("raters").alias("most"))
    kept = v.join(F.broadcast(top), v["raters"] == top["most"])
    n, y = F.col("raters"), F.col("yes")
    agree = (y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1))
    s = kept.agg(F.count("*").alias("items"), F.max("raters").alias("raters"), F.avg(agree).alias("p"), F.avg(y / n).alias("q"), F.count_if((y == 0) | (y == n)).alias("unanimous"))
    pe = F.col("q") * F.col("q") + (1 - F.col("q")) * (1 - F.col("q"))
    return s.select("items", "raters", "unanimous", F.when((pe < 1) & (F.col("raters") > 1), (F.col("p") - pe) / (1 - pe)).alias("kappa"))


def majority(values: DataFrame) -> DataFrame:
    """Majority label; ties are dropped."""
    m = values.groupBy(*ITEM).agg(F.sum(F.when(F.col("label"), 1).otherwise(-1)).alias("lean"))
    return m.where("lean <> 0").select(*ITEM, (F.col("lean") > 0).alias("truth"))


def confusion(values: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("annotator",)) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, F1, false rates and kappa against ``truth``."""
    j = values.join(truth, list(ITEM)).groupBy(*by).agg(
        F.count_if(F.expr("label AND truth")).alias("tp"), F.count_if(F.expr("label AND NOT truth")).alias("fp"),
        F.count_if(F.expr("NOT label AND truth")).alias("fn"), F.count_if(F.expr("NOT label AND NOT truth")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return j.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "fnr": ratio(fn, tp + fn), "fpr": ratio(fp, fp + tn), "kappa": kappa(tp, fp, fn, tn),
    })


def sweep(items: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("annotation_id",)) -> DataFrame:
    """Confusion of the score at each cutoff 1 to 10."""
    scored = items.where("llm_score IS NOT NULL").select(*ITEM, "llm_score", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("cutoff"))
    return confusion(scored.withColumn("label", F.col("llm_score") >= F.col("cutoff")), truth, (*by, "cutoff"))


def best_cutoff(swept: DataFrame, metric: str = "f1", by: str = "annotation_id") -> DataFrame:
    """Cutoff with the best metric, lower median among ties; nearest to 5 where the metric is degenerate."""
    w = Window.partitionBy(by)
    m = F.coalesce(F.col(metric), F.lit(0.0))
    ranked = swept.withColumn("m", m).withColumn("best", F.max("m").over(w)).where("m = best")
    placed = ranked.withColumns({
        "n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy("cutoff")), "near": F.row_number().over(w.orderBy(F.abs(F.col("cutoff") - 5), "cutoff")),
    })
    chosen = placed.where(F.when(F.col("best") > 0, F.col("rn") == F.expr("(n + 1) div 2")).otherwise(F.col("near") == 1))
    return chosen.select(by, "cutoff", F.col("best").alias("score"))


def coverage(values: DataFrame) -> DataFrame:
    """Items by number of raters."""
    return votes(values).groupBy("raters").agg(F.count("*").alias("items"))


def case_class(values: DataFrame) -> DataFrame:
    """single, agree or disagree per item."""
    v = votes(values)
    kind = F.when(F.col("raters") < 2, "single").when((F.col("yes") == 0) | (F.col("yes") == F.col("raters")), "agree").otherwise("disagree")
    return v.select(*ITEM, kind.alias("case"))


def first_hit(sources: list[DataFrame]) -> DataFrame:
    """Labels from several sources, the first that has one wins."""
    out = None
    for n, s in enumerate(sources):
        tagged = s.select(*ITEM, "annotator", "label", F.lit(n).alias("source"))
        out = tagged if out is None else out.unionByName(tagged)
    return out.groupBy(*ITEM, "annotator").agg(F.min_by("label", "source").alias("label"), F.min("source").alias("source"))
