"""Consensus of disagreeing annotators (problem 5).

Latent ability and difficulty: annotator j says yes to item i with probability
sigmoid(leaning_j + ability_j * ease_i) if the right answer is yes, sigmoid(leaning_j - ability_j *
ease_i) if it is no; that is, each annotator has two error rates. Negative abilities are allowed: an
annotator who answers the other way round informs as much as a good one; the leaning keeps one who
nearly always gives the same answer from counting as able merely because that answer is the commoner.

Expectation-maximisation: the E-step gives each item the joint posterior of its label and of its ease,
which is one of ``EASE``; a point estimate of the ease would drift, as few answers stand against one
parameter per item. The M-step is one over-relaxed Newton step on the expected log-posterior of ability
(prior mean 1) and leaning (prior mean 0), and the share of yes of each ``GROUP``, drawn to the overall
share by ``PRIOR_ITEMS`` items. Rounds end when no parameter moves by ``tolerance``; a fit that has not
come to rest after ``rounds`` rounds is an error, never a result. A last E-step uses the final parameters.

The answers are partitioned by item once and kept so; a round then shuffles only sums per annotator and
group, partially aggregated, so an annotator who gave a third of all answers is no bottleneck. An item's
answers are at most one per annotator. Parameters live in a written table, joined by what it holds; only
two figures per round reach the driver.

Defined results: of an annotator's answers to an item the latest holds (ties: the larger label id);
null labels are no answer; answers other than yes and no leave the item unanswered by that annotator;
answers to items that do not exist and keys with a null are ignored; an item without answers has no
consensus and is not yes. Repeated item rows count once. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import staged

ITEM = ("dataset_path", "sequence_index", "participant", "annotation_id")
#: Items of one group share a share of yes.
GROUP = "annotation_id"
PRIOR_ITEMS = 10
#: Levels of ease (three points of a log-normal) and their shares.
EASE, EASE_SHARE = (0.5, 1.0, 2.0), (0.15, 0.7, 0.15)
# Spellings of the two answers.
YES = ("yes", "y", "true", "1", "ja", "si", "sí", "oui")
NO = ("no", "n", "false", "0", "nein", "non")


def answers(labels: DataFrame, items: DataFrame) -> DataFrame:
    """(item key, annotator, y): the answer that holds, 1 or 0, of each annotator on each known item."""
    word = F.lower(F.trim("label"))
    latest = (
        labels.where("label is not null and annotator is not null")
        .groupBy(*ITEM, "annotator")
        .agg(F.max_by("label", F.struct("labelled_at", "label_id")).alias("label"))
        .select(*ITEM, "annotator", F.when(word.isin(*YES), 1).when(word.isin(*NO), 0).alias("y"))
        .where("y is not null")
    )
    return latest.join(items.select(*ITEM).distinct(), list(ITEM), "left_semi")


_CELLS = range(2 * len(EASE))
_YES, _NO = tuple(_CELLS[: len(EASE)]), tuple(_CELLS[len(EASE) :])


def _sum(terms: Iterable[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _chances(joined: DataFrame) -> DataFrame:
    """With f0 ..., P(the answer yes) at each ease if the right answer is yes and then if it is no."""
    pull = [(k, "+", e) for k, e in zip(_YES, EASE)] + [(k, "-", e) for k, e in zip(_NO, EASE)]
    return joined.selectExpr("*", *[f"greatest(1e-9D, least(1 - 1e-9D, 1 / (1 + exp(-(leaning {sign} ability * {e}D))))) AS f{k}" for k, sign, e in pull])


def _posterior(slim: DataFrame, raters: DataFrame, priors: DataFrame) -> DataFrame:
    """(item, q0 ...): one row per item, the posterior of (yes, ease 0), ..., (no, ease 0), ..."""
    said = [F.expr(f"sum(ln(if(y = 1, f{k}, 1 - f{k}))) AS l{k}") for k in _CELLS]
    sums = _chances(slim.join(raters, "annotator")).groupBy("item", GROUP).agg(*said).join(priors, GROUP)
    # One projection per step: nested in one they would repeat each other.
    share = [f"ln({w}D) + ln(prior)" for w in EASE_SHARE] + [f"ln({w}D) + ln(1 - prior)" for w in EASE_SHARE]
    logs = sums.selectExpr("item", *[f"l{k} + {share[k]} AS g{k}" for k in _CELLS])
    parts = logs.selectExpr("*", f"greatest({', '.join(f'g{k}' for k in _CELLS)}) AS top").selectExpr("item", *[f"exp(g{k} - top) AS e{k}" for k in _CELLS])
    return parts.selectExpr("*", f"{_sum(f'e{k}' for k in _CELLS)} AS total").selectExpr("item", *[f"e{k} / total AS q{k}" for k in _CELLS])


def _moved(slim: DataFrame, cells: DataFrame, raters: DataFrame, step: float, overall: float) -> DataFrame:
    """One row per annotator (ability, leaning, change) and one per group (prior, said, items)."""
    three = list(zip(_YES, _NO, EASE))
    gained = (
        _chances(slim.join(cells, "item").join(raters, "annotator"))
        .selectExpr("*", *[f"q{k} * (y - f{k}) AS r{k}" for k in _CELLS], *[f"q{k} * f{k} * (1 - f{k}) AS v{k}" for k in _CELLS])
        .selectExpr(
            "annotator", GROUP, "ability", "leaning", f"{_sum(f'q{k}' for k in _YES)} * weight AS p", "weight",
            f"{_sum(f'(r{a} - r{b}) * {e}D' for a, b, e in three)} AS ga", f"{_sum(f'r{k}' for k in _CELLS)} AS gl",
            f"{_sum(f'(v{a} + v{b}) * {e * e}D' for a, b, e in three)} AS haa", f"{_sum(f'v{k}' for k in _CELLS)} AS hll",
            f"{_sum(f'(v{a} - v{b}) * {e}D' for a, b, e in three)} AS hal",
        )
        .groupingSets([["annotator"], [GROUP]], "annotator", GROUP)
        .agg(*[F.expr(f"first({c}) AS {c}") for c in ("ability", "leaning")], *[F.expr(f"sum({c}) AS {c}") for c in ("p", "weight", "ga", "gl", "haa", "hll", "hal")])
    )
    # The priors of ability and leaning add to gradient and curvature.
    pulled = gained.selectExpr(
        "annotator", GROUP, "ability", "leaning", "p", "weight", "ga - (ability - 1) AS ga", "gl - leaning / 4 AS gl", "haa + 1 AS haa", "hll + 0.25D AS hll", "hal"
    )
    moves = pulled.selectExpr(
        "*", "greatest(-1D, least(1D, (hll * ga - hal * gl) / (haa * hll - hal * hal))) AS da", "greatest(-1D, least(1D, (haa * gl - hal * ga) / (haa * hll - hal * hal))) AS dl"
    )
    of_rater = lambda x: f"if(annotator IS NOT NULL, {x}, NULL)"
    of_group = lambda x: f"if(annotator IS NULL, {x}, NULL)"
    return moves.selectExpr(
        "annotator", GROUP, f"{of_rater(f'ability + {step!r}D * da')} AS ability", f"{of_rater(f'leaning + {step!r}D * dl')} AS leaning",
        f"{of_rater('greatest(abs(da), abs(dl))')} AS change",
        f"{of_group(f'(p + {PRIOR_ITEMS} * {overall!r}D) / (weight + {PRIOR_ITEMS})')} AS prior", f"{of_group('p')} AS said", f"{of_group('weight')} AS items",
    )


def fit(answered: DataFrame, rounds: int = 200, tolerance: float = 2e-2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, items, annotators): items with p (of yes) and ease, annotators with ability and leaning."""
    item = F.struct(F.xxhash64(*ITEM).alias("a"), F.xxhash64(F.lit(1), *ITEM).alias("b"))
    given = staged(answered.withColumn("item", item), "answers")
    sizes = given.groupBy("item").agg(F.count("*").alias("n"), F.sum("y").alias("yes"))
    slim = given.select("item", GROUP, "annotator", "y").repartition("item")
    slim = slim.join(sizes, "item").withColumn("weight", 1 / F.col("n")).persist()
    try:
        raters = given.select("annotator").distinct().withColumns({"ability": F.lit(1.5), "leaning": F.lit(0.0)})
        # Start: an item's label is what the share of its answers says, whatever its ease.
        mean = (F.col("yes") + 0.5) / (F.col("n") + 1)
        split = [(mean if k < len(EASE) else 1 - mean) * w for k, w in enumerate(EASE_SHARE * 2)]
        cells = slim.groupBy("item").agg(F.max("yes").alias("yes"), F.max("n").alias("n")).select("item", *[c.alias(f"q{k}") for k, c in enumerate(split)])
        priors, overall, step, before = None, 0.5, 1.0, math.inf
        for turn in range(rounds):
            if turn:
                cells = _posterior(slim, raters, priors)
            state = staged(_moved(slim, cells, raters, step, overall), "raters")
            raters = state.where("annotator is not null").select("annotator", "ability", "leaning")
            priors = state.where("annotator is null").select(GROUP, "prior")
            change, overall = state.agg(F.max("change"), F.sum("said") / F.sum("items")).first()
            if change is None or change < tolerance:
                break
            # Over-relaxed once the labels have formed, and less so where a step overshot.
            step = 1.7 if turn == 2 else max(0.5, 0.7 * step) if change > before else step
            before = change
        else:
            raise RuntimeError(f"annotators' parameters still move by {change:.3g} after {rounds} rounds")
        if priors is None or change is None:
            priors = given.select(GROUP).distinct().withColumn("prior", F.lit(0.5))
        last = _posterior(slim, raters, priors)
        ease = _sum(f"(q{a} + q{b}) * {e}D" for a, b, e in zip(_YES, _NO, EASE))
        return given, staged(last.selectExpr("item", f"{_sum(f'q{k}' for k in _YES)} AS p", f"{ease} AS ease"), "items"), raters
    finally:
        slim.unpersist()


def agreement(given: DataFrame, by: list[str]) -> DataFrame:
    """(by, answers, agreement, kappa) of answers y: the share of annotator pairs that agree, null for a single answer,
    and the same against what chance gives at the overall share of yes."""
    tally = given.groupBy(*by).agg(F.count("*").alias("answers"), F.sum("y").alias("yes"))
    n, y, share = F.col("answers"), F.col("yes"), F.col("share")
    pairs = F.when(n > 1, (y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1)))
    chance = share * share + (1 - share) * (1 - share)
    overall = given.agg(F.avg("y").alias("share"))
    return tally.crossJoin(F.broadcast(overall)).select(*by, "answers", pairs.alias("agreement"), F.when(chance < 1, (pairs - chance) / (1 - chance)).alias("kappa"))


def consensus(labels: DataFrame, items: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """(per item, per annotator).

    Per item: key, consensus (yes/no, null without answers), p_yes, ease, answers, agreement (share of
    annotator pairs that agree) and kappa (agreement against what chance gives at the overall shares).
    Per annotator: ability, leaning, answers, accuracy against the consensus and Cohen's kappa with it.
    """
    given, fitted, raters = fit(answers(labels, items), **settings)
    known = items.select(*ITEM).distinct().withColumn("item", F.struct(F.xxhash64(*ITEM).alias("a"), F.xxhash64(F.lit(1), *ITEM).alias("b")))
    per_item = (
        known.join(fitted, "item", "left").join(agreement(given, ["item"]), "item", "left")
        .select(
            *ITEM,
            F.when(F.col("p") > 0.5, "yes").when(F.col("p").isNotNull(), "no").alias("consensus"),
            F.col("p").alias("p_yes"), "ease", F.coalesce("answers", F.lit(0)).alias("answers"), "agreement", "kappa",
        )
    )
    judged = given.join(fitted.select("item", (F.col("p") > 0.5).cast("int").alias("z")), "item")
    po = F.avg((F.col("y") == F.col("z")).cast("double"))
    pe = F.avg("y") * F.avg("z") + (1 - F.avg("y")) * (1 - F.avg("z"))
    per_rater = judged.groupBy("annotator").agg(
        F.count("*").alias("answers"), po.alias("accuracy"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa")
    )
    return per_item, raters.join(per_rater, "annotator").select("annotator", "ability", "leaning", "answers", "accuracy", "kappa")
