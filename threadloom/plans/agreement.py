"""Queries over raters and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, rates, regression, windows
from .base import CONV_SQL, CTE, KEY_SQL, Inputs

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


def _round(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


I3 = "dataset_path, sequence_index, annotation_id"
LAB = f"""WITH v AS (SELECT {I3}, annotator, w = 'yes' AS label FROM (SELECT *, lower(trim(label)) AS w FROM manual_labels)
 WHERE w IN ('yes', 'no') QUALIFY row_number() OVER (PARTITION BY {I3}, annotator ORDER BY labelled_at DESC, label_id DESC) = 1),
mj AS (SELECT {I3}, sum(CASE WHEN label THEN 1 ELSE -1 END) > 0 AS truth FROM v GROUP BY ALL HAVING sum(CASE WHEN label THEN 1 ELSE -1 END) <> 0),
vt AS (SELECT {I3}, count(*) AS raters, count(*) FILTER (label) AS yes FROM v GROUP BY ALL)"""
_KAPPA = "CASE WHEN n > 0 AND pe < 1 THEN round((po - pe) / (1 - pe), 6) END"


def _values(i: Inputs):
    return agreement.last_labels(i.t("manual_labels"))


query("pairwise_kappa", LAB + f""", j AS (SELECT a.annotator AS a, b.annotator AS b, count(*) FILTER (a.label AND b.label) AS yes_yes, count(*) FILTER (a.label AND NOT b.label) AS yes_no,
 count(*) FILTER (NOT a.label AND b.label) AS no_yes, count(*) FILTER (NOT a.label AND NOT b.label) AS no_no FROM v a JOIN v b USING ({I3}) WHERE a.annotator < b.annotator GROUP BY ALL),
k AS (SELECT *, yes_yes + yes_no + no_yes + no_no AS n, (yes_yes + no_no) / (yes_yes + yes_no + no_yes + no_no) AS po,
 ((yes_yes + yes_no) * (yes_yes + no_yes) + (no_no + no_yes) * (no_no + yes_no)) / (yes_yes + yes_no + no_yes + no_no) ** 2 AS pe FROM j)
SELECT a, b, yes_yes, yes_no, no_yes, no_no, round(po, 6) AS agreement, {_KAPPA} AS kappa FROM k""")(
    lambda i: _round(agreement.pairwise(_values(i)), "agreement", "kappa")
)
query("fleiss_kappa", LAB + """, t AS (SELECT * FROM vt WHERE raters = (SELECT max(raters) FROM vt)),
s AS (SELECT count(*) AS items, max(raters) AS raters, count(*) FILTER (yes = 0 OR yes = raters) AS unanimous,
 avg((yes * (yes - 1) + (raters - yes) * (raters - yes - 1)) / (raters * (raters - 1))) AS p, avg(yes / raters) AS q FROM t)
SELECT items, raters, unanimous, CASE WHEN q * q + (1 - q) * (1 - q) < 1 AND raters > 1 THEN round((p - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 6) END AS kappa FROM s""")(
    lambda i: _round(agreement.fleiss(_values(i)), "kappa")
)
query("majority_labels", LAB + f"SELECT {I3}, truth FROM mj")(lambda i: agreement.majority(_values(i)))
_CONF = """tp, fp, fn, tn, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall,
 round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fn / nullif(tp + fn, 0), 6) AS fnr, round(fp / nullif(fp + tn, 0), 6) AS fpr,
 round(CASE WHEN ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + fn + tn) ** 2 < 1 THEN
 ((tp + tn) / (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + fn + tn) ** 2) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + fn + tn) ** 2) END, 6) AS kappa"""
_C4 = """count(*) FILTER (label AND truth) AS tp, count(*) FILTER (label AND NOT truth) AS fp, count(*) FILTER (NOT label AND truth) AS fn, count(*) FILTER (NOT label AND NOT truth) AS tn"""
_CC = ("accuracy", "precision", "recall", "f1", "fnr", "fpr", "kappa")
query("majority_confusion", LAB + f", c AS (SELECT annotator, {_C4} FROM v JOIN mj USING ({I3}) GROUP BY annotator) SELECT annotator, {_CONF} FROM c")(
    lambda i: _round(agreement.confusion(_values(i), agreement.majority(_values(i))), *_CC)
)
query("model_confusion", LAB + f""", l AS (SELECT {I3}, llm_score >= cutoff AS label FROM manual_items JOIN cutoffs USING (annotation_id) WHERE llm_score IS NOT NULL),
c AS (SELECT 'llm' AS annotator, {_C4} FROM l JOIN mj USING ({I3})) SELECT annotator, {_CONF} FROM c""")(
    lambda i: _round(agreement.confusion(agreement.model_labels(i.t("manual_items"), i.t("cutoffs")), agreement.majority(_values(i))), *_CC)
)
_SWEEP = LAB + f""", l AS (SELECT {I3}, CAST(k AS INT) AS cutoff, llm_score >= k AS label FROM manual_items, range(1, 11) r(k) WHERE llm_score IS NOT NULL),
c AS (SELECT annotation_id, cutoff, {_C4} FROM l JOIN mj USING ({I3}) GROUP BY ALL)"""
query("cutoff_sweep", _SWEEP + f" SELECT annotation_id, cutoff, {_CONF} FROM c")(
    lambda i: _round(agreement.sweep(i.t("manual_items"), agreement.majority(_values(i))), *_CC)
)
query("best_cutoff", _SWEEP + """, f AS (SELECT annotation_id, cutoff, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS m FROM c),
b AS (SELECT *, max(m) OVER (PARTITION BY annotation_id) AS best FROM f), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY annotation_id ORDER BY cutoff) AS rn,
 row_number() OVER (PARTITION BY annotation_id ORDER BY abs(cutoff - 5), cutoff) AS near FROM b WHERE m = best WINDOW w AS (PARTITION BY annotation_id))
SELECT annotation_id, cutoff, round(best, 6) AS score FROM r WHERE CASE WHEN best > 0 THEN rn = (n + 1) // 2 ELSE near = 1 END""")(
    lambda i: _round(agreement.best_cutoff(agreement.sweep(i.t("manual_items"), agreement.majority(_values(i)))), "score")
)
query("label_coverage", LAB + "SELECT raters, count(*) AS items FROM vt GROUP BY raters")(lambda i: agreement.coverage(_values(i)))
query("case_classes", LAB + f"SELECT {I3}, CASE WHEN raters < 2 THEN 'single' WHEN yes = 0 OR yes = raters THEN 'agree' ELSE 'disagree' END AS \"case\" FROM vt")(
    lambda i: agreement.case_class(_values(i))
)
query("labels_first_hit", LAB + f""", x AS (SELECT *, 0 AS source FROM v WHERE dataset_path = 'manual/test.jsonl' UNION ALL SELECT *, 1 FROM v)
SELECT {I3}, annotator, arg_min(label, source) AS label, CAST(min(source) AS INT) AS source FROM x GROUP BY ALL""")(
    lambda i: agreement.first_hit([_values(i).where("dataset_path = 'manual/test.jsonl'"), _values(i)])
)

_LEN = CTE + f""", g AS (SELECT s.annotation_id, s.participant AS c, CASE WHEN s.is_pos THEN 1.0 ELSE 0.0 END AS x, ln(count(*) OVER (PARTITION BY s.annotation_id, {', '.join('s.' + c for c in CONV_SQL.split(', '))})) AS y
 FROM scored s WHERE in_scope)"""


def _length_sample(i: Inputs):
    """Scored in-scope messages with the log of their conversation's number of messages."""
    n = windows.lengths(i.messages)
    return i.scored.where("in_scope").join(n, ["participant", "source_path", "chat_index"]).withColumn("log_length", F.ln("length")).withColumn("hit", F.col("is_pos").cast("double"))


_OLS = CTE + f""", n AS (SELECT {CONV_SQL}, ln(count(*)) AS y FROM msg GROUP BY ALL),
d AS (SELECT annotation_id, participant AS c, CASE WHEN is_pos THEN 1.0::DOUBLE ELSE 0.0 END AS x, y FROM scored JOIN n USING ({CONV_SQL}) WHERE in_scope),
f AS (SELECT annotation_id, count(*) AS n, count(DISTINCT c) AS g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, sum(x * x) - count(*) * avg(x) ** 2 AS sxx FROM d GROUP BY 1),
s AS (SELECT d.annotation_id, d.c, sum((x - mx) * (y - a - b * x)) / any_value(sxx) AS u FROM d JOIN f USING (annotation_id) GROUP BY ALL)
SELECT annotation_id, any_value(n) AS n, any_value(g) AS clusters, round(any_value(a), 6) AS intercept, round(any_value(b), 6) AS slope,
 round(sqrt(any_value(g) / (any_value(g) - 1) * (any_value(n) - 1) / (any_value(n) - 2) * sum(u * u)), 6) AS se,
 round(exp(any_value(b)), 6) AS effect FROM s JOIN f USING (annotation_id) GROUP BY annotation_id"""
query("length_effect_ols", _OLS)(
    lambda i: _round(regression.effect_summary(regression.ols_binary(_length_sample(i), "annotation_id", "log_length", "hit", "participant")).drop("effect_low", "effect_high"), "intercept", "slope", "se", "effect")
)


def _remaining_sample(i: Inputs):
    """In-scope messages, unscored ones as negatives, with remaining length and time share."""
    left = windows.remaining(i.messages)
    hits = i.scored.select("participant", "source_path", "chat_index", "message_index", "annotation_id", "is_pos")
    keys = ["participant", "source_path", "chat_index", "message_index"]
    return i.in_scope.drop("role").join(left, keys).join(hits, [*keys, "annotation_id"], "left").withColumn("hit", F.coalesce("is_pos", F.lit(False)).cast("double"))


query("remaining_length_ols", CTE + f""", r AS (SELECT {KEY_SQL}, row_number() OVER (PARTITION BY {CONV_SQL} ORDER BY message_index) AS place, count(*) OVER (PARTITION BY {CONV_SQL}) AS len FROM msg),
d AS (SELECT s.annotation_id, s.participant AS c, CASE WHEN p.is_pos THEN 1.0::DOUBLE ELSE 0.0 END AS x, (place - 1) / (len - 1) AS t, ln(len - place) AS y
 FROM scope s JOIN r USING ({KEY_SQL}) LEFT JOIN scored p USING ({KEY_SQL}, annotation_id) WHERE len > place),
f AS (SELECT annotation_id, count(*) AS n, count(DISTINCT c) AS g, avg(x) AS mx, avg(t) AS mt, avg(y) AS my, regr_sxx(x, x) AS sxx, regr_sxx(t, t) AS stt, regr_sxy(x, t) AS sxt, regr_sxy(y, x) AS sxy, regr_sxy(y, t) AS sty FROM d GROUP BY 1),
b AS (SELECT *, (stt * sxy - sxt * sty) / (sxx * stt - sxt * sxt) AS bx, (sxx * sty - sxt * sxy) / (sxx * stt - sxt * sxt) AS bt, stt / (sxx * stt - sxt * sxt) AS wx, -sxt / (sxx * stt - sxt * sxt) AS wt FROM f),
u AS (SELECT d.annotation_id, d.c, sum((wx * (x - mx) + wt * (t - mt)) * (y - my - bx * (x - mx) - bt * (t - mt))) AS u FROM d JOIN b USING (annotation_id) GROUP BY ALL)
SELECT annotation_id, any_value(n) AS n, any_value(g) AS clusters, round(any_value(bx), 6) AS slope_x, round(any_value(bt), 6) AS slope_t,
 round(sqrt(any_value(g) / (any_value(g) - 1) * (any_value(n) - 1) / (any_value(n) - 3) * sum(u * u)), 6) AS se_x FROM u JOIN b USING (annotation_id) GROUP BY annotation_id""")(
    lambda i: _round(regression.ols_with_control(_remaining_sample(i), "annotation_id", "log_left", "hit", "time_share", "participant"), "slope_x", "slope_t", "se_x")
)
_P_SQL = _OLS.replace("round(sqrt(any_value(g)", "sqrt(any_value(g)").replace("sum(u * u)), 6) AS se", "sum(u * u)) AS se").replace("round(any_value(b), 6) AS slope", "any_value(b) AS slope")
# Two-sided normal p by Simpson's rule over the density, in 2,000 steps.
query("length_effect_p_values", f"""WITH o AS ({_P_SQL}), z AS (SELECT annotation_id, slope, se, least(abs(slope / se), 40) AS t FROM o WHERE se > 0),
g AS (SELECT annotation_id, sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power(t * k / 2000.0, 2) / 2)) * max(t) / 2000.0 / 3 AS area FROM z, range(2001) r(k) GROUP BY annotation_id)
SELECT annotation_id, round(slope, 6) AS slope, round(se, 6) AS se, round(1 - sqrt(2 / pi()) * area, 6) AS p FROM z JOIN g USING (annotation_id)""")(
    lambda i: _round(regression.p_value(regression.ols_binary(_length_sample(i), "annotation_id", "log_length", "hit", "participant")).where("se > 0").select("annotation_id", "slope", "se", "p"), "slope", "se", "p")
)
query("poisson_glm_fixed")(
    lambda i: regression.poisson_by(
        rates.conversation_counts(i.scored, 0).join(windows.lengths(i.messages), ["participant", "source_path", "chat_index"]),
        "annotation_id", "length", ["positives", "first_pos", "last_pos"],
    )
)
