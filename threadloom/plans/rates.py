"""Queries over scores: frequencies, sets, profiles, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model, rates
from .base import CTE, KEY_SQL, Inputs

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a builder ``fn(inputs)`` under ``name`` with its oracle statement."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


query("annotation_frequencies", CTE + """, p AS (SELECT annotation_id, participant, count(*) AS n, count(*) FILTER (is_pos) AS pos,
 count(*) FILTER (role = 'user') AS nu, count(*) FILTER (is_pos AND role = 'user') AS pu,
 count(*) FILTER (role = 'assistant') AS na, count(*) FILTER (is_pos AND role = 'assistant') AS pa FROM scored WHERE in_scope GROUP BY ALL)
SELECT annotation_id, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos) / nullif(sum(n), 0), 9) AS rate_all,
 round(sum(pu) / nullif(sum(nu), 0), 9) AS rate_user, round(sum(pa) / nullif(sum(na), 0), 9) AS rate_assistant, count(*) AS participants,
 round(avg(pos / n), 9) AS participant_mean, round(stddev_pop(pos / n), 9) AS participant_sd, round(count(*) FILTER (pos >= 3) / count(*), 9) AS share_with_k
FROM p GROUP BY annotation_id""")(lambda i: _rounded(rates.frequencies(i.scored)))


def _rounded(df, digits: int = 9):
    """Doubles rounded for the comparison only: sums run in another order in each engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SET_SQL = """SELECT CAST(sum(n) AS BIGINT) AS messages, CAST(sum(pos) AS BIGINT) AS positives, round((sum(pos) + 1) / (sum(n) + 2), 9) AS beta_mean,
 round(greatest(0.0, (sum(pos) + 1) / (sum(n) + 2) - 1.96 * sqrt((sum(pos) + 1) * (sum(n) - sum(pos) + 1) / ((sum(n) + 2) ** 2 * (sum(n) + 3)))), 9) AS beta_low,
 round(least(1.0, (sum(pos) + 1) / (sum(n) + 2) + 1.96 * sqrt((sum(pos) + 1) * (sum(n) - sum(pos) + 1) / ((sum(n) + 2) ** 2 * (sum(n) + 3)))), 9) AS beta_high,
 count(*) AS participants, round(avg(pos / n), 9) AS mean_rate,
 round(greatest(0.0, avg(pos / n) - coalesce(1.96 * stddev_samp(pos / n) / sqrt(count(*)), 0)), 9) AS mean_low,
 round(least(1.0, avg(pos / n) + coalesce(1.96 * stddev_samp(pos / n) / sqrt(count(*)), 0)), 9) AS mean_high
FROM (SELECT participant, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (hit) AS DOUBLE) AS pos FROM h GROUP BY participant)"""
query("any_harmful_frequency", CTE + f", h AS (SELECT {KEY_SQL}, bool_or(is_pos) AS hit FROM scored WHERE in_scope AND is_harmful GROUP BY ALL) " + _SET_SQL)(
    lambda i: _rounded(rates.set_summary(rates.any_positive(i.scored, F.col("is_harmful"))))
)
query("annotation_set_frequency", CTE + f", h AS (SELECT {KEY_SQL}, bool_or(is_pos) AS hit FROM scored WHERE in_scope AND category = 'sycophancy' GROUP BY ALL) " + _SET_SQL)(
    lambda i: _rounded(rates.set_summary(rates.any_positive(i.scored, F.col("category") == "sycophancy")))
)
query("positive_counts", CTE + """SELECT annotation_id, count(*) FILTER (is_pos) AS positives, count(*) AS total,
 count(*) FILTER (is_pos) / count(*) AS fraction FROM scored GROUP BY annotation_id""")(lambda i: rates.positive_counts(i.scored))
query("summary_with_total", CTE + f"""SELECT coalesce(annotation_id, 'ALL') AS annotation_id, count(*) AS rows, count(DISTINCT ({KEY_SQL})) AS messages,
 count(*) FILTER (score > 0) AS above_zero, count(*) FILTER (score > 0) / count(*) AS above_zero_rate, count(*) FILTER (is_pos) / count(*) AS positive_rate
 FROM scored GROUP BY GROUPING SETS ((annotation_id), ())""")(lambda i: rates.with_total(i.scored))
query("positive_rules", CTE + """SELECT annotation_id, count(*) FILTER (trunc(score) >= cutoff) AS truncated, count(*) FILTER (score >= cutoff) AS plain,
 count(*) FILTER (round_even(score, 0) >= cutoff) AS half_even, count(*) FILTER (floor(score + 0.5) >= cutoff) AS half_up, count(*) FILTER (score > 0) AS above_zero
 FROM scored GROUP BY annotation_id""")(
    lambda i: i.scored.groupBy("annotation_id").agg(
        F.count_if(model.positive_trunc(F.col("score"), F.col("cutoff"))).alias("truncated"), F.count_if(model.positive_float(F.col("score"), F.col("cutoff"))).alias("plain"),
        F.count_if(model.positive_half_even(F.col("score"), F.col("cutoff"))).alias("half_even"), F.count_if(model.positive_half_up(F.col("score"), F.col("cutoff"))).alias("half_up"),
        F.count_if(model.positive_any(F.col("score"))).alias("above_zero"),
    )
)
_RATES = """, d AS (SELECT participant, annotation_id, count(*) AS in_scope FROM scope GROUP BY ALL),
h AS (SELECT participant, annotation_id, count(*) FILTER (is_pos) AS positives FROM scored WHERE in_scope GROUP BY ALL),
r AS (SELECT d.participant, d.annotation_id, d.in_scope, coalesce(h.positives, 0) AS positives, coalesce(h.positives, 0) / d.in_scope AS rate
 FROM d LEFT JOIN h USING (participant, annotation_id))"""
query("participant_profiles", CTE + _RATES + " SELECT * FROM r")(lambda i: rates.participant_rates(i.in_scope, i.scored))
query("profile_coverage", CTE + _RATES + """, a AS (SELECT *, count(rate) OVER (PARTITION BY participant) AS c FROM r),
b AS (SELECT * EXCLUDE (c), count(rate) OVER (PARTITION BY annotation_id) AS c FROM a WHERE c >= 20) SELECT * EXCLUDE (c) FROM b WHERE c >= 5""")(
    lambda i: rates.covered(rates.participant_rates(i.in_scope, i.scored), 20, 5)
)
query("profile_z_scores", CTE + _RATES + """ SELECT participant, annotation_id, CASE WHEN stddev_pop(rate) OVER w > 0 THEN
 round((rate - avg(rate) OVER w) / stddev_pop(rate) OVER w, 6) ELSE 0.0 END AS z FROM r WINDOW w AS (PARTITION BY annotation_id)""")(
    lambda i: _rounded(rates.z_scores(rates.participant_rates(i.in_scope, i.scored)).select("participant", "annotation_id", "z"), 6)
)
query("onset_statistics", CTE + f""", f AS (SELECT s.*, p.is_pos FROM scope s LEFT JOIN scored p USING ({KEY_SQL}, annotation_id)),
o AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN is_pos THEN 1 ELSE 0 END) OVER w AS seen FROM f
 WINDOW w AS (PARTITION BY participant, annotation_id ORDER BY source_path, chat_index, message_index ROWS UNBOUNDED PRECEDING)),
k AS (SELECT participant, annotation_id, place FROM o WHERE is_pos AND seen = 2), b AS (SELECT DISTINCT participant, annotation_id FROM scope)
SELECT annotation_id, count(*) AS participants, count(place) AS reached, round(avg(place), 6) AS mean_onset, round(stddev_pop(place) / sqrt(count(place)), 6) AS se_onset,
 count(place) / count(*) AS share FROM b LEFT JOIN k USING (participant, annotation_id) GROUP BY annotation_id""")(
    lambda i: rates.onset(i.scored, i.in_scope).withColumns({c: F.round(c, 6) for c in ("mean_onset", "se_onset")})
)
query("base_rates", CTE + """SELECT s.annotation_id, count(*) AS in_scope, count(*) FILTER (p.is_pos) AS positives, count(*) FILTER (p.is_pos) / count(*) AS base_rate
 FROM scope s LEFT JOIN scored p USING (participant, source_path, chat_index, message_index, annotation_id) GROUP BY s.annotation_id""")(
    lambda i: rates.base_rates(i.in_scope, i.scored)
)
query("conversation_counts", CTE + """SELECT annotation_id, participant, source_path, chat_index, count(*) AS total, count(*) FILTER (is_pos) AS positives,
 min(message_index) FILTER (is_pos) AS first_pos, max(message_index) FILTER (is_pos) AS last_pos FROM scored GROUP BY ALL HAVING count(*) FILTER (is_pos) >= 2""")(
    lambda i: rates.conversation_counts(i.scored, 2)
)
query("superset_coverage", CTE + f""", w AS (SELECT {KEY_SQL}, role, count(*) AS want FROM scope GROUP BY ALL),
h AS (SELECT {KEY_SQL}, count(*) AS have FROM scope s SEMI JOIN long USING ({KEY_SQL}, annotation_id) GROUP BY ALL)
SELECT role, count(*) AS messages, count(*) FILTER (want = coalesce(have, 0)) AS fully_covered FROM w LEFT JOIN h USING ({KEY_SQL}) GROUP BY role""")(
    lambda i: rates.superset_coverage(i.in_scope, i.scored)
)
query("scope_coverage_histogram", CTE + f""", w AS (SELECT {KEY_SQL}, count(*) AS in_scope FROM scope GROUP BY ALL), h AS (SELECT {KEY_SQL}, count(*) AS non_null FROM scored WHERE in_scope GROUP BY ALL)
SELECT w.in_scope, coalesce(h.non_null, 0) AS non_null, count(*) AS messages FROM w LEFT JOIN h USING ({KEY_SQL}) GROUP BY ALL""")(
    lambda i: rates.scope_coverage(i.in_scope, i.scored)
)
query("missing_pairs", CTE + f"SELECT {KEY_SQL}, annotation_id FROM scope ANTI JOIN long USING ({KEY_SQL}, annotation_id)")(
    lambda i: model.missing_pairs(i.wide, i.t("annotations"))
)
query("match_cutoff_expansion", CTE + """SELECT annotation_id, CAST(k AS INT) AS score_cutoff, count(*) AS positives
 FROM scored, range(1, 11) r(k) WHERE trunc(score) >= k GROUP BY ALL""")(lambda i: rates.match_cutoffs(i.scored))
query("unpivot_scores", CTE + f"SELECT {KEY_SQL}, role, annotation_id, score FROM long")(lambda i: model.long_scores(i.wide))
query("wide_pivot_all", CTE + f"""SELECT {KEY_SQL}, max(COLUMNS('score__(.*)')) AS '\\1' FROM msg WHERE ({KEY_SQL}) IN (SELECT ({KEY_SQL}) FROM long) GROUP BY {KEY_SQL}""")(
    lambda i: model.pivoted(model.long_scores(i.wide), [c.removeprefix(model.PREFIX) for c in i.wide.columns if c.startswith(model.PREFIX)])
)
query("role_split_columns", CTE + f"""SELECT {KEY_SQL}, CASE WHEN role = 'user' THEN "score__both-plays-scene" END AS u,
 CASE WHEN role = 'assistant' THEN "score__both-plays-scene" END AS a FROM msg""")(
    lambda i: model.role_split(i.wide.distinct(), ["both-plays-scene"]).select(
        *model.KEY, F.col("`score__user-both-plays-scene`").alias("u"), F.col("`score__assistant-both-plays-scene`").alias("a")
    )
)
query("role_split_metadata", """SELECT annotation_id, category, array_to_string(scope, ',') AS scope, is_harmful FROM annotations WHERE annotation_id <> 'both-plays-scene'
UNION ALL SELECT r || '-both-plays-scene', category, r, is_harmful FROM (SELECT *, unnest(scope) AS r FROM annotations WHERE annotation_id = 'both-plays-scene')""")(
    lambda i: model.role_split_metadata(i.t("annotations"), ["both-plays-scene"]).withColumn("scope", F.concat_ws(",", "scope"))
)
query("cutoff_role_expansion", """SELECT annotation_id, cutoff FROM cutoffs UNION ALL SELECT r || '-' || annotation_id, cutoff FROM cutoffs, (VALUES ('user'), ('assistant')) v(r)
WHERE r || '-' || annotation_id NOT IN (SELECT annotation_id FROM cutoffs)""")(lambda i: model.cutoff_roles(i.t("cutoffs")))
query("analysis_metadata", "SELECT annotation_id FROM annotations WHERE lower(category) NOT IN ('test', 'task') AND annotation_id <> 'user-plans-outing'")(
    lambda i: model.analysis_metadata(i.t("annotations"), ("test", "task"), ("user-plans-outing",)).select("annotation_id")
)
