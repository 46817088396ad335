"""Queries over order: windows, sessions, trajectories and forward dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dynamics, windows
from .base import CONV_SQL, CTE, KEY_SQL, Inputs

QUERIES: dict = {}
SQL: dict = {}
CONV = ["participant", "source_path", "chat_index"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


def _round(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _pos(i: Inputs):
    return i.scored.where("is_pos AND in_scope")


EVENTS = "SELECT event_id, user_id, ts, value FROM events"
query("rolling_index_mean", f"""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling
 FROM ({EVENTS})""")(lambda i: _round(windows.rolling_rows(i.t("events"), ["user_id"], ["ts", "event_id"], "value", 10).select("event_id", "rolling"), "rolling"))
_TIME = f"""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND CURRENT ROW), 6) AS rolling FROM ({EVENTS})"""
query("rolling_time_mean", _TIME)(lambda i: _round(windows.rolling_time(i.t("events"), ["user_id"], "ts", "value", 5 * 86400).select("event_id", "rolling"), "rolling"))
query("rolling_time_no_peers", _TIME)(
    lambda i: _round(windows.rolling_time_no_peers(i.t("events"), ["user_id"], "ts", "event_id", "value", 5 * 86400).select("event_id", "rolling"), "rolling")
)
query("participant_series", CTE + """, s AS (SELECT participant, annotation_id, dense_rank() OVER (PARTITION BY participant ORDER BY source_path, chat_index, message_index) - 1 AS position,
 CASE WHEN is_pos THEN 1.0 ELSE 0.0 END AS hit FROM scored WHERE in_scope)
SELECT participant, annotation_id, position, round(avg(hit) OVER (PARTITION BY participant, annotation_id ORDER BY position ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rolling FROM s""")(
    lambda i: _round(windows.series(i.scored.where("in_scope"), 50).select("participant", "annotation_id", "position", "rolling"), "rolling")
)
query("trajectory_mean_ci", CTE + """, s0 AS (SELECT participant, annotation_id, dense_rank() OVER (PARTITION BY participant ORDER BY source_path, chat_index, message_index) - 1 AS position, CASE WHEN is_pos THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM scored),
s AS (SELECT participant, annotation_id, position, avg(hit) OVER (PARTITION BY participant, annotation_id ORDER BY position ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS y FROM s0),
u AS (SELECT *, CASE WHEN max(position) OVER w > min(position) OVER w THEN (position - min(position) OVER w) / (max(position) OVER w - min(position) OVER w)::DOUBLE ELSE 0.0 END AS u FROM s WINDOW w AS (PARTITION BY participant, annotation_id)),
b AS (SELECT DISTINCT participant, annotation_id, CAST(k AS INT) AS bin, k / 49.0::DOUBLE AS x FROM u, range(50) r(k)),
l AS (SELECT b.*, p.u AS u0, p.y AS y0 FROM b ASOF JOIN u p ON p.participant = b.participant AND p.annotation_id = b.annotation_id AND b.x >= p.u),
r AS (SELECT l.*, p.u AS u1, p.y AS y1 FROM l ASOF LEFT JOIN u p ON p.participant = l.participant AND p.annotation_id = l.annotation_id AND l.x <= p.u),
v AS (SELECT annotation_id, participant, bin, CASE WHEN u1 IS NULL OR u1 = u0 THEN y0 ELSE y0 + (y1 - y0) * (x - u0) / (u1 - u0) END AS value FROM r)
SELECT annotation_id, bin, count(*) AS series, round(avg(value), 6) AS mean, round(avg(value) - coalesce(1.96 * stddev_samp(value) / sqrt(count(*)), 0), 6) AS low,
 round(avg(value) + coalesce(1.96 * stddev_samp(value) / sqrt(count(*)), 0), 6) AS high FROM v GROUP BY annotation_id, bin""")(
    lambda i: _round(windows.mean_curve(windows.grid(windows.series(i.scored, 50), ["annotation_id", "participant"], "position", "rolling", 50), ["annotation_id"]), "mean", "low", "high")
)
query("span_reached", CTE + f""", p AS (SELECT annotation_id, {KEY_SQL} FROM scored WHERE is_pos AND in_scope),
w AS (SELECT *, lead(message_index, 2) OVER (PARTITION BY annotation_id, {CONV_SQL} ORDER BY message_index) - message_index <= 10 AS close FROM p)
SELECT annotation_id, {CONV_SQL}, bool_or(coalesce(close, false)) AS reached FROM w GROUP BY ALL""")(lambda i: windows.span_reached(_pos(i), 3, 10))
_RUNS = CTE + f""", p AS (SELECT annotation_id, {KEY_SQL} FROM scored WHERE is_pos AND in_scope),
s AS (SELECT *, CASE WHEN message_index - lag(message_index) OVER w <= 5 THEN 0 ELSE 1 END AS st FROM p WINDOW w AS (PARTITION BY annotation_id, {CONV_SQL} ORDER BY message_index)),
r AS (SELECT *, sum(st) OVER (PARTITION BY annotation_id, {CONV_SQL} ORDER BY message_index ROWS UNBOUNDED PRECEDING) AS run FROM s),
g AS (SELECT annotation_id, {CONV_SQL}, run, count(*) AS hits, min(message_index) AS first_place FROM r GROUP BY ALL)"""
query("gap_sessions", _RUNS + f" SELECT annotation_id, {CONV_SQL}, CAST(run AS BIGINT) AS run, hits, first_place FROM g")(lambda i: windows.gap_sessions(_pos(i), 5))
query("window_incidence", _RUNS + """, c AS (SELECT annotation_id, participant, count(*) AS n, sum(hits) AS s, sum(hits * hits) AS q FROM g GROUP BY ALL),
t AS (SELECT *, sum(s) OVER w / sum(n) OVER w AS mean FROM c WINDOW w AS (PARTITION BY annotation_id))
SELECT annotation_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, round(any_value(mean), 6) AS mean,
 round(CASE WHEN sum(n) > 1 THEN sqrt(greatest((sum(q) - sum(n) * any_value(mean) * any_value(mean)) / (sum(n) - 1), 0)) END, 6) AS sd,
 round(CASE WHEN sum(n) > 1 THEN sqrt(greatest((sum(q) - sum(n) * any_value(mean) * any_value(mean)) / (sum(n) - 1), 0)) END / sqrt(sum(n)), 6) AS se,
 round(CASE WHEN count(*) > 1 THEN sqrt(sum((s - n * mean) ** 2)) / sum(n) * sqrt(count(*) / (count(*) - 1)) END, 6) AS cluster_se FROM t GROUP BY annotation_id""")(
    lambda i: _round(windows.mean_with_errors(windows.gap_sessions(_pos(i), 5), ["annotation_id"]), "mean", "sd", "se", "cluster_se")
)
query("next_k_pmf", CTE + f""", p AS (SELECT annotation_id, {KEY_SQL} FROM scored WHERE is_pos AND in_scope),
f AS (SELECT annotation_id, count(*) OVER (PARTITION BY annotation_id, {CONV_SQL} ORDER BY message_index RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS following FROM p),
c AS (SELECT annotation_id, following, count(*) AS n FROM f GROUP BY ALL)
SELECT annotation_id, following, n, round(n / sum(n) OVER (PARTITION BY annotation_id), 9) AS p FROM c""")(
    lambda i: _round(windows.pmf(windows.next_k(_pos(i), 5), ["annotation_id"], "following"), "p", digits=9)
)
query("conversation_lengths", CTE + f"SELECT {CONV_SQL}, count(*) AS length FROM msg GROUP BY ALL")(lambda i: windows.lengths(i.messages))
query("remaining_length", CTE + f""", r AS (SELECT {KEY_SQL}, role, row_number() OVER (PARTITION BY {CONV_SQL} ORDER BY message_index) AS place, count(*) OVER (PARTITION BY {CONV_SQL}) AS length FROM msg)
SELECT {KEY_SQL}, role, place, length - place AS "left", round(ln(length - place), 6) AS log_left, round((place - 1) / (length - 1), 6) AS time_share FROM r WHERE length > place""")(
    lambda i: _round(windows.remaining(i.messages), "log_left", "time_share")
)
query("turn_index", CTE + f""", t AS (SELECT {KEY_SQL}, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY {CONV_SQL} ORDER BY message_index ROWS UNBOUNDED PRECEDING) AS n FROM msg)
SELECT {KEY_SQL}, CAST(CASE WHEN n > 0 THEN n - 1 END AS BIGINT) AS turn FROM t""")(lambda i: windows.turn_index(i.messages).select(*CONV, "message_index", "turn"))
query("preceding_range", CTE + f"""SELECT {KEY_SQL}, array_to_string(list_transform(list(message_index) OVER (PARTITION BY {CONV_SQL} ORDER BY message_index RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: CAST(x AS VARCHAR)), ',') AS before FROM msg""")(
    lambda i: windows.preceding_range(i.messages, 3).select(*CONV, "message_index", F.nullif(F.array_join(F.transform("before", lambda x: x.cast("string")), ","), F.lit("")).alias("before"))
)
query("preceding_skipping_roles", CTE + f""", n AS (SELECT {KEY_SQL}, role, row_number() OVER (PARTITION BY {CONV_SQL} ORDER BY message_index) AS rn,
 coalesce(sum(CASE WHEN coalesce(role = 'system', false) THEN 0 ELSE 1 END) OVER (PARTITION BY {CONV_SQL} ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM msg)
SELECT c.participant, c.source_path, c.chat_index, c.message_index, min(p.message_index) AS first_index, count(p.message_index) AS size
FROM n c LEFT JOIN n p ON p.participant = c.participant AND p.source_path = c.source_path AND p.chat_index = c.chat_index AND p.rn < c.rn
 AND (c.kept - p.kept < 2 OR (c.kept - p.kept = 2 AND NOT coalesce(p.role = 'system', false))) GROUP BY ALL""")(
    lambda i: windows.preceding_skipping(i.messages, 2, F.coalesce(F.col("role") == "system", F.lit(False)))
)
query("subset_slice", CTE + f""", a AS (SELECT annotation_id, {CONV_SQL}, min(message_index) AS anchor FROM scored WHERE is_pos AND in_scope GROUP BY ALL)
SELECT annotation_id, {KEY_SQL}, message_index - anchor AS "offset" FROM msg JOIN a USING ({CONV_SQL}) WHERE message_index - anchor BETWEEN -2 AND 3""")(
    lambda i: windows.slice_around(i.messages, windows.first_anchor(_pos(i)), 2, 3).select("annotation_id", *CONV, "message_index", "offset")
)
query("rolling_time_ties", """WITH e AS (SELECT event_id, user_id, date_trunc('day', ts) AS ts, value FROM events)
SELECT a.event_id, round(avg(b.value), 6) AS rolling FROM e a JOIN e b ON b.user_id = a.user_id AND b.ts BETWEEN a.ts - INTERVAL 5 DAYS AND a.ts AND (b.ts < a.ts OR b.event_id <= a.event_id) GROUP BY a.event_id""")(
    lambda i: _round(windows.rolling_time_no_peers(i.t("events").withColumn("ts", F.date_trunc("day", "ts")), ["user_id"], "ts", "event_id", "value", 5 * 86400).select("event_id", "rolling"), "rolling")
)
query("first_conversations", CTE + f""", d AS (SELECT {KEY_SQL}, dense_rank() OVER (PARTITION BY participant ORDER BY source_path, chat_index) AS c FROM msg)
SELECT {KEY_SQL} FROM d WHERE c <= 5""")(lambda i: windows.first_conversations(i.messages, 5).select(*CONV, "message_index"))
query("role_shares", CTE + """, c AS (SELECT participant, role, count(*) AS n FROM msg GROUP BY ALL) SELECT participant, role, n, round(n / sum(n) OVER (PARTITION BY participant), 9) AS share FROM c""")(
    lambda i: _round(windows.shares(i.messages.groupBy("participant", "role").agg(F.count("*").alias("n")), ["participant"], "n"), "share", digits=9)
)
query("prefilter_stops", CTE + f""", r AS (SELECT *, row_number() OVER (PARTITION BY annotation_id, {CONV_SQL} ORDER BY message_index) AS rn FROM scored WHERE in_scope)
SELECT annotation_id, {CONV_SQL}, count(*) AS seen FROM r WHERE rn <= 10 GROUP BY ALL HAVING count(*) = 10 AND NOT bool_or(is_pos)""")(
    lambda i: windows.stopped(i.scored.where("in_scope")).select("annotation_id", *CONV, "seen")
)
query("sequence_points", CTE + f"""SELECT {KEY_SQL}, round(dense_rank() OVER (PARTITION BY participant ORDER BY source_path, chat_index) - 1
 + (row_number() OVER (PARTITION BY {CONV_SQL} ORDER BY message_index) - 1) / count(*) OVER (PARTITION BY {CONV_SQL}), 6) AS x FROM msg""")(
    lambda i: _round(windows.sequence_points(i.messages).select(*CONV, "message_index", "x"), "x")
)

K = 3
_SEQ = CTE + f""", lab AS (SELECT {KEY_SQL}, annotation_id FROM scored WHERE is_pos AND in_scope),
o AS (SELECT {KEY_SQL}, role, row_number() OVER (PARTITION BY {CONV_SQL} ORDER BY message_index) AS rn, count(*) OVER (PARTITION BY {CONV_SQL}) AS len FROM msg),
lo AS (SELECT o.participant, o.source_path, o.chat_index, o.rn, l.annotation_id FROM o JOIN lab l USING ({KEY_SQL})),
src AS (SELECT o.*, l.annotation_id AS x FROM o JOIN lab l USING ({KEY_SQL}) WHERE rn < len),
win AS (SELECT DISTINCT o.participant, o.source_path, o.chat_index, o.rn, t.annotation_id AS y FROM o JOIN lo t ON t.participant = o.participant
 AND t.source_path = o.source_path AND t.chat_index = o.chat_index AND t.rn BETWEEN o.rn + 1 AND o.rn + {K}),
tr AS (SELECT x, count(*) AS trials FROM src GROUP BY x),
ct AS (SELECT s.x, w.y, count(*) AS successes FROM src s JOIN win w USING (participant, source_path, chat_index, rn) GROUP BY ALL),
base AS (SELECT y, count(*) / (SELECT count(*) FROM o WHERE rn < len) AS p_window FROM win GROUP BY y)"""


def _win(i: Inputs, k: int = K):
    return dynamics.windows(dynamics.label_sets(i.messages, i.scored), k)


query("seq_pair_matrix", _SEQ + """ SELECT a.annotation_id AS x, b.annotation_id AS y, coalesce(successes, 0) AS successes, CASE WHEN successes IS NULL THEN 0 ELSE trials END AS trials
 FROM annotations a CROSS JOIN annotations b LEFT JOIN ct ON ct.x = a.annotation_id AND ct.y = b.annotation_id LEFT JOIN tr ON tr.x = a.annotation_id""")(
    lambda i: dynamics.matrix(dynamics.pair_counts(_win(i)), i.t("annotations"))
)
query("seq_pair_posterior", _SEQ + """ SELECT ct.x, ct.y, round((successes + 2 * p_window) / (trials + 2), 6) AS mean, round(ln((successes + 2 * p_window) / (trials + 2) / p_window), 6) AS log_lift,
 round(sqrt((successes + 2 * p_window) * (trials - successes + 2 * (1 - p_window)) / ((trials + 2) ** 2 * (trials + 3))), 6) AS sd FROM ct JOIN tr USING (x) JOIN base USING (y)""")(
    lambda i: (lambda w: _round(dynamics.posterior(dynamics.pair_counts(w).join(dynamics.window_base(w), "y"), F.col("p_window")).select("x", "y", "mean", "log_lift", "sd"), "mean", "log_lift", "sd"))(_win(i))
)
query("seq_top_pairs", _SEQ + """ SELECT ct.x, ct.y, successes, trials, round(successes / trials / p_window, 6) AS enrichment FROM ct JOIN tr USING (x) JOIN base USING (y)
 WHERE trials >= 10 AND successes >= 3 ORDER BY enrichment DESC, successes DESC, trials DESC, x, y LIMIT 200""")(
    lambda i: (lambda w: dynamics.top_pairs(dynamics.pair_counts(w), dynamics.window_base(w), K, 10, 3).select("x", "y", "successes", "trials", "enrichment"))(_win(i))
)
query("seq_same_message", CTE + f""", lab AS (SELECT {KEY_SQL}, annotation_id FROM scored WHERE is_pos AND in_scope)
SELECT a.annotation_id AS x, b.annotation_id AS y, count(*) AS successes FROM lab a JOIN lab b USING ({KEY_SQL}) GROUP BY ALL""")(
    lambda i: dynamics.pair_counts(_win(i, 0)).select("x", "y", "successes")
)
query("seq_absence", _SEQ + f""", ab AS (SELECT s.participant, s.source_path, s.chat_index, o.rn, 'not:' || s.annotation_id AS x FROM scope s JOIN o USING ({KEY_SQL})
 WHERE o.rn < o.len AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.participant = s.participant AND l.source_path = s.source_path AND l.chat_index = s.chat_index AND l.message_index = s.message_index AND l.annotation_id = s.annotation_id)),
atr AS (SELECT x, count(*) AS trials FROM ab GROUP BY x), ac AS (SELECT x, y, count(*) AS successes FROM ab JOIN win USING (participant, source_path, chat_index, rn) GROUP BY ALL)
SELECT x, y, successes, trials FROM ac JOIN atr USING (x)""")(lambda i: dynamics.complement_counts(_win(i), i.in_scope))
query("seq_triples", _SEQ + """, xy AS (SELECT s.x, w.y, s.participant, s.source_path, s.chat_index, s.rn FROM src s JOIN win w USING (participant, source_path, chat_index, rn))
SELECT xy.x, xy.y, z.y AS z, any_value(ct.successes) AS trials_xy, count(*) AS successes FROM xy JOIN win z USING (participant, source_path, chat_index, rn) JOIN ct ON ct.x = xy.x AND ct.y = xy.y GROUP BY ALL""")(
    lambda i: dynamics.triples(_win(i))
)
query("seq_effects", _SEQ + """ SELECT ct.x, ct.y, round(successes / trials - p_window, 6) AS delta, round(successes / trials / p_window, 6) AS risk_ratio,
 round(CASE WHEN p_window > 0 AND p_window < 1 AND successes < trials THEN (successes / trials / (1 - successes / trials)) / (p_window / (1 - p_window)) END, 6) AS odds_ratio,
 round(1 - (1 - p_window) ** 3, 6) AS within_3 FROM ct JOIN tr USING (x) JOIN base USING (y)""")(
    lambda i: (lambda w: _round(dynamics.pair_counts(w).join(dynamics.window_base(w), "y").select(
        "x", "y", *[v.alias(k) for k, v in dynamics.effects(F.col("successes") / F.col("trials"), F.col("p_window")).items()],
        dynamics.baseline_within(F.col("p_window"), 3).alias("within_3")), "delta", "risk_ratio", "odds_ratio", "within_3"))(_win(i))
)
