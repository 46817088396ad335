"""Queries over label records, built from the score columns and contents; the oracle builds the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import dynamics, model, rates, records, regression, relations, small, windows
from .base import CONV_SQL, CTE, KEY_SQL, Inputs
from .scalars import _SQUASH, _TOKENS

QUERIES: dict = {}
SQL: dict = {}
KEYS = list(model.KEY)
CONV = KEYS[:3]
c = F.col


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


#: Records of every scored cell: quotes from the message, errors about quotes (one of two may be found) and fatal ones.
REC = CTE + f""", t AS (SELECT {KEY_SQL}, replace(coalesce(arg_min_null(content, row_id), ''), '"', '') AS content FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL),
r0 AS (SELECT {KEY_SQL}, role, annotation_id, score, coalesce(content, '') AS content FROM long LEFT JOIN t USING ({KEY_SQL})),
rec AS (SELECT {KEY_SQL}, role, annotation_id, content,
 CASE WHEN (message_index + chat_index) % 13 <> 5 THEN score END AS score,
 CASE WHEN score >= 4 THEN [substr(content, 3, 20)] ELSE [] END AS matches,
 CASE WHEN (message_index + chat_index) % 13 = 5 THEN 'timeout after ' || (message_index % 3) || ' s'
  WHEN message_index % 7 = 3 THEN 'slow | Quoted text not found in transcript: "' || substr(content, 2, 9) || '", "zzz zzz"'
  WHEN message_index % 7 = 4 THEN 'Quoted text not found in transcript: "zzz zzz"' END AS error FROM r0)"""


def _content(i: Inputs):
    m = i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL")
    return m.groupBy(*KEYS).agg(F.min_by("content", "row_id").alias("content")).withColumn("content", F.replace(F.coalesce("content", F.lit("")), F.lit('"'), F.lit("")))


def _records(i: Inputs):
    rows = model.long_scores(i.wide).join(_content(i), KEYS, "left").withColumn("content", F.coalesce("content", F.lit("")))
    late = (c("message_index") + c("chat_index")) % 13 == 5
    lost = fx.QUOTE_ERROR + ': "'
    return rows.select(
        *KEYS, "role", "annotation_id", "content", F.when(~late, c("score")).alias("score"),
        F.when(c("score") >= 4, F.array(F.substring("content", 3, 20))).otherwise(F.array().cast("array<string>")).alias("matches"),
        F.when(late, F.concat(F.lit("timeout after "), (c("message_index") % 3).cast("string"), F.lit(" s")))
        .when(c("message_index") % 7 == 3, F.concat(F.lit("slow | " + lost), F.substring("content", 2, 9), F.lit('", "zzz zzz"')))
        .when(c("message_index") % 7 == 4, F.lit(lost + 'zzz zzz"')).alias("error"),
    )


_STATS = """count(*) AS rows, count(error) AS errors, count(*) FILTER (NOT starts_with(error, 'Quoted text not')) AS fatal, count(*) FILTER (starts_with(error, 'Quoted text not')) AS quote_errors,
 count(*) FILTER (trunc(score) > 0) AS positives, count(*) FILTER (trunc(score) > 0 AND error IS NOT NULL) AS positives_with_error,
 count(*) FILTER (trunc(score) > 0 AND starts_with(error, 'Quoted text not')) AS positives_with_quote_error, count(*) FILTER (trunc(score) > 0 AND len(matches) > 0) AS positives_with_matches,
 count(*) FILTER (score IS NULL AND error IS NULL) AS unscored_without_error, count(DISTINCT (participant, source_path, chat_index, message_index)) AS messages FROM rec"""
query("label_family_stats", REC + " SELECT " + _STATS)(lambda i: records.family_stats(_records(i)))
query("label_stats_by_annotation", REC + " SELECT annotation_id, " + _STATS + " GROUP BY annotation_id")(lambda i: records.family_stats(_records(i), ["annotation_id"]))
query("fatal_error_histogram", REC + " SELECT error, count(*) AS n FROM rec WHERE NOT starts_with(error, 'Quoted text not') GROUP BY error")(lambda i: records.fatal_errors(_records(i)))
_HIT = f"""(contains(replace(lower(content), 'ß', 'ss'), replace(lower(trim(q)), 'ß', 'ss')) OR contains({_SQUASH.format('content')}, {_SQUASH.format('q')})
 OR ({_TOKENS.format('q')} <> '' AND contains(' ' || {_TOKENS.format('content')} || ' ', ' ' || {_TOKENS.format('q')} || ' ')))"""
query("rechecked_quotes", REC + f""", x AS (SELECT *, substr(content, 2, 9) AS q FROM rec WHERE message_index % 7 = 3 AND (message_index + chat_index) % 13 <> 5 AND content <> '')
SELECT {KEY_SQL}, annotation_id, array_to_string(CASE WHEN list_contains(matches, q) THEN matches ELSE list_append(matches, q) END, '|') AS matches,
 'slow | Quoted text not found in transcript: "zzz zzz"' AS error FROM x WHERE trim(q) <> '' AND {_HIT}""")(
    lambda i: records.rechecked(_records(i), _content(i)).select(*KEYS, "annotation_id", F.array_join("matches", "|").alias("matches"), "error")
)
_STATE = f""", st AS (SELECT {KEY_SQL}, rec.role, annotation_id, coalesce(trunc(score) >= cutoff, false) AS is_pos FROM rec JOIN annotations USING (annotation_id) JOIN cutoffs USING (annotation_id)
 WHERE (error IS NULL OR starts_with(error, 'Quoted text not')) AND rec.role IS NOT NULL AND participant IS NOT NULL AND lower(participant) <> 'hl_101')"""
_state = lambda i: records.family_state(_records(i), i.t("annotations"), i.t("cutoffs"), ("HL_101",))
query("family_state", REC + _STATE + f" SELECT {KEY_SQL}, role, annotation_id, is_pos FROM st")(_state)
query("analysis_callback", REC + _STATE + " SELECT annotation_id, role, count(*) AS n, count(*) FILTER (is_pos) AS positives FROM st GROUP BY ALL HAVING count(*) >= 20")(
    lambda i: records.run_analysis(lambda s, least: s.groupBy("annotation_id", "role").agg(F.count("*").alias("n"), F.count_if("is_pos").alias("positives")).where(c("n") >= least), _state(i), least=20)
)


def _client(tasks):
    """Stands for a model: quotes one stretch that stands in the content and one that does not."""
    quotes = F.to_json(F.array(F.substring("content", 1, 12), F.when(c("message_index") % 3 == 0, "zzz zzz").otherwise(" ")))
    return tasks.withColumn("answer", F.concat(F.lit("<think>so</think>{\"quotes\": "), quotes, F.lit(', "score": '), (c("message_index") % 12).cast("string"), F.lit("}")))


query("classified_tasks", f"""WITH t AS (SELECT {KEY_SQL}, arg_min_null(content, row_id) AS content FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL)
SELECT {KEY_SQL}, CAST(least(10, message_index % 12) AS INT) AS score, trim(substr(content, 1, 12)) AS matches,
 CASE WHEN message_index % 3 = 0 THEN 'Quoted text not found in transcript: "zzz zzz"' END AS error, least(10, message_index % 12) >= 5 AS is_pos FROM t WHERE regexp_full_match(content, '[A-Za-z0-9 ,.;:!?]+') AND trim(content) <> ''""")(
    lambda i: records.classified(
        i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEYS).agg(F.min_by("content", "row_id").alias("content"))
        .where(c("content").rlike(r"^[A-Za-z0-9 ,.;:!?]+\z") & (F.trim("content") != "")), _client, 5
    ).select(*KEYS, "score", F.array_join("matches", "|").alias("matches"), "error", "is_pos")
)
query("applicable_annotations", CTE + f""", q AS (SELECT annotation_id FROM scored GROUP BY 1 HAVING count(*) FILTER (is_pos) >= 300)
SELECT {KEY_SQL}, annotation_id FROM scope ANTI JOIN long USING ({KEY_SQL}, annotation_id) WHERE annotation_id NOT IN (SELECT annotation_id FROM q)""")(
    lambda i: records.applicable(i.messages, i.t("annotations"), model.long_scores(i.wide), i.scored.groupBy("annotation_id").agg(F.count_if("is_pos").alias("positives")), 300).select(*KEYS, "annotation_id")
)
query("sorted_table", CTE + f" SELECT {KEY_SQL}, role FROM msg")(lambda i: records.sorted_table(i.messages))
query("request_stats", REC + f""" SELECT participant, count(*) AS requests, count(DISTINCT ({KEY_SQL})) AS messages, count(DISTINCT annotation_id) AS annotations,
 count(*) / count(DISTINCT annotation_id) AS per_annotation FROM rec GROUP BY participant""")(lambda i: records.request_stats(_records(i), "participant"))
query("token_estimate", "SELECT count(*) AS rows, CAST(coalesce(sum(ceil(length(coalesce(text, '')) / 4.0)), 0) AS BIGINT) AS tokens, round(avg(ceil(length(coalesce(text, '')) / 4.0)), 6) AS per_row FROM documents")(
    lambda i: records.token_stats(i.t("documents"), c("text")).withColumn("per_row", F.round("per_row", 6))
)
query("request_batches", """WITH d AS (SELECT doc_id, coalesce(kind, '') AS kind, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents),
b AS (SELECT *, coalesce(sum(tokens) OVER w, 0) // 5000 AS a, coalesce(sum(bytes) OVER w, 0) // 15000 AS z FROM d WINDOW w AS (PARTITION BY kind ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, kind, tokens, dense_rank() OVER (PARTITION BY kind ORDER BY a, z) - 1 AS batch FROM b""")(
    lambda i: records.batches(i.t("documents").select("doc_id", F.coalesce("kind", F.lit("")).alias("kind"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"),
                                                      F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes")), "tokens", "bytes", ["doc_id"], "kind", 5000, 15000).select("doc_id", "kind", "tokens", "batch")
)
query("best_matches", CTE + f""", x AS (SELECT {KEY_SQL}, annotation_id, score, CAST(least(10, trunc(score)) AS INT) AS score_cutoff FROM scored WHERE is_pos)
SELECT {KEY_SQL}, annotation_id, score, score_cutoff FROM x QUALIFY row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY score_cutoff DESC, score DESC, annotation_id DESC) = 1""")(
    lambda i: records.best_matches(i.scored.where("is_pos").withColumn("score_cutoff", F.least(F.lit(10), c("score").cast("int"))))
)
query("record_query", CTE + f" SELECT {KEY_SQL}, annotation_id, score FROM long WHERE score >= 9")(lambda i: records.query_records(model.long_scores(i.wide), least=9.0).select(*KEYS, "annotation_id", "score"))
query("harmful_summary", CTE + f""", u AS (SELECT {KEY_SQL}, CASE WHEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w > 0 THEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w - 1 END AS turn FROM msg
 WINDOW w AS (PARTITION BY {CONV_SQL} ORDER BY message_index ROWS UNBOUNDED PRECEDING))
SELECT {CONV_SQL}, string_agg(DISTINCT annotation_id, ',' ORDER BY annotation_id) AS harmful, CAST(min(turn) AS BIGINT) AS earliest, min(turn) < 3 AS is_early
 FROM u JOIN long USING ({KEY_SQL}) JOIN annotations a USING (annotation_id) WHERE a.is_harmful AND round_even(score, 0) >= 6 AND turn IS NOT NULL GROUP BY ALL""")(
    lambda i: records.harmful_summary(windows.turn_index(i.messages), model.long_scores(i.wide), i.t("annotations"), CONV, 6, 3).withColumn("harmful", F.array_join("harmful", ","))
)
query("numbered_join", """WITH p AS (SELECT dataset_path, sequence_index, annotation_id, row_number() OVER (ORDER BY dataset_path, sequence_index, annotation_id) AS row FROM manual_items),
q AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row FROM documents)
SELECT row, dataset_path, sequence_index, doc_id FROM p LEFT JOIN q USING (row)""")(
    lambda i: records.numbered(i.t("manual_items").select("dataset_path", "sequence_index", "annotation_id"), ["dataset_path", "sequence_index", "annotation_id"])
    .join(records.numbered(i.t("documents").select("doc_id"), ["doc_id"]), "row", "left").select("row", "dataset_path", "sequence_index", "doc_id")
)
_FREQ = CTE + """, p AS (SELECT annotation_id, participant, count(*) AS n, count(*) FILTER (is_pos) AS pos, count(*) FILTER (role = 'user') AS nu, count(*) FILTER (is_pos AND role = 'user') AS pu FROM scored WHERE in_scope GROUP BY ALL),
fr AS (SELECT annotation_id, avg(pos / n) AS m, stddev_pop(pos / n) AS sd, count(*) AS k, sum(pu) / nullif(sum(nu), 0) AS ru FROM p GROUP BY annotation_id)"""
query("highest_rate", _FREQ + " SELECT round(greatest(0, max(m + 1.96 * sd / sqrt(k))), 9) AS highest FROM fr")(
    lambda i: records.highest_rate(rates.frequencies(i.scored), "participant_mean", "participant_sd", "participants").select(F.round("highest", 9).alias("highest"))
)
query("role_view", _FREQ + " SELECT annotation_id, round(ru, 9) AS rate FROM fr JOIN annotations USING (annotation_id) WHERE (len(scope) = 0 OR list_contains(scope, 'user')) AND ru IS NOT NULL")(
    lambda i: records.role_view(rates.frequencies(i.scored), i.t("annotations"), "user").withColumn("rate", F.round("rate", 9))
)
query("conversation_points", f"""WITH t AS (SELECT {KEY_SQL}, arg_min_null(content, row_id) AS content, max(chat_key) AS k, max(chat_date) AS d FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL)
SELECT {CONV_SQL}, max(k) AS label, max(d) AS date, count(*) AS length, string_agg(message_index || ':' || length(coalesce(content, '')), ' ' ORDER BY message_index) AS points, regexp_extract(source_path, '^([a-z]+_[0-9]+)/', 1) AS bucket FROM t GROUP BY ALL""")(
    lambda i: records.conversations(
        i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEYS).agg(F.min_by("content", "row_id").alias("content"), F.max("chat_key").alias("chat_key"), F.max("chat_date").alias("chat_date")), "bucket"
    ).withColumn("points", F.array_join(F.transform("points", lambda x: F.concat(x["message_index"].cast("string"), F.lit(":"), x["size"].cast("string"))), " "))
)
query("chats_by_date", f"""WITH k AS (SELECT source_path, chat_index, max(chat_key) AS k, max(CASE WHEN regexp_full_match(trim(chat_date), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(trim(chat_date) AS TIMESTAMP) END) AS t FROM messages WHERE chat_index IS NOT NULL GROUP BY ALL),
d AS (SELECT *, bool_and(t IS NOT NULL) OVER (PARTITION BY source_path) AS dated FROM k)
SELECT source_path, chat_index, CAST(row_number() OVER (PARTITION BY source_path ORDER BY CASE WHEN dated THEN -epoch(t) END, CASE WHEN dated THEN lower(k) END DESC NULLS LAST, chat_index) AS INT) AS place FROM d""")(
    lambda i: records.by_date(i.t("messages").where("chat_index IS NOT NULL").groupBy("source_path", "chat_index").agg(
        F.max("chat_key").alias("k"), F.max(F.when(F.trim("chat_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), fx.date_label(c("chat_date")))).alias("t")), ["source_path"], "t", "k", "chat_index").select("source_path", "chat_index", "place")
)
query("latest_per_group", """SELECT source, arg_max(doc_id, (added_at, doc_id)) AS doc_id, max(added_at) AS added_at FROM documents WHERE source IS NOT NULL AND added_at IS NOT NULL GROUP BY source""")(
    lambda i: records.latest_per_group(i.t("documents").where("source IS NOT NULL AND added_at IS NOT NULL").select("source", "doc_id", "added_at"), ["source"], "added_at", "doc_id")
)
query("events_around", "SELECT event_id, user_id FROM events, (SELECT min(ts) + INTERVAL 10 DAYS AS c FROM events) WHERE ts BETWEEN c - INTERVAL 36 HOURS AND c + INTERVAL 36 HOURS")(
    lambda i: records.around(i.t("events").join(F.broadcast(i.t("events").agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("c")))), "ts", c("c"), "36 HOURS").select("event_id", "user_id")
)
query("message_keys", f"""SELECT row_id, trim(participant) AS participant, source_path, chat_index, message_index FROM messages WHERE trim(participant) <> '' AND source_path IS NOT NULL AND chat_index IS NOT NULL AND message_index IS NOT NULL""")(
    lambda i: model.message_key(i.t("messages").withColumns({k: c(k).cast("string") for k in ("chat_index", "message_index")})).select("row_id", *KEYS)
)
query("conversation_keys", "SELECT row_id, participant, source_path, chat_index FROM messages WHERE chat_index IS NOT NULL")(
    lambda i: records.conversation_key(i.t("messages").withColumns({"source_file": c("source_path"), "source_path": F.when(c("row_id") % 2 == 0, c("source_path")).otherwise(" "), "chat_index": c("chat_index").cast("string")})).select("row_id", *CONV)
)
query("coerced_indices", "SELECT row_id, coalesce(chat_index, -1) AS chat_index, -1 AS message_index FROM messages")(
    lambda i: i.t("messages").withColumn("message_index", F.concat(c("message_index").cast("string"), F.lit("x"))).select("row_id", model.coerced_index("chat_index").alias("chat_index"), model.coerced_index("message_index").alias("message_index"))
)
query("annotation_ids", "SELECT DISTINCT annotation_id FROM annotations")(lambda i: i.t("annotations").select(records.annotation_id(F.concat(F.lit(" "), "annotation_id", F.lit("\t "))).alias("annotation_id")).select(F.regexp_replace("annotation_id", r"\s+$", "").alias("annotation_id")).distinct())
query("parsed_scopes", "SELECT annotation_id, array_to_string(list_transform(scope, lambda x: lower(x)), ',') AS scope, len(scope) = 0 AS any_role FROM annotations")(
    lambda i: i.t("annotations").withColumn("s", model.scope_list(F.concat(F.upper(F.array_join("scope", " ; ")), F.lit(" ,")))).select("annotation_id", F.array_join("s", ",").alias("scope"), model.prompt_scope_any(c("s")).alias("any_role"))
)
query("kept_participants", "SELECT DISTINCT participant FROM preprocessed WHERE lower(participant) NOT IN ('hl_101', 'hl_007')")(lambda i: model.without_participants(i.wide.select("participant").distinct(), ("HL_101", "hl_007")))
query("display_ids", "SELECT annotation_id FROM annotations UNION ALL SELECT r || '-both-plays-scene' FROM (VALUES ('user'), ('assistant')) v(r) EXCEPT SELECT 'both-plays-scene'")(
    lambda i: model.display_ids(i.t("annotations").select("annotation_id").unionByName(i.spark.createDataFrame([("user-both-plays-scene",), ("assistant-both-plays-scene",)], "annotation_id string")))
)
query("verified_positives", REC + f""" SELECT annotation_id, count(*) FILTER (score IS NOT NULL AND trunc(score) >= 5 AND len(matches) > 0 AND matches[1] <> '') AS verified, count(*) FILTER (trunc(score) >= 5 AND len(matches) > 0) AS matched,
 count(*) FILTER (len(matches) > 0) AS with_matches FROM rec GROUP BY annotation_id""")(
    lambda i: _records(i).groupBy("annotation_id").agg(
        F.count_if(model.positive_trunc(c("score"), F.lit(5)) & model.quotes_verified(c("matches"), c("content"))).alias("verified"),
        F.count_if(records.positive_by_matches(c("matches"), c("score"), F.lit(5))).alias("matched"), F.count_if(records.positive_by_matches(c("matches"), c("score"))).alias("with_matches"))
)
query("scope_overrides", CTE + """ SELECT s.annotation_id, count(*) AS messages FROM (SELECT annotation_id, CASE annotation_id WHEN 'user-tests-memory' THEN ['user', 'assistant'] WHEN 'both-plays-scene' THEN ['assistant'] ELSE scope END AS scope FROM annotations) s
 JOIN msg ON len(scope) = 0 OR list_contains(scope, role) GROUP BY 1""")(
    lambda i: model.in_scope_messages(i.wide, records.with_scopes(i.t("annotations"), records.scope_overrides(["user-tests-memory: user,Assistant", "both-plays-scene:assistant"]))).groupBy("annotation_id").agg(F.count("*").alias("messages"))
)
query("role_filtered", CTE + " SELECT annotation_id, count(*) AS n FROM scored WHERE role = 'user' GROUP BY 1")(
    lambda i: i.scored.where(c("role") == records.role_filter(" USER ")).groupBy("annotation_id").agg(F.count("*").alias("n"))
)
query("global_positions", CTE + f""", g AS (SELECT participant, {KEY_SQL.split(', ', 1)[1]}, row_number() OVER (PARTITION BY participant ORDER BY source_path, chat_index, message_index) - 1 AS position FROM msg)
SELECT dataset_path, sequence_index, annotation_id, position FROM manual_items LEFT JOIN g USING ({KEY_SQL})""")(
    lambda i: i.t("manual_items").join(windows.positions(i.messages.select(*KEYS)), KEYS, "left").select("dataset_path", "sequence_index", "annotation_id", "position")
)
query("effects_with_frequency", _FREQ + f""", n AS (SELECT {CONV_SQL}, ln(count(*)) AS y FROM msg GROUP BY ALL), e AS (SELECT annotation_id, regr_slope(y, CASE WHEN is_pos THEN 1.0 ELSE 0.0 END) AS slope FROM scored JOIN n USING ({CONV_SQL}) WHERE in_scope GROUP BY 1)
SELECT annotation_id, round(slope, 6) AS slope, round(m, 6) AS rate FROM e LEFT JOIN fr USING (annotation_id)""")(lambda i: _effects(i))


def _effects(i: Inputs):
    from .agreement import _length_sample

    e = regression.ols_binary(_length_sample(i), "annotation_id", "log_length", "hit", "participant")
    return e.join(rates.frequencies(i.scored), "annotation_id", "left").select("annotation_id", F.round("slope", 6).alias("slope"), F.round("participant_mean", 6).alias("rate"))


query("updated_records", REC + f""", b AS (SELECT {KEY_SQL}, annotation_id, min(sequence_index) AS s FROM manual_items GROUP BY ALL)
SELECT {KEY_SQL}, annotation_id, coalesce('item ' || s, error) AS error FROM rec LEFT JOIN b USING ({KEY_SQL}, annotation_id)""")(
    lambda i: relations.updated(_records(i).select(*KEYS, "annotation_id", "error"), i.t("manual_items").groupBy(*KEYS, "annotation_id").agg(F.concat(F.lit("item "), F.min("sequence_index").cast("string")).alias("error")), [*KEYS, "annotation_id"], "error")
)
query("score_maps", CTE + f""", s AS (SELECT {KEY_SQL}, string_agg(annotation_id || '=' || CAST(CAST(score AS DECIMAL(9, 3)) AS VARCHAR), ';' ORDER BY annotation_id) AS scores FROM long GROUP BY ALL)
SELECT dataset_path, sequence_index, annotation_id, scores FROM manual_items LEFT JOIN s USING ({KEY_SQL})""")(
    lambda i: i.t("manual_items").join(relations.score_maps(i.wide), KEYS, "left").select("dataset_path", "sequence_index", "annotation_id", F.array_join(F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(9,3)").cast("string"))), ";").alias("scores"))
)
query("first_record_wins", f"""WITH f AS (SELECT {KEY_SQL}, arg_min_null(role, row_id) AS role, count(*) AS n FROM messages GROUP BY ALL)
SELECT dataset_path, sequence_index, annotation_id, role, coalesce(n > 1, false) AS repeated FROM manual_items LEFT JOIN f USING ({KEY_SQL})""")(
    lambda i: relations.first_wins(i.t("manual_items"), i.t("messages"), KEYS, "role", "row_id").select("dataset_path", "sequence_index", "annotation_id", "role", "repeated")
)
query("stratified_counts")(lambda i: _stratified(i))


def _stratified(i: Inputs):
    sizes = i.messages.groupBy("participant").agg(F.count("*").alias("n"))
    taken = relations.stratified(i.messages, relations.quotas(sizes, 500, "participant", equal=True), "participant", relations.hashed(7, *KEYS))
    return sizes.join(taken.groupBy("participant").agg(F.count("*").alias("taken")), "participant", "left").select("participant", "n", F.coalesce("taken", F.lit(0)).alias("taken"))


SQL["stratified_counts"] = CTE + """, s AS (SELECT participant, count(*) AS n FROM msg WHERE participant IS NOT NULL GROUP BY 1),
o AS (SELECT *, (least(500, sum(n) OVER ()) - coalesce(sum(n) OVER (ORDER BY n, participant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER () - row_number() OVER (ORDER BY n, participant) + 1) AS lv FROM s),
v AS (SELECT coalesce((SELECT lv FROM o WHERE n > lv ORDER BY n, participant LIMIT 1), (SELECT max(n) FROM s)) AS lv),
q AS (SELECT participant, n, least(n, v.lv) AS share FROM s, v),
k AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, participant) AS rk, round(least(500, sum(n) OVER ()) - sum(floor(share)) OVER ()) AS lf FROM q)
SELECT participant, n, CAST(floor(share) + CASE WHEN rk <= lf AND floor(share) < n THEN 1 ELSE 0 END AS BIGINT) AS taken FROM k"""
query("sampled_counts", """SELECT annotation_id, least(5, count(*)) AS taken FROM manual_items GROUP BY 1""")(
    lambda i: relations.per_group(i.t("manual_items"), ["annotation_id"], [relations.hashed(7, "dataset_path", "sequence_index"), c("sequence_index")], 5).groupBy("annotation_id").agg(F.count("*").alias("taken"))
)
query("iaa_rows", """WITH v AS (SELECT dataset_path, sequence_index, participant, annotation_id, annotator, arg_max(CASE WHEN lower(trim(label)) = 'yes' THEN 1 ELSE 0 END, (labelled_at, label_id)) AS y
 FROM manual_labels WHERE lower(trim(label)) IN ('yes', 'no') GROUP BY ALL), p AS (SELECT a.annotator || ' / ' || b.annotator AS row_label, count(*) AS n, count(*) FILTER (a.y = b.y) AS same
 FROM v a JOIN v b USING (dataset_path, sequence_index, participant, annotation_id) WHERE a.annotator < b.annotator GROUP BY 1)
SELECT row_label, n, same, round(same / n, 6) AS agreement FROM p""")(lambda i: _iaa(i))


def _iaa(i: Inputs):
    """Rows of the pairs of annotators in the table of agreement figures (A55), by the filter of sections."""
    word = F.lower(F.trim("label"))
    item = ["dataset_path", "sequence_index", "participant", "annotation_id"]
    v = i.t("manual_labels").where(word.isin("yes", "no")).groupBy(*item, "annotator").agg(F.max_by((word == "yes").cast("int"), F.struct("labelled_at", "label_id")).alias("y"))
    a, b = v.alias("a"), v.alias("b")
    same = [c(f"a.{k}") == c(f"b.{k}") for k in item]
    pairs = a.join(b, [*same, c("a.annotator") < c("b.annotator")]).groupBy(F.concat("a.annotator", F.lit(" / "), "b.annotator").alias("row_label")).agg(F.count("*").alias("n"), F.count_if(c("a.y") == c("b.y")).alias("same"))
    rows = pairs.withColumns({"section": F.lit("inter_annotator"), "agreement": F.round(c("same") / c("n"), 6)})
    humans = rows.agg(F.sum("n").alias("n"), F.sum("same").alias("same")).select(F.lit("Humans (all annotators)").alias("row_label"), "n", "same", F.lit("inter_annotator").alias("section"), (c("same") / c("n")).alias("agreement"))
    return records.agreement_rows(rows.unionByName(humans), "inter_annotator", keep_humans=False).select("row_label", "n", "same", "agreement")


query("triple_panel", None)(lambda i: _panel(i))


def _panel(i: Inputs):
    from .sequences import _win

    return dynamics.triple_panel(_win(i)).withColumns({k: F.round(k, 6) for k in ("given_x", "given_xy", "change")})


def _add_panel_sql():
    from .sequences import _SEQ

    SQL["triple_panel"] = _SEQ + """, xy AS (SELECT s.x, w.y, s.participant, s.source_path, s.chat_index, s.rn FROM src s JOIN win w USING (participant, source_path, chat_index, rn)),
t3 AS (SELECT xy.x, xy.y, z.y AS z, count(*) AS n FROM xy JOIN win z USING (participant, source_path, chat_index, rn) WHERE z.y <> xy.y GROUP BY ALL),
j AS (SELECT t3.x, t3.y, t3.z, cz.successes / tr.trials AS given_x, t3.n / cy.successes AS given_xy FROM t3 JOIN ct cy ON cy.x = t3.x AND cy.y = t3.y JOIN ct cz ON cz.x = t3.x AND cz.y = t3.z JOIN tr ON tr.x = t3.x)
SELECT x, y, z, round(given_x, 6) AS given_x, round(given_xy, 6) AS given_xy, round(given_xy - given_x, 6) AS change,
 CAST(row_number() OVER (PARTITION BY x, y ORDER BY round(abs(given_xy - given_x), 9) DESC, z) AS INT) AS place FROM j"""


_add_panel_sql()
query("top_curves", CTE + """, s0 AS (SELECT participant, annotation_id, category, dense_rank() OVER (PARTITION BY participant ORDER BY source_path, chat_index, message_index) - 1 AS position, CASE WHEN is_pos THEN 1.0 ELSE 0.0 END AS hit FROM scored WHERE in_scope),
s AS (SELECT participant, annotation_id, category, position, avg(hit) OVER (PARTITION BY participant, annotation_id ORDER BY position ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS y FROM s0),
g AS (SELECT DISTINCT participant, position FROM s), a AS (SELECT participant, annotation_id, category, min(position) AS lo, max(position) AS hi FROM s GROUP BY ALL),
x AS (SELECT a.participant, a.annotation_id, a.category, g.position FROM a JOIN g ON g.participant = a.participant AND g.position BETWEEN lo AND hi),
l AS (SELECT x.*, p.position AS x0, p.y AS y0 FROM x ASOF JOIN s p ON p.participant = x.participant AND p.annotation_id = x.annotation_id AND x.position >= p.position),
r AS (SELECT l.*, p.position AS x1, p.y AS y1 FROM l ASOF JOIN s p ON p.participant = l.participant AND p.annotation_id = l.annotation_id AND l.position <= p.position),
v AS (SELECT participant, category, sum(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (position - x0) / (x1 - x0) END) AS area FROM r GROUP BY ALL)
SELECT participant, category, round(area, 6) AS area FROM v QUALIFY row_number() OVER (PARTITION BY participant ORDER BY round(area, 6) DESC, category) <= 12""")(
    lambda i: windows.top_curves(windows.series(i.scored.where("in_scope"), 50), "participant", "annotation_id", "category", "position", "rolling", 12)
)
query("prompts", """SELECT annotation_id, 'Is ' || annotation_id || ' (' || array_to_string(scope, '/') || ')' || CASE WHEN is_harmful THEN ' harmful' ELSE '' END || '? {open}' AS prompt FROM annotations""")(
    lambda i: i.t("annotations").select("annotation_id", fx.prompt("Is {id} ({scope}){harm}? {open}", id=c("annotation_id"), scope=F.array_join("scope", "/"), harm=F.when(c("is_harmful"), " harmful")).alias("prompt"))
)
query("pseudonyms", """SELECT DISTINCT participant, 'PERSON_' || substr(sha256('PERSON|' || lower(participant)), 1, 8) AS pseudonym FROM messages""")(
    lambda i: i.t("messages").select("participant", fx.pseudonym("PERSON", F.upper("participant")).alias("pseudonym")).distinct()
)
query("packed_requests", """WITH RECURSIVE o AS (SELECT annotation_id, cutoff + length(annotation_id) AS cost, row_number() OVER (ORDER BY annotation_id) AS n FROM cutoffs),
w AS (SELECT n, annotation_id, cost, cost <= 300 AS fits, 300 - CASE WHEN cost <= 300 THEN cost ELSE 0 END AS room FROM o WHERE n = 1
 UNION ALL SELECT o.n, o.annotation_id, o.cost, o.cost <= w.room, w.room - CASE WHEN o.cost <= w.room THEN o.cost ELSE 0 END FROM w JOIN o ON o.n = w.n + 1) SELECT annotation_id, CAST(cost AS INT) AS cost, fits FROM w""")(lambda i: _packed(i))


def _packed(i: Inputs):
    """Requests, one per annotation, that fit a budget; their number is that of the annotations."""
    rows = i.t("cutoffs").select("annotation_id", (c("cutoff") + F.length("annotation_id")).alias("cost")).orderBy("annotation_id").collect()
    return i.spark.createDataFrame([(r.annotation_id, r.cost, f) for r, f in zip(rows, small.packed([r.cost for r in rows], 300))], "annotation_id string, cost int, fits boolean")


@query("heatmap_order")
def _heatmap(i: Inputs):
    """Order of the labels by Ward clustering of their rows of log2 enrichment at every K (M06, M07), and by average linkage."""
    cells = dynamics.log_matrix(i.t("sequence_pairs"), "K", "X", "Y", "enrichment_K").orderBy("X", "K", "Y").collect()
    names = sorted({r.X for r in cells})
    table: dict[str, list[float]] = {n: [] for n in names}
    for r in cells:
        table[r.X].append(r.value)
    features = np.array([table[n] for n in names])
    places = {m: {k: p for p, k in enumerate(small.leaf_order(features, m))} for m in ("ward", "average")}
    return i.spark.createDataFrame([(n, places["ward"][k], places["average"][k]) for k, n in enumerate(names)], "annotation_id string, ward int, average int")


query("split_thoughts", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'I think “so” – ' || kind END AS thought, CASE WHEN doc_id % 3 > 0 THEN 'Yes.' ELSE 'I think “so” – ' || kind || chr(10) || ' Yes.' END AS response FROM documents WHERE kind IS NOT NULL""")(
    lambda i: records.split_thoughts(
        i.t("documents").where("kind IS NOT NULL").select("doc_id", "kind", F.concat(F.lit("I think “so” – "), "kind", F.lit("\n Yes. ")).alias("content")),
        lambda t: t.withColumn("answer", F.when(c("doc_id") % 3 > 0, F.concat(F.lit('I think "so" -  '), "kind")).otherwise("something else")),
    ).select("doc_id", "thought", "response")
)
query("rewritten_messages", f"""WITH t AS (SELECT {KEY_SQL}, lower(trim(arg_min_null(role, row_id))) AS role, arg_min_null(content, row_id) AS content FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL)
SELECT {KEY_SQL}, CASE WHEN role = 'user' AND message_index % 4 > 0 THEN 'again: ' || message_index ELSE content END AS content FROM t""")(
    lambda i: records.rewritten(
        i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEYS).agg(F.lower(F.trim(F.min_by("role", "row_id"))).alias("role"), F.min_by("content", "row_id").alias("content")),
        lambda t: t.withColumn("answer", F.when(c("message_index") % 4 > 0, F.concat(F.lit(" again: "), c("message_index").cast("string"))).otherwise(" ")),
    ).select(*KEYS, "content")
)
query("scored_subsets", """SELECT doc_id, CAST(doc_id % 11 AS INT) AS prior_conversation_reliance, 10 AS uploaded_document_reliance, 0 AS cohesion, kind AS notes FROM documents WHERE kind IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)""")(
    lambda i: records.scored_subsets(
        i.t("documents").where("kind IS NOT NULL").select("doc_id", "kind"), i.t("documents").where("doc_id % 4 = 0"), ["doc_id"],
        lambda t: t.withColumn("answer", F.concat(F.lit('{"prior_conversation_reliance": '), (c("doc_id") % 11).cast("string"), F.lit(', "uploaded_document_reliance": 99, "cohesion": -3, "notes": "'), "kind", F.lit('"}'))),
    ).select("doc_id", "prior_conversation_reliance", "uploaded_document_reliance", "cohesion", "notes")
)
query("page_links", """SELECT DISTINCT source_path, chat_index, replace(url_encode(regexp_replace(source_path, '\\.json$', '.html')), '%2F', '/') || '#chat-' || (chat_index + 1) AS link FROM messages WHERE chat_index IS NOT NULL""")(
    lambda i: i.t("messages").where("chat_index IS NOT NULL").select("source_path", "chat_index", fx.page_link(c("source_path"), c("chat_index")).alias("link")).distinct()
)
query("latex_texts", r"""SELECT doc_id, replace(replace(replace(regexp_replace(replace(kind || '_\x&50%~^{' || text, '\', chr(1)), '([&%$#_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}') AS tex FROM documents""")(
    lambda i: i.t("documents").select("doc_id", fx.latex_escaped(F.concat("kind", F.lit("_\\x&50%~^{"), "text")).alias("tex"))
)
query("anonymised_texts", """WITH t AS (SELECT row_id, content, strpos(content, ' ') - 1 AS n FROM messages WHERE strpos(content, ' ') > 2)
SELECT row_id, '<word>' || substr(content, n + 1) AS replaced, repeat('*', n) || substr(content, n + 1) AS masked, sha256(substr(content, 1, n)) || substr(content, n + 1) AS hashed, substr(content, n + 1) AS redacted,
 'word_' || substr(sha256('word|' || lower(substr(content, 1, n))), 1, 8) || substr(content, n + 1) AS faked FROM t""")(lambda i: _anonymised(i))


def _anonymised(i: Inputs):
    """The first word of each message, put away in every way."""
    t = i.t("messages").select("row_id", "content", (F.instr("content", F.lit(" ")) - 1).alias("n")).where("n > 1")
    spans = F.array(F.struct(F.lit(0).alias("start"), c("n").cast("int").alias("stop"), F.lit("word").alias("kind")))
    ways = {"replaced": "replace", "masked": "mask", "hashed": "hash", "redacted": "redact", "faked": "fake"}
    return t.select("row_id", *[fx.anonymised(c("content"), spans, how).alias(name) for name, how in ways.items()])


query("cached_embeddings", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'held' ELSE 'made' END AS how, CASE WHEN doc_id % 3 > 0 THEN doc_id ELSE length(coalesce(text, '')) END AS first FROM documents""")(
    lambda i: relations.with_cached(
        i.t("documents").select("doc_id", "text"),
        i.t("documents").where("doc_id % 3 > 0").select("doc_id", F.array(c("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("v")), ["doc_id"], "v",
        lambda t: t.withColumn("v", F.array(F.length(F.coalesce("text", F.lit(""))).cast("float"), F.lit(0.0).cast("float"))),
    ).select("doc_id", F.when(c("v")[1] > 0, "held").otherwise("made").alias("how"), c("v")[0].cast("bigint").alias("first"))
)
