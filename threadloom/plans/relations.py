"""Queries over joins, sets, selection, transcripts, text and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import model, relations, terms, transcripts, windows
from .base import CONV_SQL, CTE, KEY_SQL, Inputs

QUERIES: dict = {}
SQL: dict = {}
KEYS = list(model.KEY)
#: Terms of the TF-IDF vocabulary, the most used ones.
VOCABULARY = 20_000


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


_ONCE = f"SELECT {KEY_SQL}, arg_min(content, row_id) AS content FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY {KEY_SQL}"
query("join_annotations_transcripts", CTE + f""", t AS (SELECT {KEY_SQL}, min(row_id) AS row_id FROM messages GROUP BY ALL)
SELECT {KEY_SQL}, annotation_id, score, row_id FROM long JOIN t USING ({KEY_SQL})""")(
    lambda i: model.long_scores(i.wide).drop("role").join(i.t("messages").groupBy(*KEYS).agg(F.min("row_id").alias("row_id")), KEYS)
)
query("attach_content", f"""WITH t AS (SELECT {KEY_SQL}, arg_min_null(content, row_id) AS content FROM messages GROUP BY ALL)
SELECT p.sequence_index, p.dataset_path, p.annotation_id, coalesce(t.content, '') AS content FROM manual_items p LEFT JOIN t USING ({KEY_SQL})""")(
    lambda i: relations.attach_content(i.t("manual_items"), i.t("messages")).select("sequence_index", "dataset_path", "annotation_id", "content")
)
query("semi_join_locations", f"SELECT row_id FROM messages SEMI JOIN manual_items USING ({KEY_SQL})")(
    lambda i: relations.only_keys(i.t("messages"), i.t("manual_items"), KEYS).select("row_id")
)
query("anti_join_resume", f"SELECT DISTINCT {KEY_SQL} FROM preprocessed ANTI JOIN manual_items USING ({KEY_SQL})")(
    lambda i: relations.unseen(i.wide, i.t("manual_items"), KEYS).select(*KEYS).distinct()
)
query("score_lookup_join", CTE + f"""SELECT p.dataset_path, p.sequence_index, p.annotation_id, l.score, p.llm_score FROM manual_items p LEFT JOIN long l USING ({KEY_SQL}, annotation_id)""")(
    lambda i: i.t("manual_items").join(model.long_scores(i.wide).drop("role"), [*KEYS, "annotation_id"], "left").select("dataset_path", "sequence_index", "annotation_id", "score", "llm_score")
)
query("checked_id_map", "SELECT source_path, min(participant) AS participant FROM transcript_files GROUP BY source_path")(
    lambda i: relations.checked_map(i.t("transcript_files"), "source_path", "participant")
)
query("duplicate_groups", "SELECT text, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT text, source, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY ALL) GROUP BY text HAVING count(*) >= 2")(
    lambda i: relations.duplicate_groups(i.t("documents"), "text", "source")
)
query("pairwise_overlap", """WITH p AS (SELECT text, source AS g, count(*) AS n FROM documents WHERE trim(text) <> '' AND source IS NOT NULL GROUP BY ALL)
SELECT a.g AS first, b.g AS second, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM p a JOIN p b ON a.text = b.text AND a.g < b.g GROUP BY ALL""")(
    lambda i: relations.overlaps(i.t("documents"), "text", "source")
)
query("repeated_keys", f"SELECT {KEY_SQL}, count(*) AS n FROM messages GROUP BY ALL HAVING count(*) > 1")(lambda i: relations.repeated_keys(i.t("messages"), KEYS))
query("union_distinct_keys", f"SELECT {KEY_SQL} FROM messages UNION SELECT {KEY_SQL} FROM preprocessed")(
    lambda i: i.t("messages").select(*KEYS).unionByName(i.wide.select(*KEYS)).distinct()
)
query("intersect_keys", f"SELECT {KEY_SQL} FROM messages INTERSECT SELECT {KEY_SQL} FROM preprocessed")(lambda i: i.t("messages").select(*KEYS).intersect(i.wide.select(*KEYS)))
query("except_keys", f"SELECT {KEY_SQL} FROM messages EXCEPT SELECT {KEY_SQL} FROM preprocessed")(lambda i: i.t("messages").select(*KEYS).subtract(i.wide.select(*KEYS)))
query("cap_per_annotation", f"""SELECT dataset_path, sequence_index, annotation_id FROM manual_items
 QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY sequence_index, dataset_path) <= 5""")(
    lambda i: relations.per_group(i.t("manual_items"), ["annotation_id"], [F.col("sequence_index"), F.col("dataset_path")], 5).select("dataset_path", "sequence_index", "annotation_id")
)
query("sample_per_annotation")(
    lambda i: relations.per_group(i.t("manual_items"), ["annotation_id"], [relations.hashed(7, "dataset_path", "sequence_index"), F.col("sequence_index")], 5).select("dataset_path", "sequence_index", "annotation_id")
)
query("symmetric_extremes", """(SELECT "K", "X", "Y", round(ln(enrichment_K), 9) AS e FROM sequence_pairs WHERE ln(enrichment_K) < 0 ORDER BY e, "X" || "Y" || "K" LIMIT 10)
UNION ALL (SELECT "K", "X", "Y", round(ln(enrichment_K), 9) AS e FROM sequence_pairs WHERE ln(enrichment_K) > 0 ORDER BY e DESC, "X" || "Y" || "K" LIMIT 10)""")(
    lambda i: relations.extremes(i.t("sequence_pairs").select("K", "X", "Y", F.round(F.ln("enrichment_K"), 9).alias("e"), F.concat("X", "Y", "K").alias("tie")), "e", "tie", 10, 10).drop("tie")
)
query("page_of_records", f"SELECT {KEY_SQL}, annotation_id, score FROM (" + CTE + f"""SELECT {KEY_SQL}, annotation_id, score FROM scored WHERE is_pos
 ORDER BY score DESC, annotation_id, {KEY_SQL} LIMIT 25 OFFSET 50)""")(
    lambda i: relations.page(i.scored.where("is_pos").select(*KEYS, "annotation_id", "score"), [F.desc("score"), F.col("annotation_id"), *[F.col(k) for k in KEYS]], 3, 25)
)
query("quota_allocation", """WITH s AS (SELECT participant, count(*) AS n FROM preprocessed GROUP BY 1), w AS (SELECT *, 500.0 * n / sum(n) OVER () AS share FROM s),
f AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, participant) AS rk, 500 - sum(floor(share)) OVER () AS lf FROM w)
SELECT participant, n, CAST(fl + CASE WHEN rk <= lf AND fl < n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")(
    lambda i: relations.quotas(i.wide.groupBy("participant").agg(F.count("*").alias("n")), 500, "participant")
)
query("stratified_sample")(
    lambda i: relations.stratified(i.messages, relations.quotas(i.messages.groupBy("participant").agg(F.count("*").alias("n")), 500, "participant", equal=True), "participant", relations.hashed(7, *KEYS))
)
query("whole_conversation_sample", CTE + f""", s AS (SELECT {CONV_SQL}, count(*) AS length FROM msg GROUP BY ALL),
b AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY participant ORDER BY source_path, chat_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT {CONV_SQL}, length FROM b WHERE before < 40""")(
    lambda i: relations.whole_conversations(windows.lengths(i.messages), 40, "participant", F.struct("source_path", "chat_index"))
)
query("first_message_with_quote", f"""WITH t AS ({_ONCE}), q AS (SELECT DISTINCT {CONV_SQL}, substr(content, 3, 12) AS quote FROM t WHERE message_index % 3 = 0 AND length(content) >= 14
 UNION SELECT DISTINCT {CONV_SQL}, upper(substr(content, 3, 12)) FROM t WHERE message_index % 3 = 1 AND length(content) >= 14 AND regexp_full_match(substr(content, 3, 12), '[ -~]*'))
SELECT {CONV_SQL}, quote, arg_min(message_index, (CASE WHEN contains(content, quote) THEN 0 ELSE 1 END, message_index)) AS message_index
 FROM t JOIN q USING ({CONV_SQL}) WHERE contains(content, quote) OR contains(lower(content), lower(quote)) GROUP BY ALL""")(lambda i: _first_messages(i))


def _first_messages(i: Inputs):
    """Of a stretch of each third message, and of one in capitals, the message that holds it first."""
    m = i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEYS).agg(F.min_by("content", F.when(F.col("content").isNotNull(), F.col("row_id"))).alias("content"))
    part = F.substring("content", 3, 12)
    long = m.where("length(content) >= 14")
    quotes = long.where("message_index % 3 = 0").select(*KEYS[:3], part.alias("quote")).union(
        long.where((F.col("message_index") % 3 == 1) & part.rlike("^[ -~]*\\z")).select(*KEYS[:3], F.upper(part).alias("quote"))).distinct()
    return relations.first_match(m, quotes, KEYS[:3])


query("participant_stats_total", f"""WITH t AS (SELECT {KEY_SQL}, arg_min_null(content, row_id) AS content FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL),
c AS (SELECT {CONV_SQL}, count(*) AS length, sum(length(coalesce(content, ''))) AS chars,
 sum(CASE WHEN trim(regexp_replace(coalesce(content, ''), '[\\s\\x0b\\x{{a0}}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(content, '[\\s\\x0b\\x{{a0}}]+', ' ', 'g')), ' ')) END) AS words FROM t GROUP BY ALL)
SELECT coalesce(participant, 'TOTAL') AS participant, count(*) AS conversations, CAST(sum(length) AS BIGINT) AS messages, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words,
 max(length) AS longest, quantile_cont(length, 0.5) AS median_length FROM c GROUP BY GROUPING SETS ((participant), ())""")(lambda i: transcripts.participant_stats(i.t("messages")))
query("ordering_types", """WITH f AS (SELECT participant, count(DISTINCT source_path) AS files, bool_or(trim(coalesce("timestamp", '')) <> '' OR trim(coalesce(chat_date, '')) <> '') AS dated,
 count(*) FILTER (chat_index IS NOT NULL AND message_index IS NOT NULL) AS n FROM messages GROUP BY 1)
SELECT participant, CASE WHEN n = 0 THEN 'unknown' WHEN dated THEN 'full_dated' WHEN files = 1 THEN 'global_order' ELSE 'conversation_only' END AS ordering_type FROM f""")(
    lambda i: transcripts.ordering_of_transcripts(i.t("messages"))
)
query("ordering_of_records", f"""WITH m AS (SELECT {KEY_SQL}, bool_or(trim(coalesce("timestamp", '')) <> '') AS t FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL),
c AS (SELECT {CONV_SQL}, bool_or(trim(coalesce(chat_date, '')) <> '') AS d FROM messages WHERE chat_index IS NOT NULL GROUP BY ALL),
a AS (SELECT participant, count(*) AS n, avg(t::INT) AS ts FROM m GROUP BY 1), b AS (SELECT participant, count(*) AS k, avg(d::INT) AS dates FROM c GROUP BY 1)
SELECT participant, CASE WHEN coalesce(ts, 0) >= 0.9 OR coalesce(dates, 0) >= 0.9 THEN 'full_dated' WHEN coalesce(n, 0) > 0 THEN 'global_order' ELSE 'conversation_only' END AS ordering_type,
 coalesce(ts, 0) > 0 AS has_timestamps, coalesce(dates, 0) > 0 AS has_conversation_dates, coalesce(n, 0) > 0 AS has_message_indices FROM a FULL JOIN b USING (participant)""")(
    lambda i: transcripts.ordering_of_records(i.t("messages"))
)
query("daily_counts", """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1""")(
    lambda i: transcripts.daily(i.t("events"), "ts", "event_type", ["click", "view"])
)
query("validate_alternation", CTE + f""", s AS (SELECT {KEY_SQL}, role, lag(role) OVER w AS before, row_number() OVER w AS rn FROM msg WINDOW w AS (PARTITION BY {CONV_SQL} ORDER BY message_index))
SELECT {CONV_SQL}, count(*) >= 2 AND coalesce(max(role) FILTER (rn = 1), '') = 'user' AND count(*) FILTER (rn > 1 AND role IS NOT DISTINCT FROM before) = 0 AS valid FROM s GROUP BY ALL""")(
    lambda i: transcripts.alternation(i.messages)
)
query("context_lengths", CTE + f""", n AS (SELECT count(*) OVER (PARTITION BY {CONV_SQL} ORDER BY message_index RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS size FROM msg)
SELECT CAST(size AS INT) AS size, count(*) AS messages FROM n GROUP BY 1""")(
    lambda i: windows.preceding_range(i.messages, 3).groupBy(F.size("before").alias("size")).agg(F.count("*").alias("messages"))
)
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
query("text_normalise", rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(12), chr(10) || chr(10)), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}|{_WS}$', '', 'g') AS clean FROM documents""")(
    lambda i: i.t("documents").select("doc_id", fx.normalize_text(F.col("text")).alias("clean"))
)
query("interface_detect", r"""WITH m AS (SELECT row_id, lower(content) AS t FROM messages)
SELECT row_id, CASE WHEN regexp_matches(t, '\bchat history\b') AND regexp_matches(t, 'chatgpt said:') THEN 'chatgpt' WHEN regexp_matches(t, '\bchatgpt (can make mistakes|says:)') THEN 'chatgpt'
 WHEN regexp_matches(t, '(?m)^#####\s+\*\*you said:\*\*') AND regexp_matches(t, '######\s+\*\*chatgpt said:\*\*') THEN 'chatgpt'
 WHEN regexp_matches(t, '(?m)^\s*(human|user)\s*:\s') AND regexp_matches(t, '(?m)^\s*(assistant|claude)\s*:\s') THEN 'claude'
 WHEN regexp_matches(t, '(?m)^###\s*(human|user)\b') AND regexp_matches(t, '(?m)^###\s*(assistant|claude)\b') THEN 'claude'
 WHEN regexp_matches(t, '(?m)^\s*#{1,6}\s*(you|me)\b.*\n') AND regexp_matches(t, '(?m)^\s*#{1,6}\s*(gemini|assistant)\b.*\n') THEN 'gemini'
 WHEN regexp_matches(t, '\b(gemini says:|model:\s*gemini)\b') THEN 'gemini' WHEN t IS NOT NULL THEN 'unknown' END AS interface FROM m""")(
    lambda i: i.t("messages").select("row_id", fx.interface_of(F.col("content")).alias("interface"))
)
query("slugs", r"""SELECT DISTINCT chat_key, regexp_replace(regexp_replace(chat_key, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM messages""")(
    lambda i: i.t("messages").select("chat_key", fx.slugify(F.col("chat_key")).alias("slug")).distinct()
)
query("buckets", r"SELECT source_path, regexp_extract(source_path, '^([a-z]+_[0-9]{2,})/', 1) AS bucket, replace(regexp_replace(participant, '^irb_', '1-'), 'hl_', '2-') AS shown FROM transcript_files")(
    lambda i: i.t("transcript_files").select("source_path", fx.bucket(F.col("source_path")).alias("bucket"), fx.display_participant(F.col("participant")).alias("shown"))
)
query("quote_validation", """SELECT e.item_id, d.doc_id FROM eval_items e JOIN documents d ON contains(lower(d.text), lower(e.text))""")(
    lambda i: relations.texts_with_quotes(i.t("documents").where("text IS NOT NULL"), i.t("eval_items").where("text IS NOT NULL").select("item_id", F.col("text").alias("quote")), "text", "quote").select("item_id", "doc_id")
)
query("topic_enrichment", """WITH d AS (SELECT vec_id % 20 AS participant, label FROM embeddings), c AS (SELECT participant, label, count(*) AS n FROM d GROUP BY ALL),
o AS (SELECT label, sum(n) / (SELECT count(*) FROM d) AS q FROM c GROUP BY label), s AS (SELECT c.*, n / sum(n) OVER (PARTITION BY participant) AS p, q FROM c JOIN o USING (label))
SELECT participant, label, n, round(p, 6) AS p, round(ln((p + 1e-9) / (q + 1e-9)), 6) AS enrichment, round(-sum(p * ln(p)) OVER (PARTITION BY participant), 6) AS entropy FROM s""")(
    lambda i: relations.enrichment_entropy(i.t("embeddings").select((F.col("vec_id") % 20).alias("participant"), "label"), "participant", "label").withColumns(
        {c: F.round(c, 6) for c in ("p", "enrichment", "entropy")}
    )
)


@query("kmeans_topics")
def _kmeans(i: Inputs):
    """Cluster sizes of the embeddings, the best of 10 starts (M10); labels are the engine's own."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = i.t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    data = data.cache()
    try:
        best = min((KMeans(k=100, seed=seed, maxIter=300).fit(data) for seed in range(10)), key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()
    return best.transform(data).groupBy(F.col("prediction").alias("topic")).agg(F.count("*").alias("members"))


@query("tfidf_terms")
def _tfidf(i: Inputs):
    """Top 1-2 grams per kind of document by mean smoothed TF-IDF, each document of length 1 (M11, part of A45)."""
    from pyspark.ml.feature import StopWordsRemover

    stops = frozenset(StopWordsRemover.loadDefaultStopWords("english"))
    mean = terms.mean_weights(i.t("documents"), "text", "kind", stops, VOCABULARY, 5)
    return relations.per_group(mean, ["kind"], [F.desc(F.round("weight", 6)), F.col("term")], 15).withColumn("weight", F.round("weight", 6))


_TREE = CTE + """, n AS (SELECT participant || '|' || source_path || '|' || chat_index AS tree, message_index + 1 AS node, nullif((message_index + 1) // 2, 0) AS parent, message_index AS rank,
 CASE WHEN role IN ('user', 'assistant') AND message_index % 5 <> 3 THEN 1 ELSE 0 END AS turn FROM msg WHERE participant IS NOT NULL),
w AS (WITH RECURSIVE up AS (SELECT tree, node, parent, turn AS gain, [rank] AS ranks FROM n UNION ALL
 SELECT u.tree, u.node, p.parent, u.gain + p.turn, list_prepend(p.rank, u.ranks) FROM up u JOIN n p ON p.tree = u.tree AND p.node = u.parent) SELECT * FROM up),
r AS (SELECT w.* FROM w LEFT JOIN n p ON p.tree = w.tree AND p.node = w.parent WHERE p.node IS NULL),
l AS (SELECT r.* FROM r LEFT JOIN n k ON k.tree = r.tree AND k.parent = r.node WHERE k.node IS NULL)
SELECT tree, CAST(arg_min(node, (-gain, ranks)) AS INT) AS leaf, max(gain) AS turns FROM l GROUP BY tree"""


@query("chat_tree_longest_path", _TREE)
def _tree(i: Inputs):
    """Longest path of reply trees made of each conversation: message n answers message n // 2."""
    m = i.messages.where("participant IS NOT NULL")
    tree = F.concat_ws("|", "participant", "source_path", "chat_index")
    nodes = m.select(
        tree.alias("tree"), (F.col("message_index") + 1).alias("node"), F.nullif(F.floor((F.col("message_index") + 1) / 2).cast("int"), F.lit(0)).alias("parent"),
        F.col("message_index").alias("rank"), (F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) & (F.col("message_index") % 5 != 3)).cast("int").alias("turn"),
    )
    return transcripts.longest_path(nodes)
