"""Queries over the scalar text functions, on whole columns of the tables or on texts built from them.

Texts in the forms that a function reads (answers of a model, export pages, parameters) do not stand in
the tables; both sides build them from table columns, and the oracle states what must come out from
those columns, not from the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python as px
from ..functions import text as fx
from ..operators import model
from .base import CONV_SQL, CTE, KEY_SQL, Inputs

QUERIES: dict = {}
SQL: dict = {}
KEYS = list(model.KEY)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


c = F.col
query("short_slugs", r"""WITH w AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '^[\s\x{0b}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''),
 '[\s\x{0b}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')[1:4], lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g'))), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, rtrim(substr(CASE WHEN len(w) > 0 THEN array_to_string(w, '-') ELSE 'untitled' END, 1, 48), '-') AS slug FROM w""")(
    lambda i: i.t("documents").where("text IS NOT NULL").select("doc_id", fx.short_slug(c("text")).alias("slug"))
)
query("param_strings", """SELECT doc_id, 'kind=' || coalesce(url_encode(kind), 'None') || '&source=' || coalesce(url_encode(source), 'None') || '&title=' || coalesce(url_encode(substr(text, 1, 30)), 'None') AS params,
 kind, source, substr(text, 1, 30) AS title FROM documents""")(
    lambda i: i.t("documents").select("doc_id", fx.params_text(F.create_map(F.lit("title"), F.substring("text", 1, 30), F.lit("source"), c("source"), F.lit("kind"), c("kind"))).alias("params"))
    .withColumn("back", fx.params_of(c("params"))).select("doc_id", "params", *[c("back")[k].alias(k) for k in ("kind", "source", "title")])
)
query("custom_ids", """SELECT row_id, url_encode(participant) || '|' || url_encode(source_path) || '|' || chat_index || '|' || message_index || '|' || url_encode('id|' || row_id || ' ~*é') AS custom_id,
 source_path AS path_back, 'id|' || row_id || ' ~*é' AS id_back FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL""")(
    lambda i: i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL")
    .select("row_id", fx.encode_id(*[c(k) for k in KEYS], F.concat(F.lit("id|"), c("row_id").cast("string"), F.lit(" ~*é"))).alias("custom_id"))
    .withColumn("d", fx.decode_id(c("custom_id"), 5, (2, 3))).select("row_id", "custom_id", c("d")[1].alias("path_back"), c("d")[4].alias("id_back"))
)
# Quotes made from a message: a slice, the slice in capitals with doubled spaces, its words with other punctuation, and a foreign one.
_QUOTES = """[substr(content, 3, 24), replace(upper(substr(content, 3, 24)), ' ', '  '), regexp_replace(lower(content), '[^a-z0-9'']+', ' -- ', 'g'), 'no such words stand here', '  ']"""
_TOKENS = "array_to_string(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9'']+'), ' ')"
_SQUASH = r"trim(replace(lower(regexp_replace({}, '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')), 'ß', 'ss'))"
query("quote_match", f"""WITH q AS (SELECT row_id, content, unnest({_QUOTES}) AS quote FROM messages WHERE content IS NOT NULL),
f AS (SELECT row_id, trim(quote) <> '' AS counts, contains(replace(lower(content), 'ß', 'ss'), replace(lower(quote), 'ß', 'ss')) OR contains({_SQUASH.format('content')}, {_SQUASH.format('quote')})
 OR ({_TOKENS.format('quote')} <> '' AND contains(' ' || {_TOKENS.format('content')} || ' ', ' ' || {_TOKENS.format('quote')} || ' ')) AS hit FROM q)
SELECT row_id, count(*) FILTER (counts AND hit) AS matched, count(*) FILTER (counts AND NOT hit) AS unmatched FROM f GROUP BY row_id""")(
    lambda i: i.t("messages").where("content IS NOT NULL").select("row_id", "content", F.array(
        F.substring("content", 3, 24), F.replace(F.upper(F.substring("content", 3, 24)), F.lit(" "), F.lit("  ")),
        F.regexp_replace(F.lower("content"), "[^a-z0-9']+", " -- "), F.lit("no such words stand here"), F.lit("  ")).alias("q"))
    .select("row_id", F.size(fx.matched_quotes(c("q"), c("content"))).cast("bigint").alias("matched"), F.size(fx.unmatched_quotes(c("q"), c("content"))).cast("bigint").alias("unmatched"))
)
query("quotes_of_errors", """SELECT doc_id, doc_id % 3 = 0 AS failed, CASE WHEN doc_id % 3 = 0 THEN ['a ' || doc_id, kind] ELSE [] END AS quotes FROM documents WHERE kind IS NOT NULL""")(
    lambda i: i.t("documents").where("kind IS NOT NULL").select("doc_id", (c("doc_id") % 3 == 0).alias("failed"), fx.quotes_of_error(F.concat(
        F.lit('row "0": '), F.when(c("doc_id") % 3 == 0, fx.QUOTE_ERROR).otherwise("Other"), F.lit(': "a '), c("doc_id").cast("string"), F.lit('", "'), c("kind"), F.lit('"'))).alias("quotes"))
)


def _answers(i: Inputs):
    """Answers of a model in nine forms, by sequence_index."""
    s = c("llm_score").cast("string")
    quotes = F.concat(F.lit('["'), c("annotation_id"), F.lit(' \\"x\\"", " ", "b"]'))
    plain = F.concat(F.lit('{"quotes": '), quotes, F.lit(', "score": '), s, F.lit("}"))
    forms = [
        plain, F.concat(F.lit("<think> why {so} </think> "), plain), F.concat(F.lit("```json\n"), plain, F.lit("\n```")),
        F.concat(F.lit('{"quotes": '), quotes, F.lit(', "score": '), s, F.lit(".5,}")), F.lit("{}"), F.lit("I cannot say."),
        F.concat(F.lit('{"score": '), s, F.lit("}")), F.concat(F.lit('{"quotes": "no list", "score": '), s, F.lit("}")),
        F.concat(F.lit('{"quotes": '), quotes, F.lit(', "score": 4'), s, F.lit("}")),
    ]
    text = F.element_at(F.array(*forms), (c("sequence_index") % len(forms)).cast("int") + 1)
    return i.t("manual_items").where("llm_score IS NOT NULL").select("dataset_path", "sequence_index", "annotation_id", fx.response(text).alias("r"))


query("model_answers", """WITH a AS (SELECT *, sequence_index % 9 AS form FROM manual_items WHERE llm_score IS NOT NULL)
SELECT dataset_path, sequence_index, annotation_id, CASE form WHEN 3 THEN CAST(least(10, round_even(llm_score + 0.5, 0)) AS INT) WHEN 8 THEN 10 ELSE CASE WHEN form < 3 THEN llm_score END END AS score,
 CASE WHEN form IN (0, 1, 2, 3, 8) THEN annotation_id || ' "x"|b' ELSE '' END AS quotes, CASE WHEN form = 1 THEN 'why {so}' END AS thought,
 CASE form WHEN 5 THEN 'no object' WHEN 6 THEN 'field missing' WHEN 7 THEN 'quotes are no list' END AS error FROM a""")(
    lambda i: _answers(i).select("dataset_path", "sequence_index", "annotation_id", c("r.score").alias("score"), F.array_join("r.matches", "|").alias("quotes"), c("r.thought").alias("thought"), c("r.error").alias("error"))
)
query("subset_answers", """SELECT dataset_path, sequence_index, annotation_id, CASE WHEN sequence_index % 4 > 0 THEN llm_score END AS prior, CASE WHEN sequence_index % 4 > 0 THEN 10 END AS uploaded,
 CASE WHEN sequence_index % 4 > 0 THEN CAST(round_even(sequence_index % 7 + 0.5, 0) AS INT) END AS cohesion, CASE WHEN sequence_index % 4 > 0 THEN annotation_id END AS notes,
 CASE WHEN sequence_index % 4 = 0 THEN 'three numbers needed' END AS error FROM manual_items WHERE llm_score IS NOT NULL""")(
    lambda i: i.t("manual_items").where("llm_score IS NOT NULL").withColumn("r", fx.subset_response(F.concat(
        F.lit('<think>t</think>{"prior_conversation_reliance": '), c("llm_score").cast("string"), F.lit(', "uploaded_document_reliance": 12.2, "'),
        F.when(c("sequence_index") % 4 > 0, "cohesion").otherwise("other"), F.lit('": '), (c("sequence_index") % 7).cast("string"), F.lit('.5, "notes": " '), c("annotation_id"), F.lit(' "}'))))
    .select("dataset_path", "sequence_index", "annotation_id", c("r.prior_conversation_reliance").alias("prior"), c("r.uploaded_document_reliance").alias("uploaded"),
            c("r.cohesion").alias("cohesion"), c("r.notes").alias("notes"), c("r.error").alias("error"))
)
query("thought_split", """SELECT row_id, CASE WHEN row_id % 3 = 0 AND trim(source_path) <> '' THEN source_path END AS thought, CASE WHEN row_id % 3 = 0 THEN 'ab' ELSE 'a <think>b' END AS answer FROM messages""")(
    lambda i: i.t("messages").select("row_id", fx.without_thought(F.when(c("row_id") % 3 == 0, F.concat(F.lit(" a<think> "), c("source_path"), F.lit("\n</think>b\n"))).otherwise("a <think>b ")).alias("s"))
    .select("row_id", c("s.thought").alias("thought"), c("s.answer").alias("answer"))
)
_WS = r"[\s\x{0b}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
query("page_breaks", rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(kind || chr(12) || text || chr(13) || chr(10) || chr(12) || chr(13) || source, chr(12), chr(10) || chr(10)), '\r\n?', chr(10), 'g'),
 '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS clean FROM documents""")(
    lambda i: i.t("documents").select("doc_id", fx.normalize_text(F.concat("kind", F.lit("\f"), "text", F.lit("\r\n\f\r"), "source")).alias("clean"))
)
query("pdf_codes", """SELECT doc_id, kind || ' offer (cid:12)' || source || '  in(cid:7)word  end' AS clean FROM documents""")(
    lambda i: i.t("documents").select("doc_id", fx.fix_cids(F.concat("kind", F.lit(" o(cid:431)er (cid:12)"), "source", F.lit(" (cid:3) in(cid:7)word (cid:9) end"))).alias("clean"))
)
query("export_interfaces", """SELECT row_id, CASE row_id % 8 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'chatgpt' WHEN 3 THEN 'claude' WHEN 4 THEN 'claude' WHEN 5 THEN 'gemini' WHEN 6 THEN 'gemini' ELSE 'unknown' END AS interface
 FROM messages WHERE chat_key IS NOT NULL""")(
    lambda i: i.t("messages").where("chat_key IS NOT NULL").select("row_id", fx.interface_of(F.concat(F.element_at(F.array(*[F.lit(x) for x in (
        "Chat History\nChatGPT said: ", "ChatGPT can make mistakes ", "##### **You said:**\nx\n###### **ChatGPT said:**\n", "Human: hi\nAssistant: yes\n", "### User\na\n### Claude\nb ",
        "# You\nhi\n## Gemini\nyes\n", "Gemini says:x ", "I asked ChatGPT, Claude and Gemini about it: ")]), (c("row_id") % 8).cast("int") + 1), c("chat_key"))).alias("interface"))
)
query("age_bins", """SELECT user_id, user_id % 80 AS age, CASE WHEN user_id % 80 < 18 THEN 'under-18' WHEN user_id % 80 < 30 THEN '18-29' WHEN user_id % 80 < 40 THEN '30-39' WHEN user_id % 80 < 50 THEN '40-49' ELSE '50+' END AS bin
 FROM (SELECT DISTINCT user_id FROM events)""")(
    lambda i: i.t("events").select("user_id").distinct().select("user_id", (c("user_id") % 80).alias("age"), fx.age_bin(c("user_id") % 80).alias("bin"))
)
query("rounded_values", "SELECT event_id, CAST(printf('%.3f', value) AS DOUBLE) AS value, CAST(printf('%.3f', event_id / 16.0::DOUBLE) AS DOUBLE) AS sixteenths FROM events WHERE value IS NOT NULL")(
    lambda i: i.t("events").where("value IS NOT NULL").select("event_id", fx.round3(c("value")).alias("value"), fx.round3(c("event_id") / 16).alias("sixteenths"))
)
query("short_labels", """SELECT annotation_id, CASE WHEN annotation_id LIKE 'assistant-%' THEN 'bot-' || substr(annotation_id, 11) ELSE annotation_id END AS label FROM annotations""")(
    lambda i: i.t("annotations").select("annotation_id", fx.short_label(c("annotation_id")).alias("label"))
)
query("opacities", """SELECT "K", "X", "Y", round(CASE WHEN enrichment_K / 40 <= 0 THEN 1 ELSE least(1.0, greatest(0.1, 1 / (1 + exp(-(0.15 - enrichment_K / 40) / 0.05)))) END, 9) AS alpha FROM sequence_pairs""")(
    lambda i: i.t("sequence_pairs").select("K", "X", "Y", F.round(fx.opacity(c("enrichment_K") / 40), 9).alias("alpha"))
)
query("log_enrichment_matrix", """WITH ids AS (SELECT "X" AS id FROM sequence_pairs UNION SELECT "Y" FROM sequence_pairs), ks AS (SELECT DISTINCT "K" FROM sequence_pairs)
SELECT k."K", a.id AS "X", b.id AS "Y", round(CASE WHEN k."K" = 0 AND a.id = b.id THEN 0 WHEN coalesce(p.e, 0) <= 0 THEN 0 ELSE log2(p.e) END, 9) AS value
 FROM ks k, ids a, ids b LEFT JOIN (SELECT "K", "X", "Y", max(enrichment_K) AS e FROM sequence_pairs GROUP BY ALL) p ON p."K" = k."K" AND p."X" = a.id AND p."Y" = b.id""")(
    lambda i: _matrix(i.t("sequence_pairs"))
)


def _matrix(pairs):
    from ..operators import dynamics

    return dynamics.log_matrix(pairs, "K", "X", "Y", "enrichment_K").withColumn("value", F.round("value", 9))


query("json_contents", f"""SELECT {CONV_SQL}, content FROM messages WHERE chat_index IS NOT NULL AND content IS NOT NULL""")(
    lambda i: px.json_contents(
        i.t("messages").where("chat_index IS NOT NULL AND content IS NOT NULL")
        .select(*KEYS[:3], F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("n"), F.struct("content").alias("inner")), F.struct(c("row_id").alias("n"), F.lit(None).cast("struct<content:string>").alias("inner"))).alias("list"))).alias("json")), "json"
    ).select(*KEYS[:3], "content")
)
query("conversation_texts", CTE + f""", t AS (SELECT {KEY_SQL}, role, row_number() OVER (PARTITION BY {CONV_SQL} ORDER BY message_index) AS n FROM msg WHERE participant IS NOT NULL)
SELECT {CONV_SQL}, string_agg(CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END || '. ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE coalesce(nullif(role, ''), 'unknown') END
 || ': said ' || message_index, chr(10) || chr(10) ORDER BY n) AS text FROM t GROUP BY ALL""")(
    lambda i: i.messages.where("participant IS NOT NULL").groupBy(*KEYS[:3]).agg(
        F.array_sort(F.collect_list(F.struct("message_index", "role", F.concat(F.lit("said "), c("message_index").cast("string")).alias("content")))).alias("m")
    ).select(*KEYS[:3], fx.conversation_text(c("m")).alias("text"))
)
query("titles", r"""SELECT source_path, CASE WHEN has_timestamps THEN 'T ' || participant WHEN has_message_indices THEN regexp_extract(source_path, '([^/]+)\.json$', 1) || '.v2' ELSE regexp_extract(source_path, '([^/]+)\.json$', 1) END AS title FROM transcript_files""")(
    lambda i: i.t("transcript_files").select("source_path", fx.title_of(
        F.when(c("has_timestamps"), F.concat(F.lit("T "), c("participant"))).otherwise(" "), c("source_path"),
        F.when(c("has_message_indices"), F.concat(F.regexp_replace("source_path", r"\.json$", ".v2.txt")))).alias("title"))
)
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
query("date_labels", rf"""WITH l AS (SELECT DISTINCT trim("timestamp") AS label FROM messages WHERE "timestamp" IS NOT NULL),
k AS (SELECT label FROM l WHERE regexp_matches(label, '{_ISO}') OR regexp_matches(label, '^\d+(\.\d*)?$') OR regexp_matches(label, '^[^\d]*$'))
SELECT label, CASE WHEN regexp_matches(label, '^\d+(\.\d*)?$') THEN CASE WHEN try_cast(label AS DOUBLE) < 253402300800 THEN CAST(floor(try_cast(label AS DOUBLE)) AS BIGINT) END ELSE CAST(floor(epoch(try_cast(label AS TIMESTAMPTZ))) AS BIGINT) END AS second FROM k""")(
    lambda i: i.t("messages").where("timestamp IS NOT NULL").select(F.trim("timestamp").alias("label")).distinct()
    .where(c("label").rlike(_ISO) | c("label").rlike(r"^\d+(\.\d*)?$") | c("label").rlike(r"^[^\d]*$"))
    .select("label", F.unix_seconds(fx.date_label(c("label"))).alias("second"))
)
query("stated_times", """SELECT row_id, CASE WHEN trim("timestamp") = '' OR try_cast(trim("timestamp") AS DOUBLE) <= 0 THEN NULL ELSE trim("timestamp") END AS label FROM messages""")(
    lambda i: i.t("messages").select("row_id", fx.timestamp_label(c("timestamp")).alias("label"))
)
query("bare_letters", "SELECT doc_id, strip_accents(text) AS bare FROM documents WHERE regexp_full_match(text, '[a-zA-Z0-9 .,;:!?''\"()äöüÄÖÜßáéíóúñàèìòùâêîôûçãõëïÁÉÍÓÚÑ\\n-]*')")(
    lambda i: i.t("documents").where(c("text").rlike("^[a-zA-Z0-9 .,;:!?'\"()äöüÄÖÜßáéíóúñàèìòùâêîôûçãõëïÁÉÍÓÚÑ\\n-]*\\z")).select("doc_id", px.strip_diacritics("text").alias("bare"))
)
query("contact_lists", """SELECT source_path, list_sort([replace(source_path, '/', '.') || '@mail.example', 'Ann of ' || participant, 'Ann', 'of', participant] || [replace(source_path, '/', '.') || '@mail.example' || '!']) AS terms FROM transcript_files""")(
    lambda i: i.t("transcript_files").select("source_path", F.array_sort(fx.contact_terms(F.concat(F.lit(" 7 ;"), F.translate("source_path", "/", "."), F.lit("@mail.example!,\nAnn of "), c("participant"), F.lit(";;Ann")))).alias("terms"))
)
query("chunk_spans", """SELECT doc_id, TRUE AS whole, TRUE AS bounded, TRUE AS joined FROM documents WHERE text <> ''""")(
    lambda i: i.t("documents").where("text <> ''").withColumn("s", px.chunk_spans(c("text"), F.lit(200), F.lit(40))).select(
        "doc_id", (F.array_join(F.transform("s", lambda x: F.substr("text", x["start"] + 1, x["stop"] - x["start"])), "") == c("text")).alias("whole"),
        F.forall("s", lambda x: (x["stop"] - x["start"] <= 200) & (x["stop"] > x["start"])).alias("bounded"),
        (F.element_at("s", -1)["stop"] == F.length("text")).alias("joined"))
)
query("aligned_prefixes", """SELECT row_id, CASE WHEN row_id % 5 = 0 THEN NULL ELSE 12 END AS length FROM messages WHERE content IS NOT NULL""")(
    lambda i: i.t("messages").where("content IS NOT NULL").select("row_id", px.prefix_length(
        F.concat(F.lit("He – “hi”: a "), c("content")), F.when(c("row_id") % 5 == 0, "She").otherwise("He - \"hi\":  a\n")).alias("length"))
)
query("page_margins", """SELECT source_path AS doc, chat_index AS page, string_agg('line ' || message_index, chr(10) ORDER BY message_index) AS text FROM (SELECT DISTINCT source_path, chat_index, message_index FROM preprocessed
 WHERE source_path IN (SELECT source_path FROM preprocessed GROUP BY 1 HAVING count(DISTINCT chat_index) >= 2)) GROUP BY ALL""")(lambda i: _margins(i))


def _margins(i: Inputs):
    """Pages of numbered lines under a head and above a foot that all pages of a file share."""
    lines = i.wide.select("source_path", "chat_index", "message_index").distinct()
    pages = lines.groupBy("source_path", "chat_index").agg(F.array_sort(F.collect_list("message_index")).alias("n"))
    several = lines.groupBy("source_path").agg(F.count_distinct("chat_index").alias("k")).where("k >= 2").select("source_path")
    body = F.array_join(F.transform("n", lambda x: F.concat(F.lit("line "), x.cast("string"))), "\n")
    text = F.concat(F.lit("Head of "), c("source_path"), F.lit("\n"), body, F.lit("\nconfidential"))
    return px.without_margins(pages.join(several, "source_path", "left_semi").select(c("source_path").alias("doc"), c("chat_index").alias("page"), text.alias("text")), "doc", "page", "text").select("doc", "page", "text")
