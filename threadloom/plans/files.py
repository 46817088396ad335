"""Queries over sources and sinks: a table goes out through a sink and comes back through a reader.

What is written lies in the session's shared folder and goes when the JVM ends. The oracle states what
must come back, from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import model, records
from ..runtime import shared_dir
from ..sources import readers, sinks
from .base import CONV_SQL, CTE, KEY_SQL, Inputs
from .records import REC, _records

QUERIES: dict = {}
SQL: dict = {}
KEYS = list(model.KEY)
CONV = KEYS[:3]
c = F.col


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            return fn(Inputs(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def _folder(i: Inputs) -> str:
    """A fresh folder in the shared one, deleted when the JVM ends."""
    path = f"{shared_dir(i.spark).rstrip('/')}/threadloom/files-{uuid.uuid4().hex}"
    jvm = i.spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(i.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def _family(i: Inputs) -> str:
    """Records as two files of a family, each with a header line and lines that are no records."""
    path = _folder(i)
    lines = _records(i).select(F.to_json(F.struct(*KEYS, "role", "annotation_id", "score", "matches", "error")).alias("value"), (F.hash(*KEYS) % 2).alias("half"))
    head = '{"type":"meta","model":"m1","generated_at":"2025-01-01","annotation_ids":["a","b"],"participants":["p","q"],"arguments":{"k":"1"}}'
    other = i.spark.createDataFrame([(head,), ("",), ("{broken",), ("[1, 2]",)], "value string")
    lines.where("half = 0").select("value").unionByName(other).write.text(f"{path}/fam.jsonl")
    lines.where("half <> 0").select("value").unionByName(other.select(F.replace("value", F.lit("m1"), F.lit("m2")).alias("value"))).write.text(f"{path}/fam__part-0001.jsonl")
    i.spark.createDataFrame([("{\"annotation_id\": \"stray\"}",)], "value string").write.text(f"{path}/family2.jsonl")
    return path


query("record_scan", REC + " SELECT annotation_id, count(*) AS rows, count(score) AS scored, round(sum(score), 3) AS total, CAST(sum(len(matches)) AS BIGINT) AS quotes FROM rec GROUP BY annotation_id")(
    lambda i: (lambda p: readers.records(i.spark, readers.family_glob(p, "fam")).groupBy("annotation_id").agg(
        F.count("*").alias("rows"), F.count("score").alias("scored"), F.round(F.sum("score"), 3).alias("total"), F.sum(F.size("matches")).cast("bigint").alias("quotes")))(_family(i))
)
query("record_scan_without_errors", REC + " SELECT annotation_id, count(*) AS rows, count(error) AS quote_errors FROM rec WHERE error IS NULL OR starts_with(error, 'Quoted text not') GROUP BY annotation_id")(
    lambda i: (lambda p: readers.records(i.spark, readers.family_glob(p, "fam"), (fx.QUOTE_ERROR,), True).groupBy("annotation_id").agg(F.count("*").alias("rows"), F.count("error").alias("quote_errors")))(_family(i))
)
query("record_scan_of_each_annotation", REC + f" SELECT {KEY_SQL}, annotation_id, score FROM rec WHERE annotation_id = (SELECT min(annotation_id) FROM annotations)")(
    lambda i: readers.for_annotation(readers.records(i.spark, readers.family_glob(_family(i), "fam")), i.t("annotations").agg(F.min("annotation_id")).first()[0]).select(*KEYS, "annotation_id", "score")
)
query("run_catalogue", "SELECT * FROM (VALUES ('m1', 'a,b', 'p,q', '1'), ('m2', 'a,b', 'p,q', '1')) v(model, annotation_ids, participants, k)")(
    lambda i: readers.select_runs(readers.runs(i.spark, _family(i)), annotation_id="b", participants=["q", "z"]).select(
        "model", F.array_join("annotation_ids", ",").alias("annotation_ids"), F.array_join("participants", ",").alias("participants"), c("arguments")["k"].alias("k"))
)


def _exports(i: Inputs) -> DataFrame:
    """Chats of each source file as one export: a tree with a short side branch and a hidden node, a list of messages, or both kinds of container."""
    m = i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEYS).agg(F.min_by("content", "row_id").alias("content"), F.min("row_id").alias("row_id"))
    said = F.concat(F.lit("said "), c("message_index").cast("string"))
    node = F.struct(
        F.when(c("n") > 0, (c("n") - 1).cast("string")).alias("parent"), F.array((c("n") + 1).cast("string"), F.concat(F.lit("x"), c("n").cast("string"))).alias("children"),
        F.struct(F.struct(F.when(c("n") % 2 == 0, "user").otherwise("assistant").alias("role")).alias("author"), F.struct(F.array(said).alias("parts")).alias("content"),
                 F.struct((c("message_index") + 1000).cast("string").alias("update_time")).alias("metadata")).alias("message"),
    )
    from pyspark.sql import Window

    placed = m.withColumn("n", F.row_number().over(Window.partitionBy(*CONV).orderBy("message_index")) - 1)
    tree = placed.groupBy(*CONV).agg(F.collect_list(F.struct(c("n").cast("string").alias("k"), node.alias("v"))).alias("e"))
    side = F.struct(F.lit("0").alias("parent"), F.array().cast("array<string>").alias("children"), F.struct(
        F.struct(F.lit("user").alias("role")).alias("author"), F.struct(F.array(F.lit("side")).alias("parts")).alias("content"), F.struct(F.lit("1").alias("update_time")).alias("metadata")).alias("message"))
    title = F.concat_ws("|", "source_path", "chat_index")
    return tree.select("source_path", F.struct(title.alias("title"), F.map_from_entries(F.concat("e", F.array(F.struct(F.lit("x0").alias("k"), side.alias("v"))))).alias("mapping")).alias("chat"))


def _export_files(i: Inputs) -> str:
    path = _folder(i)
    texts = _exports(i).groupBy("source_path").agg(F.to_json(F.struct(F.collect_list("chat").alias("conversations"))).alias("value"))
    # One file per source: text is written by folder, one row each.
    texts.select(F.regexp_replace("source_path", "/", "_").alias("file"), "value").write.partitionBy("file").option("compression", "none").format("text").save(path)
    return path


query("export_tree_scan", f"""WITH t AS (SELECT DISTINCT {KEY_SQL} FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY {CONV_SQL} ORDER BY message_index) - 1 AS n, count(*) OVER (PARTITION BY {CONV_SQL}) AS len FROM t)
SELECT source_path || '|' || chat_index AS chat_key, CAST(n AS INT) AS message_index, CASE WHEN n % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'said ' || message_index AS content, CAST(message_index + 1000 AS VARCHAR) AS "timestamp" FROM o WHERE len <> 1
UNION ALL SELECT source_path || '|' || chat_index, 0, 'user', 'said ' || message_index, CAST(message_index + 1000 AS VARCHAR) FROM o WHERE len = 1
UNION ALL SELECT source_path || '|' || chat_index, 1, 'user', 'side', '1' FROM o WHERE len = 1""")(
    lambda i: readers.transcripts(i.spark, _export_files(i), pattern="*.txt").select("chat_key", "message_index", "role", "content", "timestamp")
)
query("export_shapes", "SELECT source_path, 'list of mapping' AS listed, 'conversations' AS held, 'mapping' AS bare, 'other' AS plain FROM (SELECT DISTINCT source_path FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL)")(
    lambda i: _exports(i).groupBy("source_path").agg(F.collect_list("chat").alias("k")).select(
        "source_path", readers.shape_of(F.to_json("k")).alias("listed"), readers.shape_of(F.to_json(F.struct(c("k").alias("conversations")))).alias("held"),
        readers.shape_of(F.to_json(c("k")[0])).alias("bare"), readers.shape_of(F.to_json(F.struct(F.size("k").alias("n")))).alias("plain"))
)
query("file_routes", "SELECT source_path, 'json' AS as_json, 'archive' AS as_zip, 'skip' AS as_pdf, 'text' AS as_md FROM transcript_files")(
    lambda i: i.t("transcript_files").select("source_path", readers.route_of(c("source_path")).alias("as_json"), *[
        readers.route_of(F.regexp_replace("source_path", "json$", e)).alias(f"as_{n}") for n, e in (("zip", "ZIP"), ("pdf", "pdf"), ("md", "md"))])
)
query("plain_texts", """SELECT doc_id, kind || chr(10) || 'a < b & "c"' AS html, kind || chr(10) || chr(10) || coalesce(source, '') || '.' AS md FROM documents""")(
    lambda i: i.t("documents").select(
        "doc_id", readers.plain_text(F.encode(F.concat(F.lit("<html><script>x = '<p>'</script><p class='k'>"), "kind", F.lit("</p><b>a &lt; b</b> &amp; &quot;c&quot;\r\n</html>")), "UTF-8"), F.lit("x/a.html")).alias("html"),
        readers.plain_text(F.encode(F.concat("kind", F.lit("\f"), F.coalesce("source", F.lit("")), F.lit(".\r\n")), "UTF-8"), F.lit("x/a.md")).alias("md"))
)
query("archives", """SELECT source_path AS archive, unnest(['a.txt', 'deep.zip!b.txt']) AS member, unnest([participant, coalesce(ordering_type, '')]) AS content FROM transcript_files""")(
    lambda i: readers.members(_zipped(i)).select("archive", "member", F.decode("content", "UTF-8").alias("content"))
)


def _zipped(i: Inputs) -> DataFrame:
    def run(batches):
        import io
        import zipfile

        import pandas as pd

        def pack(*members):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for name, data in members:
                    z.writestr(name, data)
            return out.getvalue()

        for b in batches:
            blobs = [pack(("a.txt", p), ("deep.zip", pack(("b.txt", o or ""))), ("folder/", "")) for p, o in zip(b["participant"], b["ordering_type"])]
            yield pd.DataFrame({"path": [*b["source_path"], *["broken"] * len(b)], "content": [*blobs, *[b"no archive"] * len(b)]})

    return i.t("transcript_files").select("source_path", "participant", "ordering_type").mapInPandas(run, "path string, content binary")


query("embedded_exports", """SELECT source_path, '{"p": "' || participant || '", "x": [1, {"y": "]}"}]}' AS json FROM transcript_files""")(
    lambda i: readers.embedded_json(i.t("transcript_files").select("source_path", F.concat(F.lit("<html>\n<script>var jsonData = {\"p\": \""), "participant", F.lit("\", \"x\": [1, {\"y\": \"]}\"}]};\nvar y = {};</script>")).alias("html"))).select("source_path", "json")
)
_TURNS = CTE + f""", s AS (SELECT {KEY_SQL}, role, lag(role) OVER w AS before, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {CONV_SQL}) AS len FROM msg WHERE role IS NOT NULL WINDOW w AS (PARTITION BY {CONV_SQL} ORDER BY message_index)),
g AS (SELECT {CONV_SQL} FROM s GROUP BY ALL HAVING count(*) >= 2 AND max(role) FILTER (rn = 1) = 'user' AND count(*) FILTER (rn > 1 AND role = before) = 0 AND count(*) FILTER (role NOT IN ('user', 'assistant')) = 0)
SELECT {CONV_SQL}, CAST(rn - 1 AS INT) AS message_index, role, 'line ' || message_index || chr(10) || 'more: of it' AS content FROM s SEMI JOIN g USING ({CONV_SQL})"""


def _turn_texts(i: Inputs, label) -> DataFrame:
    """Conversations as one text each, a label before each turn."""
    m = i.messages.where("role IS NOT NULL AND participant IS NOT NULL").where(c("chat_index").isNotNull())
    turn = F.concat(label(c("role")), F.lit("line "), c("message_index").cast("string"), F.lit("\r\nmore: of it"))
    texts = m.groupBy(*CONV).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", turn.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return texts.select(F.to_json(F.struct(*CONV)).alias("doc_id"), "text")


def _turns_back(df: DataFrame) -> DataFrame:
    k = F.from_json("doc_id", "participant string, source_path string, chat_index int")
    return df.withColumn("k", k).select("k.*", "message_index", "role", "content")


query("labelled_turns", _TURNS)(
    lambda i: _turns_back(readers.labelled_turns(_turn_texts(i, lambda r: F.when(r == "user", "Me : ").when(r == "assistant", "  BOT - ").otherwise("Me: ")), labels=("Me", "Bot")))
    .join(_plain_roles(i), CONV, "left_semi")
)
query("heading_turns", _TURNS)(
    lambda i: _turns_back(readers.heading_turns(_turn_texts(i, lambda r: F.when(r == "user", "##### **You said:**\n").when(r == "assistant", "###### **ChatGPT said:**\n").otherwise("User\n"))))
    .join(_plain_roles(i), CONV, "left_semi")
)


def _plain_roles(i: Inputs) -> DataFrame:
    """Conversations of user and assistant only."""
    return i.messages.where("role IS NOT NULL").groupBy(*CONV).agg(F.min(c("role").isin("user", "assistant")).alias("ok")).where("ok").select(*CONV)


query("annotation_specs", "SELECT annotation_id, category, array_to_string(scope, ',') AS scope, is_harmful FROM annotations")(lambda i: _specs(i))


def _specs(i: Inputs) -> DataFrame:
    path = _folder(i)
    sheet = i.t("annotations").select(c("annotation_id").alias("id"), "category", F.array_join("scope", "; ").alias("scope"), F.when(c("is_harmful"), "Yes").otherwise("").alias("Harmful (by itself)?"), F.lit('two\nlines, "quoted"').alias("description"))
    sinks.csv(sheet, path)
    return readers.annotation_specs(i.spark, path).withColumn("scope", F.array_join("scope", ","))


query("cutoff_payload", "SELECT annotation_id, cutoff FROM cutoffs")(lambda i: _cutoffs(i))


def _cutoffs(i: Inputs) -> DataFrame:
    path = _folder(i)
    entries = F.map_from_entries(F.collect_list(F.struct("annotation_id", "cutoff")))
    i.t("cutoffs").select("annotation_id", c("cutoff").cast("string").alias("cutoff")).unionByName(i.spark.createDataFrame([("none", "x")], "annotation_id string, cutoff string")).agg(
        F.to_json(F.struct(F.lit(1).alias("version"), entries.alias("llm_score_cutoffs_by_annotation"))).alias("value")
    ).write.text(path)
    return readers.cutoffs(i.spark, path)


query("ordering_payload", "SELECT participant, max(ordering_type) AS ordering_type FROM transcript_files GROUP BY participant")(lambda i: _orderings(i))


def _orderings(i: Inputs) -> DataFrame:
    path = _folder(i)
    per = i.t("transcript_files").groupBy("participant").agg(F.max("ordering_type").alias("ordering_type"))
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("participant", F.struct("ordering_type", F.lit(True).alias("has_timestamps")))))).alias("value")).write.text(path)
    return readers.orderings(i.spark, path)


#: People made of participants: some without age, some without gender.
_PEOPLE = """p0 AS (SELECT DISTINCT participant, CAST(regexp_extract(participant, '(\\d+)$', 1) AS INT) AS n FROM transcript_files),
people AS (SELECT participant, CASE WHEN n % 5 > 0 THEN 16 + n % 50 END AS age, CASE n % 4 WHEN 0 THEN 'Woman' WHEN 1 THEN 'Man' WHEN 2 THEN 'Non-binary' END AS gender FROM p0)"""


def _people(i: Inputs) -> DataFrame:
    """The surveys, written as one CSV, turned into one JSON text per participant and read from these."""
    path, back = _folder(i), _folder(i)
    who = i.t("transcript_files").select("participant").distinct().withColumn("n", F.regexp_extract("participant", r"(\d+)$", 1).cast("int"))
    sheet = who.select(
        F.concat(F.lit("R_"), c("n").cast("string")).alias("response_id"), F.when(c("n") % 5 > 0, (16 + c("n") % 50).cast("string")).otherwise("n, a").alias("age"),
        F.when(c("n") % 4 == 0, "Woman").when(c("n") % 4 == 1, "Man").when(c("n") % 4 == 2, "Non-binary").alias("gender"),
    )
    sinks.csv(sheet, path)
    answers = readers.survey_rows(i.spark, path, who.select(F.concat(F.lit("R_"), c("n").cast("string")).alias("response_id"), "participant"))
    answers.select(c("answers").alias("value"), "participant").write.partitionBy("participant").text(back)
    return readers.surveys(i.spark, back, pattern="*.txt", participant=r"participant=([^/]+)/")


query("survey_scan", "WITH " + _PEOPLE + " SELECT participant, age, gender FROM people")(_people)
query("demographics", "WITH " + _PEOPLE + """, g AS (SELECT gender, count(*) AS n FROM people WHERE gender IS NOT NULL GROUP BY 1), a AS (SELECT count(age)::DOUBLE AS count, min(age)::DOUBLE AS min, max(age)::DOUBLE AS max, avg(age) AS mean, median(age) AS median FROM people)
SELECT 'age' AS topic, measure, round(value, 6) AS value FROM (UNPIVOT a ON * INTO NAME measure VALUE value) WHERE value IS NOT NULL
UNION ALL SELECT 'gender', gender || ' count', n FROM g UNION ALL SELECT 'gender', gender || ' percentage', round(100 * n / (SELECT sum(n) FROM g), 6) FROM g""")(
    lambda i: records.demographics(_people(i)).withColumn("value", F.round("value", 6))
)
query("stats_with_demographics", "WITH " + _PEOPLE + f""", s AS (SELECT participant, count(DISTINCT ({KEY_SQL})) AS messages FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY 1)
SELECT participant, messages, age, gender FROM s LEFT JOIN people USING (participant)""")(
    lambda i: i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy("participant").agg(F.count_distinct(*KEYS).alias("messages")).join(_people(i), "participant", "left").select("participant", "messages", "age", "gender")
)
query("match_table_scan", CTE + f""" SELECT {KEY_SQL}, annotation_id, score, 'say "x", y' AS first FROM scored WHERE is_pos""")(lambda i: _matches(i))


def _matches(i: Inputs) -> DataFrame:
    path = _folder(i)
    sinks.csv(i.scored.where("is_pos").select(*KEYS, "annotation_id", c("score").cast("string").alias("score"), F.to_json(F.array(F.lit('say "x", y'), F.lit("b"))).alias("matches")), path)
    return readers.matches(i.spark, path, "csv").select(*KEYS, "annotation_id", "score", c("matches")[0].alias("first"))


query("point_lookup", f"SELECT DISTINCT {KEY_SQL}, role FROM preprocessed WHERE ({KEY_SQL}) = (SELECT ({KEY_SQL}) FROM preprocessed ORDER BY {KEY_SQL} LIMIT 1)")(
    lambda i: readers.point_lookup(i.spark, f"{i.dir}/preprocessed.parquet", **i.wide.select(*KEYS).orderBy(*KEYS).limit(1).first().asDict()).select(*KEYS, "role").distinct()
)
query("parse_plan", "SELECT source_path, ordering_type AS method, coalesce(has_timestamps, false) AS skip FROM transcript_files")(lambda i: _plan(i))


def _plan(i: Inputs) -> DataFrame:
    path = _folder(i)
    sinks.csv(i.t("transcript_files").select("source_path", c("ordering_type").alias("method"), F.when(c("has_timestamps"), " Yes").otherwise("").alias("skip")), path)
    return readers.plan(i.spark, path).select("source_path", "method", "skip")


query("manual_item_scan", "SELECT sequence_index, participant, annotation_id, source_path, chat_index, message_index FROM manual_items WHERE sequence_index IS NOT NULL AND participant IS NOT NULL")(lambda i: _items(i))


def _items(i: Inputs) -> DataFrame:
    path = _folder(i)
    item = i.t("manual_items").withColumn("type", F.lit("item"))
    sinks.jsonl(item.unionByName(item.limit(3).withColumn("type", F.lit("meta"))).unionByName(item.limit(3).withColumn("participant", F.lit(None).cast("string"))), path, 500)
    return readers.manual_items(i.spark, path).drop("dataset_path")


query("subset_score_scan", """SELECT sequence_index AS row, arg_max(label, (labelled_at, label_id)) AS label, arg_max(CAST(label_id % 11 AS INT), (labelled_at, label_id)) AS prior, TRUE AS whole FROM manual_labels WHERE label IS NOT NULL AND labelled_at IS NOT NULL GROUP BY 1""")(
    lambda i: _subset_scores(i)
)


def _subset_scores(i: Inputs) -> DataFrame:
    """Scores written line by line; of a row's lines the last holds."""
    path = _folder(i)
    line = F.unix_seconds(c("labelled_at").cast("timestamp")) * 1_000_000 + c("label_id")
    rows = i.t("manual_labels").where("label IS NOT NULL AND labelled_at IS NOT NULL").select(
        F.lit("subset").alias("type"), c("sequence_index").alias("row"), "label", line.alias("line"), (c("label_id") % 11).cast("int").alias("prior_conversation_reliance"),
        F.lit(1).alias("uploaded_document_reliance"), F.lit(2).alias("cohesion"), F.lit("n").alias("notes"))
    sinks.jsonl(rows, path)
    return readers.subset_scores(i.spark, path).select("row", "label", c("prior_conversation_reliance").alias("prior"), ((c("cohesion") == 2) & (c("notes") == "n")).alias("whole"))


query("manifest_scan", """SELECT CASE WHEN sequence_index % 2 = 0 THEN 'even' ELSE 'odd' END AS manifest, count(*) AS tasks, count(*) FILTER (llm_score IS NOT NULL) AS written, count(*) FILTER (llm_score IS NULL) AS open FROM manual_items GROUP BY 1""")(
    lambda i: _manifests(i)
)


def _manifests(i: Inputs) -> DataFrame:
    path = _folder(i)
    tasks = i.t("manual_items").select("sequence_index", fx.encode_id(*[c(k) for k in KEYS], c("annotation_id")).alias("custom_id"), c("llm_score").isNotNull().alias("written"))
    for n, name in enumerate(("even", "odd")):
        sinks.manifest(tasks.where(c("sequence_index") % 2 == n).drop("sequence_index"), f"{path}/{name}", status="open")
    return records.pending(readers.manifests(i.spark, path).where("status = 'open'"))


query("transcript_tables", f"SELECT row_id, participant, source_path, chat_index, message_index, content, TRUE AS in_index FROM messages WHERE content IS NOT NULL")(lambda i: _tables(i))


def _tables(i: Inputs) -> DataFrame:
    path = _folder(i)
    sinks.transcript_tables(i.t("messages").where("content IS NOT NULL"), path)
    index = i.spark.read.parquet(f"{path}/index")
    assert "content" not in index.columns
    return i.spark.read.parquet(f"{path}/full").select("row_id", *KEYS, "content").join(index.select("row_id", F.lit(True).alias("in_index")), "row_id", "left")


query("csv_round_trip", "SELECT doc_id, nullif(text, '') AS text, round(n_chars / 7.0, 3) AS value FROM documents WHERE NOT contains(text, chr(13)) AND NOT contains(text, chr(92)) AND NOT contains(text, chr(0)) AND text NOT LIKE '%\"'")(lambda i: _csv(i))


def _csv(i: Inputs) -> DataFrame:
    path = _folder(i)
    docs = i.t("documents").where("NOT contains(text, '\\r') AND NOT contains(text, '\\\\') AND NOT contains(text, '\\0') AND text NOT LIKE '%\"'")
    sinks.csv(docs.select("doc_id", "text", (c("n_chars") / 7).alias("value")), path, 3)
    back = i.spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return back.select(c("doc_id").cast("bigint").alias("doc_id"), "text", F.replace("value", F.lit(","), F.lit("")).cast("double").alias("value"))


query("csv_by_transcript", "SELECT participant, source_path, count(*) AS n, CAST(sum(message_index) AS BIGINT) AS places FROM messages WHERE message_index IS NOT NULL GROUP BY ALL")(lambda i: _per_file(i))


def _per_file(i: Inputs) -> DataFrame:
    path = _folder(i)
    sinks.csv_by_transcript(i.t("messages").where("message_index IS NOT NULL").select("participant", "source_path", "message_index", "role"), path)
    return i.spark.read.option("header", True).csv(path).groupBy("participant", "source_path").agg(F.count("*").alias("n"), F.sum(c("message_index").cast("bigint")).alias("places"))


query("metrics_payload", "SELECT annotation_id, cutoff FROM cutoffs")(
    lambda i: sinks.metrics(i.t("cutoffs")).select(F.explode(F.from_json("payload", "map<string,struct<cutoff:int>>")).alias("annotation_id", "v")).select("annotation_id", c("v.cutoff").alias("cutoff"))
)
query("case_lines", "SELECT sequence_index, dataset_path, annotation_id, count(DISTINCT annotator) AS raters FROM manual_labels WHERE label IS NOT NULL GROUP BY ALL")(
    lambda i: sinks.cases(i.t("manual_labels").where("label IS NOT NULL").groupBy("dataset_path", "sequence_index", "annotation_id", "annotator").agg(F.max("label").alias("label")), ["dataset_path", "sequence_index", "annotation_id"])
    .select(F.from_json("value", "dataset_path string, sequence_index int, annotation_id string, labels map<string,string>").alias("v")).select("v.dataset_path", "v.sequence_index", "v.annotation_id", F.size("v.labels").cast("bigint").alias("raters"))
)
query("flattened_records", REC + f""" SELECT {KEY_SQL}, annotation_id, len(matches) AS quotes FROM rec""")(lambda i: _flat(i))


def _flat(i: Inputs) -> DataFrame:
    path = _folder(i)
    sinks.csv(sinks.flattened(_records(i).select(*KEYS, "annotation_id", "matches")), path)
    back = i.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("participant", "source_path", c("chat_index").cast("int").alias("chat_index"), c("message_index").cast("int").alias("message_index"), "annotation_id", F.size(F.from_json("matches", "array<string>")).cast("bigint").alias("quotes"))


query("nearest_messages")(lambda i: _nearest(i))


def _nearest(i: Inputs) -> DataFrame:
    """For the first message of each conversation, with a word put in, the message it was made from."""
    from ..functions.python import nearest_message

    t = i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEYS).agg(F.min_by("content", "row_id").alias("content")).where("length(content) BETWEEN 40 AND 400")
    first = t.groupBy(*CONV).agg(F.min_by("content", "message_index").alias("content"))
    quotes = first.select(*CONV, F.concat(F.substring("content", 1, 20), F.lit(" indeed "), F.substr("content", F.lit(21))).alias("quote"))
    return nearest_message(t, quotes, CONV).select(*CONV, "message_index")


SQL["nearest_messages"] = f"""WITH t AS (SELECT {KEY_SQL}, arg_min_null(content, row_id) AS content FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL)
SELECT {CONV_SQL}, min(message_index) AS message_index FROM t WHERE length(content) BETWEEN 40 AND 400 GROUP BY ALL"""


query("html_pages", f"""WITH t AS (SELECT {KEY_SQL}, arg_min_null(role, row_id) AS role, arg_min_null(content, row_id) AS content FROM messages WHERE chat_index IS NOT NULL AND message_index IS NOT NULL GROUP BY ALL),
c AS (SELECT source_path, chat_index, string_agg('<p><b>' || coalesce(role, 'unknown') || '</b>: ' || coalesce(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '') || '</p>', '' ORDER BY message_index) AS t FROM t GROUP BY ALL)
SELECT source_path, '<html>' || string_agg('<h2 id=' || chr(39) || 'chat-' || (chat_index + 1) || chr(39) || '></h2>' || t, '' ORDER BY chat_index) || '</html>' AS page FROM c GROUP BY source_path""")(lambda i: _pages(i))


def _pages(i: Inputs) -> DataFrame:
    path = _folder(i)
    m = i.t("messages").where("chat_index IS NOT NULL AND message_index IS NOT NULL").groupBy(*KEYS).agg(F.min_by("role", "row_id").alias("role"), F.min_by("content", "row_id").alias("content"))
    sinks.pages(m.drop("participant"), path, ["source_path"], "message_index")
    return i.spark.read.text(path, wholetext=True).select("source_path", F.regexp_replace("value", "\\n\\z", "").alias("page"))


query("latex_table", """SELECT '\\begin{tabular}{ll}' || chr(10) || 'annotation\\_id & cutoff \\\\' || chr(10) || string_agg(annotation_id || ' & ' || cutoff || ' \\\\', chr(10) ORDER BY annotation_id) || chr(10) || '\\end{tabular}' AS tex FROM cutoffs""")(
    lambda i: sinks.latex_table(i.t("cutoffs").select("annotation_id", "cutoff"), ["annotation_id"])
)
