"""Sources: tolerant readers for transcripts, label records, specs, surveys and plans.

Readers take paths (files, folders or globs) that Spark can list; nothing is read on the driver but
small specification files whose size is a parameter of the call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TIME_KEYS

RECORD = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("participant", T.StringType()), T.StructField("ppt_id", T.StringType()),
    T.StructField("source_path", T.StringType()), T.StructField("chat_index", T.IntegerType()), T.StructField("message_index", T.IntegerType()),
    T.StructField("role", T.StringType()), T.StructField("annotation_id", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("matches", T.ArrayType(T.StringType())), T.StructField("model", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("chat_key", T.StringType()), T.StructField("chat_date", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])
CHAT = "key string, date_label string, messages array<struct<role:string,content:string,timestamp:string>>"


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = RECORD) -> DataFrame:
    """Objects of JSON lines; blank, malformed and non-object lines are dropped."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    # A projection that keeps the corrupt-record column stops Spark from refusing the filter.
    return rows.withColumn("_file", F.col("_metadata.file_path")).where("_bad IS NULL").drop("_bad")


def records(spark: SparkSession, path: str | list[str], allowed_errors: tuple[str, ...] = (), drop_errors: bool = False) -> DataFrame:
    """Label records without header lines, optionally without rows whose error has no allowed prefix."""
    rows = jsonl(spark, path).where("coalesce(type, '') <> 'meta'")
    if drop_errors:
        fine = F.col("error").isNull() | (F.col("error") == "")
        for prefix in allowed_errors:
            fine = fine | F.startswith("error", F.lit(prefix))
        rows = rows.where(fine)
    return rows


def for_annotation(rows: DataFrame, annotation_id: str) -> DataFrame:
    """Records of one annotation."""
    return rows.where(F.col("annotation_id") == annotation_id)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run headers: model, participants, annotation ids, arguments."""
    schema = "type string, generated_at string, model string, participants array<string>, annotation_ids array<string>, arguments map<string,string>"
    return jsonl(spark, path, T._parse_datatype_string(schema)).where("type = 'meta'").drop("type")


def select_runs(catalogue: DataFrame, model: str | None = None, annotation_id: str | None = None, participants: list[str] | None = None) -> DataFrame:
    """Runs by model, annotation membership and participant overlap."""
    out = catalogue
    if model:
        out = out.where(F.col("model") == model)
    if annotation_id:
        out = out.where(F.array_contains("annotation_ids", annotation_id))
    if participants:
        out = out.where(F.arrays_overlap("participants", F.array(*[F.lit(p) for p in participants])))
    return out


def family_glob(root: str, stem: str) -> list[str]:
    """Path patterns of a record family: the stem's file and its numbered parts."""
    return [f"{root.rstrip('/')}/{stem}.jsonl", f"{root.rstrip('/')}/{stem}__part-[0-9][0-9][0-9][0-9].jsonl"]


def best_timestamp(candidate: object) -> str | None:
    """The first usable time of a message or chat by ``TIME_KEYS``, else that of its metadata, at any depth."""
    while isinstance(candidate, dict):
        for key in TIME_KEYS:
            value = candidate.get(key)
            if isinstance(value, str) and value.strip():
                return value.strip()
            if isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0:
                return str(value)
        candidate = candidate.get("metadata")
    return None


def _text_of(message: dict) -> str:
    content = message.get("content") or {}
    if isinstance(content, str):
        return content
    parts = content.get("parts")
    if isinstance(parts, list):
        texts = [p if isinstance(p, str) else (p or {}).get("text") or "" for p in parts]
        return "\n".join(t for t in texts if t)
    return content.get("text") or ""


def _visible(message: dict | None) -> bool:
    if not message:
        return False
    role = ((message.get("author") or {}).get("role") or "").lower()
    hidden = (message.get("metadata") or {}).get("is_visually_hidden_from_conversation")
    return role in ("user", "assistant") and not hidden and bool(_text_of(message).strip())


def linearise(mapping: dict, current: str | None = None, strategy: str = "longest") -> list[dict]:
    """Messages of one path of an export tree: the one with most visible turns, or that of ``current``.

    Iterative and safe against cycles: every node is entered once.
    """
    children: dict[str | None, list[str]] = {}
    for key, node in mapping.items():
        parent = node.get("parent")
        children.setdefault(parent if parent in mapping else None, []).append(key)
    for key, node in mapping.items():
        stated = [c for c in node.get("children") or [] if c in mapping]
        order = {c: n for n, c in enumerate(stated)}
        if key in children:
            children[key].sort(key=lambda c: order.get(c, len(order)))
    best: tuple[int, int] | None = None
    leaf = None
    parent_of: dict[str, str | None] = {}
    stack = [(root, None, 0, 0) for root in reversed(children.get(None, []))]
    while stack:
        key, parent, score, depth = stack.pop()
        if key in parent_of:
            continue
        parent_of[key] = parent
        score += _visible(mapping[key].get("message"))
        below = children.get(key, [])
        rank = (score, 0) if strategy == "longest" else (depth, 0)
        if not below and (best is None or rank > best):
            best, leaf = rank, key
        stack += [(c, key, score, depth + 1) for c in reversed(below)]
    if strategy == "current" and current in parent_of:
        leaf = current
    path = []
    while leaf is not None:
        path.append(leaf)
        leaf = parent_of.get(leaf)
    out = []
    for key in reversed(path):
        message = mapping[key].get("message")
        if _visible(message):
            out.append({"role": message["author"]["role"].lower(), "content": _text_of(message), "timestamp": best_timestamp(message)})
    return out


def _chats(text: str, strategy: str) -> list[dict]:
    """Chats of one transcript file in any of three shapes; [] for what cannot be read."""
    try:
        data = json.loads(text.lstrip("﻿"))
    except ValueError:
        try:  # a cut-off file: what precedes the last closed bracket
            data, _ = json.JSONDecoder().raw_decode(text.strip())
        except ValueError:
            return []
    found = data if isinstance(data, list) else data.get("conversations") if isinstance(data, dict) and isinstance(data.get("conversations"), list) else [data]
    out = []
    for chat in found:
        if not isinstance(chat, dict):
            continue
        if isinstance(chat.get("mapping"), dict):
            messages = linearise(chat["mapping"], chat.get("current_node"), strategy)
        else:
            messages = []
            for m in chat.get("messages") or []:
                if isinstance(m, dict):
                    content = m.get("content")
                    stamp = best_timestamp(m)
                    content = content if isinstance(content, str) or content is None else json.dumps(content, ensure_ascii=False)
                    messages.append({"role": str(m.get("role") or "unknown").lower(), "content": content, "timestamp": stamp})
        out.append({"key": chat.get("title") or chat.get("key"), "date_label": chat.get("date_label") or best_timestamp(chat), "messages": messages})
    return out


def transcripts(spark: SparkSession, root: str, strategy: str = "longest", pattern: str = "*.json") -> DataFrame:
    """Rows of all transcript files below a folder: key columns, role, content, labels.

    message_index is the place before blank messages are dropped, so gaps are possible. Files are read
    whole by the executors; order never depends on the listing.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True).withColumn("path", F.col("_metadata.file_path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, c["key"], c["date_label"], k, m["role"], m["timestamp"], m["content"])
                    for p, text in zip(b["path"], b["value"]) for n, c in enumerate(_chats(text, strategy)) for k, m in enumerate(c["messages"])]
            yield pd.DataFrame(rows, columns=["path", "chat_index", "chat_key", "chat_date", "message_index", "role", "timestamp", "content"])

    parsed = files.select("path", "value").mapInPandas(
        run, "path string, chat_index int, chat_key string, chat_date string, message_index int, role string, timestamp string, content string"
    )
    inside = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    return parsed.where("trim(content) <> ''").select(
        F.split(inside, "/")[0].alias("participant"), inside.alias("source_path"), "chat_index", "message_index", "role", "timestamp", "chat_key", "chat_date", "content"
    )


def annotation_specs(spark: SparkSession, path: str) -> DataFrame:
    """annotation_id, category, scope, is_harmful of a specification CSV (S15, S16); the harm column by its name's start."""
    from ..operators.model import scope_list

    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    harm = next((c for c in raw.columns if c.strip().lower().startswith("harmful")), None)
    flag: Column = F.lower(F.trim(F.coalesce(F.col(f"`{harm}`"), F.lit("")))).isin("yes", "true", "1", "y", "x") if harm else F.lit(False)
    return raw.where("trim(id) <> ''").select(F.trim("id").alias("annotation_id"), "category", scope_list(F.coalesce("scope", F.lit(""))).alias("scope"), flag.alias("is_harmful"))


def cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """annotation_id, cutoff of a flat map or a metrics payload; values that are no integers are skipped."""
    text = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.llm_score_cutoffs_by_annotation")
    pairs = F.from_json(F.coalesce(inner, F.col("value")), "map<string,string>")
    return text.select(F.explode(pairs).alias("annotation_id", "v")).select("annotation_id", F.expr("try_cast(v AS INT)").alias("cutoff")).where("cutoff IS NOT NULL")


def orderings(spark: SparkSession, path: str) -> DataFrame:
    """participant, ordering_type of an ordering file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,struct<ordering_type:string>>")).alias("participant", "o")).select("participant", F.col("o.ordering_type").alias("ordering_type"))


def surveys(spark: SparkSession, path: str, age: str = "age", gender: str = "gender", pattern: str = "*.json", participant: str = r"([^/]+)\.json$") -> DataFrame:
    """participant (by the file's path, its stem if not told otherwise), age, gender of one JSON object per file."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return text.select(
        F.regexp_extract(F.col("_metadata.file_path"), participant, 1).alias("participant"),
        F.expr(f"try_cast(get_json_object(value, '$.{age}') AS INT)").alias("age"), F.get_json_object("value", f"$.{gender}").alias("gender"),
    )


def matches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Match rows; indices -1 where they are none, quotes as an array."""
    from ..operators.model import coerced_index

    raw = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.withColumns({
        "chat_index": coerced_index("chat_index"), "message_index": coerced_index("message_index"), "score": F.expr("try_cast(score AS DOUBLE)"),
        "matches": F.coalesce(F.from_json(F.col("matches").cast("string"), "array<string>"), F.array().cast("array<string>")),
    })


def plan(spark: SparkSession, path: str) -> DataFrame:
    """Parse-plan rows."""
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumn("skip", F.lower(F.trim(F.coalesce("skip", F.lit("")))).isin("1", "true", "yes", "x")) if "skip" in raw.columns else raw


def manual_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a manual dataset with a full key."""
    schema = T._parse_datatype_string("type string, sequence_index int, participant string, annotation_id string, source_path string, chat_index int, message_index int")
    return jsonl(spark, path, schema).where("type = 'item' AND sequence_index IS NOT NULL AND participant IS NOT NULL").withColumnRenamed("_file", "dataset_path").drop("type")


def point_lookup(spark: SparkSession, path: str, **key) -> DataFrame:
    """Rows of a parquet table at one location (S14); the equality filters reach the scan."""
    df = spark.read.parquet(path)
    for name, value in key.items():
        df = df.where(F.col(name) == value)
    return df


def embedded_json(df: DataFrame, html: str = "html", marker: str = "jsonData") -> DataFrame:
    """The bracket-matched JSON value assigned to ``marker`` in HTML, null where there is none."""

    @F.pandas_udf("string")
    def blob(texts: pd.Series) -> pd.Series:
        def one(text):
            at = text.find(marker) if isinstance(text, str) else -1
            starts = [i for i in (text.find("[", at), text.find("{", at)) if i >= 0] if at >= 0 else []
            if not starts:
                return None
            try:
                _, end = json.JSONDecoder().raw_decode(text, min(starts))
            except ValueError:
                return None
            return text[min(starts) : end]

        return texts.map(one)

    return df.withColumn("json", blob(F.col(html)))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of every member of the ZIP archives below a folder."""
    return members(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path))


def members(archives: DataFrame) -> DataFrame:
    """(archive, member, content) of every member of ZIP archives in (path, content), nested ones included; broken archives have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"]):
                stack = [("", data)]
                while stack:
                    prefix, blob = stack.pop()
                    try:
                        z = zipfile.ZipFile(io.BytesIO(blob))
                    except zipfile.BadZipFile:
                        continue
                    for name in sorted(z.namelist()):
                        if name.endswith("/"):
                            continue
                        inner = z.read(name)
                        if name.lower().endswith(".zip"):
                            stack.append((prefix + name + "!", inner))
                        else:
                            rows.append((p, prefix + name, inner))
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def _alternate(turns: list[tuple[str, str]], strict: bool) -> list[tuple[str, str]]:
    """The turns if they make a conversation, else none: two at least, and strictly user and assistant in turn from the user on."""
    roles = [r for r, _ in turns]
    fine = all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) if strict else {"user", "assistant"} <= set(roles)
    return turns if len(turns) >= 2 and fine else []


def label_turns(text: str, labels: tuple[str, ...], strict: bool = True) -> list[tuple[str, str]]:
    """(role, content) of lines that begin with a label and a colon or dash (F24); the first label is the user's."""
    names = "|".join(re.escape(x.strip()) for x in labels)
    marks = list(re.finditer(rf"^[ \t]*[*#]*[ \t]*({names})[*]*[ \t]*[:-][ \t]*[*]*", _lines(text), re.I | re.M))
    ends = [m.start() for m in marks[1:]] + [None]
    body = _lines(text)
    turns = [("user" if m[1].lower() == labels[0].strip().lower() else "assistant", body[m.end() : e].strip()) for m, e in zip(marks, ends)]
    return _alternate(turns, strict) if strict else turns if len(turns) >= 2 else []


_HEADING = re.compile(r"^(?:[ \t]*#{1,6}[ \t]*)?(?:\*\*)?[ \t]*(?:(you said|chatgpt said)[ \t]*:|(user|chatgpt)[ \t]*:?)[ \t]*(?:\*\*)?[ \t]*$", re.I | re.M)
_INLINE = re.compile(r"\b(you\s+said|chatgpt\s+said)\s*:\s*", re.I)


def markdown_turns(text: str, strict: bool = True) -> list[tuple[str, str]]:
    """(role, content) of an export with headings of its two speakers, or with their names inside paragraphs."""
    body = _lines(text)
    heads = [(m.start(), m.end(), m[1] or m[2]) for m in _HEADING.finditer(body)]
    inside = [(m.start(), m.end(), m[1]) for m in _INLINE.finditer(body)]
    if len(heads) < 2 and not inside:
        return []
    marks = sorted({m[0]: m for m in (heads + inside if len(heads) >= 2 else inside)}.values())
    # A heading's own words are an inline mark, too: marks that begin within another are part of it.
    kept = []
    for m in marks:
        if not kept or m[0] >= kept[-1][1]:
            kept.append(m)
    turns = [("user" if who.lower().startswith(("you", "user")) else "assistant", body[end:stop].strip(" \t\n*")) for (_, end, who), stop in zip(kept, [m[0] for m in kept[1:]] + [None])]
    preface = body[: kept[0][0]].strip(" \t\n*#")
    if turns[0][0] == "assistant" and preface:
        turns.insert(0, ("user", preface))
    return _alternate(turns, strict)


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _parsed(df: DataFrame, text: str, doc_id: str, parse: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, role, content) for d, t in zip(b[doc_id], b[text]) if isinstance(t, str) for n, (role, content) in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=[doc_id, "message_index", "role", "content"])

    return df.select(doc_id, text).mapInPandas(run, f"`{doc_id}` {dict(df.dtypes)[doc_id]}, message_index int, role string, content string")


def labelled_turns(df: DataFrame, text: str = "text", doc_id: str = "doc_id", labels: tuple[str, ...] = ("User", "Assistant"), strict: bool = True) -> DataFrame:
    """(doc_id, message_index, role, content) of texts with labelled turns (F24); texts that are none have no rows."""
    return _parsed(df, text, doc_id, lambda t: label_turns(t, labels, strict))


def heading_turns(df: DataFrame, text: str = "text", doc_id: str = "doc_id", strict: bool = True) -> DataFrame:
    """(doc_id, message_index, role, content) of texts in an export's markdown."""
    return _parsed(df, text, doc_id, lambda t: markdown_turns(t, strict))


def shape_of(text: Column) -> Column:
    """What a JSON text holds: ``mapping``, ``messages``, ``conversations``, a ``list`` of these, or ``other`` (S33, S25); null for null."""
    bare = F.trim(text)
    first = F.when(bare.startswith("["), F.get_json_object(bare, "$[0]")).otherwise(bare)
    has = lambda key: F.get_json_object(first, f"$.{key}").isNotNull()
    inner = F.when(has("mapping"), "mapping").when(has("messages"), "messages").when(has("conversations"), "conversations").otherwise("other")
    return F.when(bare.startswith("[") & (inner != "other"), F.concat(F.lit("list of "), inner)).when(text.isNotNull(), inner)


def route_of(path: Column) -> Column:
    """How a file is read, by its ending (S25, S22): archive, json, html, text, or skip for what needs other programs."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end == "zip", "archive").when(end.isin("json", "jsonl"), "json").when(end.isin("html", "htm"), "html").when(end.isin("txt", "md", "markdown"), "text").otherwise("skip")


def plain_text(content: Column, path: Column) -> Column:
    """Text of txt, md and html files (S22): tags, scripts and entities go, form feeds and line ends are normalised; null for other files."""
    from ..functions.text import normalize_text

    raw = F.decode(content, "UTF-8")
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?is)<(script|style)\b.*?</\1>", ""), r"(?i)<(?:br|/p|/div|/h\d|/li)[^>]*>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(mark))
    route = route_of(path)
    return F.when(route == "html", normalize_text(bare)).when(route == "text", normalize_text(raw))


def survey_rows(spark: SparkSession, path: str, ids: DataFrame, key: str = "response_id") -> DataFrame:
    """Survey answers of a CSV with the participant of ``ids``, one JSON text per participant (S21); short rows are padded, long ones cut."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", True).csv(path)
    named = raw.join(ids.select(key, "participant"), key)
    return named.select("participant", F.to_json(F.struct(*[c for c in raw.columns if c != key])).alias("answers"))


def subset_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores of subsets by plan row; the last line of a row holds."""
    schema = T._parse_datatype_string("type string, row int, label string, line bigint, prior_conversation_reliance int, uploaded_document_reliance int, cohesion int, notes string")
    rows = jsonl(spark, path, schema).where("coalesce(type, '') <> 'meta' AND row IS NOT NULL")
    rest = [f.name for f in schema.fields if f.name not in ("type", "row", "line")]
    return rows.groupBy("row").agg(F.max_by(F.struct(*rest), "line").alias("_r")).select("row", "_r.*")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of all manifests below a folder with their manifest's header."""
    head = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/*/meta").withColumn("_file", F.col("_metadata.file_path"))
    tasks = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/*/tasks").withColumn("_file", F.col("_metadata.file_path"))
    name = F.regexp_extract("_file", r"([^/]+)/(?:meta|tasks)/[^/]+$", 1)
    return tasks.withColumn("manifest", name).drop("_file").join(head.select(name.alias("manifest"), F.col("tasks").alias("planned"), "status"), "manifest", "left")
