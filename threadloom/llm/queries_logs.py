"""Queries of problems 1, 3, 5, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timestamps import label_instants, with_clocks
from ..runtime import ship, staged, table
from . import consensus, conversations, pairs, reservoir, sameness


#: A pair is a case from this count and these enrichments on, by K.
MIN_TOGETHER = 5
MIN_ENRICHMENT = {0: 2.0, 3: 3.6}
WINDOW = 3
SAMPLE_SIZE = 10_000


def _pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "preprocessed")
    names = sorted(c.removeprefix("score__") for c in rows.columns if c.startswith("score__"))
    cutoffs = table(spark, sf_dir, "cutoffs")
    # One row per score column of the wide table: bounded by its schema.
    known = {r.annotation_id: r.cutoff for r in cutoffs.where(F.col("annotation_id").isin(names)).groupBy("annotation_id").agg(F.max("cutoff").alias("cutoff")).collect()}
    score = lambda n: F.col(f"`score__{n}`")
    items = F.array_compact(F.array(*[F.when(score(n) >= known[n], i) for i, n in enumerate(names) if known.get(n) is not None]))
    scored = F.array_compact(F.array(*[F.when(score(n).isNotNull() & ~F.isnan(score(n)), i) for i, n in enumerate(names)]))
    tallies = staged(pairs.counts(rows, ["participant", "source_path", "chat_index"], "message_index", items, scored, WINDOW), "tallies")
    return pairs.enrichment(tallies, spark.createDataFrame(list(enumerate(names)), "item int, name string"), WINDOW)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs that go together more often than chance, within a message and within the next 3."""
    least = F.when(F.col("k") == 0, MIN_ENRICHMENT[0]).otherwise(MIN_ENRICHMENT[WINDOW])
    hits = _pair_table(spark, sf_dir).where((F.col("x") != F.col("y")) & (F.col("c_k") >= MIN_TOGETHER) & (F.col("enrichment") >= least))
    return hits.select("k", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and enrichment of every ordered pair; ``p1_odds`` has the corrected log odds."""
    return _pair_table(spark, sf_dir).select("k", "x", "y", "n_x", "c_k", F.round("enrichment", 6).alias("enrichment"))


def p1_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log odds ratio, with 0.5 added to each cell, of every ordered pair."""
    return _pair_table(spark, sf_dir).select("k", "x", "y", "n_x", "n_y", "scored_y", "c_k", F.round("log_odds", 6).alias("log_odds"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose right answer is yes."""
    per_item, _ = consensus.consensus(table(spark, sf_dir, "manual_labels"), table(spark, sf_dir, "manual_items"))
    return per_item.where("consensus = 'yes'").select("dataset_path", "sequence_index", "annotation_id").distinct()


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, confidence and agreement of every item."""
    return consensus.consensus(table(spark, sf_dir, "manual_labels"), table(spark, sf_dir, "manual_items"))[0]


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every annotator."""
    return consensus.consensus(table(spark, sf_dir, "manual_labels"), table(spark, sf_dir, "manual_items"))[1]


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the annotators of each item agree, by pairs and beyond chance, before any consensus."""
    given = consensus.answers(table(spark, sf_dir, "manual_labels"), table(spark, sf_dir, "manual_items"))
    return consensus.agreement(given, list(consensus.ITEM)).withColumns({k: F.round(k, 6) for k in ("agreement", "kappa")})


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of messages; a row that lacks part of its key is told by its chat_key or the instant of its time label.

    Only rows without message_index have their labels read, so one sent again with its label in another form is one
    message; a label without instant tells by its text.
    """
    ship(spark)
    rows = table(spark, sf_dir, "messages").select("participant", "source_path", "chat_index", "message_index", "row_id", "chat_key", "timestamp", "ingested_at")
    other_chat = F.when(F.col("chat_index").isNull(), F.col("chat_key")).alias("other_chat")
    key = ["participant", "source_path", "chat_index", "message_index", "other_chat", "other_place"]
    placed = rows.where("message_index is not null").select(*key[:4], "row_id", other_chat, F.lit(None).cast("string").alias("other_place"))
    keep = ("participant", "source_path", "chat_index", "message_index", "row_id", "chat_key", "label")
    loose = label_instants(
        with_clocks(rows.where("message_index is null"), table(spark, sf_dir, "transcript_files")).withColumn("label", F.col("timestamp")),
        fields=("timestamp",), keep=keep, zone="clock", day_first="day_first",
    ).select(*key[:4], "row_id", other_chat, F.coalesce(F.col("utc_second").cast("string"), "label").alias("other_place"))
    sample = reservoir.fixed_size_sample(placed.unionByName(loose), key, "row_id", SAMPLE_SIZE)
    return sample.select("participant", "source_path", "chat_index", "message_index", "row_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an earlier row's content in another dress."""
    return sameness.repeats(table(spark, sf_dir, "messages"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of each repeated content and the number of its copies."""
    return sameness.survivors(table(spark, sf_dir, "messages"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to be dropped."""
    ship(spark)
    bad = conversations.broken(table(spark, sf_dir, "messages"), table(spark, sf_dir, "transcript_files"))
    return bad.select("participant", "source_path", "chat_index").distinct()


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each unusable conversation is dropped."""
    ship(spark)
    return conversations.broken(table(spark, sf_dir, "messages"), table(spark, sf_dir, "transcript_files"))


def p6_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable conversations, place by place."""
    ship(spark)
    return conversations.ordered(table(spark, sf_dir, "messages"), table(spark, sf_dir, "transcript_files"))


_P1_SQL = """
WITH rows AS (SELECT DISTINCT * FROM preprocessed),
numbered AS (SELECT row_number() OVER () AS rid, participant, source_path, chat_index, message_index, role, "timestamp", chat_key, chat_date, COLUMNS('score__.*') FROM rows),
long AS (UNPIVOT numbered ON COLUMNS('score__.*') INTO NAME col VALUE score),
scored AS (SELECT l.rid, substr(l.col, 8) AS item, l.score >= c.cutoff AS pos
  FROM long l JOIN cutoffs c ON c.annotation_id = substr(l.col, 8) WHERE l.score IS NOT NULL),
per_item AS (SELECT item, count(*) AS scored, count(*) FILTER (WHERE pos) AS n FROM scored GROUP BY item),
pos AS (SELECT rid, item FROM scored WHERE pos),
ahead AS (SELECT rid, unnest([lead(rid, 1) OVER w, lead(rid, 2) OVER w, lead(rid, 3) OVER w]) AS nxt FROM numbered
  WINDOW w AS (PARTITION BY participant, source_path, chat_index ORDER BY message_index)),
c AS (SELECT 0 AS k, a.item AS x, b.item AS y, count(*) AS c_k FROM pos a JOIN pos b ON a.rid = b.rid AND a.item <> b.item GROUP BY ALL
  UNION ALL
  SELECT 3, a.item, b.item, count(*) FROM ahead h JOIN pos a ON a.rid = h.rid JOIN pos b ON b.rid = h.nxt GROUP BY ALL),
e AS (SELECT c.k, c.x, c.y, px.n AS n_x, c.c_k, (c.c_k / px.n::DOUBLE) / (py.n / py.scored::DOUBLE) AS enrichment
  FROM c JOIN per_item px ON px.item = c.x JOIN per_item py ON py.item = c.y)
"""

_FOLD = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '[\p{{P}}\p{{Z}}\p{{C}}$+<=>^`|~]+', '', 'g')"
_NAME = r"[\p{L}_][\p{L}\p{N}_ .\-]{0,39}"
#: Groups of equal contents: a record by its sorted folded fields (JSON object, key=value pairs, key: value lines), other texts by their folded letters.
_P3_SQL = f"""
WITH m AS (SELECT row_id, content AS t, trim(content, ' ') AS b FROM messages WHERE length(regexp_replace(content, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 30),
j AS (SELECT row_id, b, TRY_CAST(b AS JSON) AS o FROM m WHERE starts_with(b, '{{') AND ends_with(b, '}}')),
je AS (SELECT row_id, unnest(json_keys(o)) AS k, o FROM j WHERE json_type(o) = 'OBJECT' AND len(json_keys(o)) >= 2),
pe AS (SELECT row_id, unnest(regexp_split_to_array(b, ';\\s*')) AS x FROM m WHERE NOT starts_with(b, '{{') AND contains(b, '=') AND contains(b, ';') AND regexp_full_match(b, '\\s*{_NAME}=[^=;\\n]*(?:;\\s*{_NAME}=[^=;\\n]*)+;?\\s*')),
le AS (SELECT row_id, unnest(regexp_split_to_array(b, '\\r?\\n\\s*')) AS x FROM m WHERE NOT starts_with(b, '{{') AND contains(b, ':') AND regexp_full_match(b, '\\s*{_NAME}:[^\\n]*(?:\\n\\s*{_NAME}:[^\\n]*)+\\s*')
 AND row_id NOT IN (SELECT row_id FROM pe)),
e AS (SELECT row_id, k, coalesce(json_extract_string(o, '$."' || k || '"'), '') AS v FROM je
 UNION ALL SELECT row_id, split_part(x, '=', 1), substr(x, strpos(x, '=') + 1) FROM pe WHERE contains(x, '=')
 UNION ALL SELECT row_id, split_part(x, ':', 1), substr(x, strpos(x, ':') + 1) FROM le WHERE contains(x, ':')),
r AS (SELECT row_id, string_agg({_FOLD.format('k')} || chr(1) || {_FOLD.format('v')}, chr(2) ORDER BY {_FOLD.format('k')}, {_FOLD.format('v')}) AS rec FROM e GROUP BY row_id),
c AS (SELECT m.row_id, {_FOLD.format('t')} AS txt, rec FROM m LEFT JOIN r USING (row_id)),
d AS (SELECT txt, min(rec) AS rec, min(row_id) AS first, count(*) AS n FROM c GROUP BY txt),
g AS (SELECT coalesce('r' || rec, 't' || txt) AS code, min(first) AS first_row_id, CAST(sum(n) AS BIGINT) AS copies FROM d GROUP BY 1 HAVING sum(n) > 1)
"""

QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs, "p1_odds": p1_odds, "p3_found": p3_found, "p3_survivors": p3_survivors, "p5_found": p5_found,
    "p5_items": p5_items, "p5_annotators": p5_annotators, "p5_agreement": p5_agreement, "p6_found": p6_found, "p6_reasons": p6_reasons, "p6_ordered": p6_ordered,
    "p7_sample": p7_sample,
}
SQL: dict[str, str] = {
    "p1_found": _P1_SQL + """SELECT DISTINCT CAST(k AS INT) AS k, least(x, y) AS x, greatest(x, y) AS y FROM e
WHERE x <> y AND c_k >= 5 AND enrichment >= CASE WHEN k = 0 THEN 2.0 ELSE 3.6 END""",
    "p3_found": _P3_SQL + "SELECT first_row_id, row_id FROM c JOIN d USING (txt) JOIN g ON g.code = coalesce('r' || d.rec, 't' || d.txt) WHERE row_id <> first_row_id",
    "p3_survivors": _P3_SQL + "SELECT first_row_id, copies FROM g",
    "p5_agreement": """WITH l AS (SELECT dataset_path, sequence_index, participant, annotation_id, annotator, lower(trim(arg_max(label, (labelled_at, label_id)))) AS w
 FROM manual_labels WHERE label IS NOT NULL AND annotator IS NOT NULL GROUP BY ALL),
v AS (SELECT * EXCLUDE (w), CASE WHEN w = 'yes' THEN 1 ELSE 0 END AS y FROM l SEMI JOIN manual_items USING (dataset_path, sequence_index, participant, annotation_id) WHERE w IN ('yes', 'no')),
t AS (SELECT dataset_path, sequence_index, participant, annotation_id, count(*) AS answers, sum(y) AS s FROM v GROUP BY ALL), o AS (SELECT avg(y) ** 2 + (1 - avg(y)) ** 2 AS c FROM v),
p AS (SELECT t.*, CASE WHEN answers > 1 THEN (s * (s - 1) + (answers - s) * (answers - s - 1)) / (answers * (answers - 1)) END AS a FROM t)
SELECT dataset_path, sequence_index, participant, annotation_id, answers, round(a, 6) AS agreement, round((a - c) / (1 - c), 6) AS kappa FROM p, o""",
    "p1_odds": _P1_SQL + """, o AS (SELECT c.k, c.x, c.y, px.n AS n_x, py.n AS n_y, py.scored AS scored_y, c.c_k, c.c_k + 0.5 AS a, greatest(px.n * greatest(c.k, 1) - c.c_k, 0) + 0.5 AS b,
 greatest(py.n - c.c_k, 0) + 0.5 AS cc, greatest(py.scored - px.n - py.n + c.c_k, 0) + 0.5 AS d FROM c JOIN per_item px ON px.item = c.x JOIN per_item py ON py.item = c.y)
SELECT CAST(k AS INT) AS k, x, y, n_x, n_y, scored_y, c_k, round(ln(a * d / (b * cc)), 6) AS log_odds FROM o""",
    "p1_pairs": _P1_SQL + "SELECT CAST(k AS INT) AS k, x, y, n_x, c_k, round(enrichment, 6) AS enrichment FROM e",
}
