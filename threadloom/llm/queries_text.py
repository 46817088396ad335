"""Queries of problems 4, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, table
from . import bpe, contamination, language, pii


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal information that each message holds."""
    ship(spark)
    return pii.found(table(spark, sf_dir, "messages"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with placeholders for personal information."""
    ship(spark)
    return pii.redacted(table(spark, sf_dir, "messages"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k byte-level vocabulary."""
    ship(spark)
    return bpe.encoded(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids of every document, and whether they decode to its text."""
    ship(spark)
    documents = table(spark, sf_dir, "documents")
    ids = bpe.encoded(documents)
    back = bpe.decoded(ids).select("doc_id", F.col("text").alias("back"))
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item."""
    ship(spark)
    return contamination.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents that hold them."""
    ship(spark)
    hits = contamination.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


def p9_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leak with the number of distinct runs of twelve words and whether the answer stands in the document, too."""
    ship(spark)
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return contamination.answered(contamination.leaked(documents, items), documents, items)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or too narrow."""
    ship(spark)
    return language.mislabelled(table(spark, sf_dir, "documents")).select("doc_id", "language").distinct()


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one language of every document, with a confidence."""
    ship(spark)
    return language.segments(table(spark, sf_dir, "documents"))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document with words, with a confidence."""
    ship(spark)
    return language.documents_languages(table(spark, sf_dir, "documents"))


_P9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""

QUERIES: dict = {
    "p4_found": p4_found, "p4_redacted": p4_redacted, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip,
    "p9_found": p9_found, "p9_report": p9_report, "p9_answers": p9_answers, "p10_found": p10_found, "p10_segments": p10_segments,
    "p10_documents": p10_documents,
}
SQL: dict = {
    "p8_roundtrip": "SELECT doc_id, TRUE AS same FROM documents",
    "p9_found": _P9_SQL + "SELECT doc_id, item_id FROM hit",
    "p9_answers": _P9_SQL + """, runs AS (SELECT doc_id, item_id, CAST(count(*) AS INT) AS runs FROM dg JOIN eg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, runs, CASE WHEN len(regexp_extract_all(lower(a.answer), '[\\p{L}\\p{N}]+')) > 0
  THEN list_has_all(d.w, regexp_extract_all(lower(a.answer), '[\\p{L}\\p{N}]+')) END AS answer_seen
FROM runs JOIN d USING (doc_id) JOIN eval_items a USING (item_id)""",
    "p9_report": _P9_SQL + "SELECT item_id, count(*) AS documents FROM hit GROUP BY item_id",
}
