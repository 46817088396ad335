"""Text functions that have no expression form, as Arrow-batched functions; null in, null out."""

from __future__ import annotations

import difflib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


@F.pandas_udf(T.StringType())
def strip_diacritics(texts: pd.Series) -> pd.Series:
    """Letters without their marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, 0 to 1."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(_SPANS)
def chunk_spans(texts: pd.Series, most: pd.Series, soft: pd.Series) -> pd.Series:
    """Spans of at most ``most`` characters that cover the text; a break is moved back to white space
    within the last ``soft`` characters (F19)."""

    def one(text, n, window):
        if text is None:
            return None
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + n)
            if end < len(text):
                back = max((text.rfind(mark, max(at + 1, end - window), end) for mark in ("\n", " ")), default=-1)
                end = back + 1 if back > at else end
            out.append({"start": at, "stop": end})
            at = end
        return out

    return pd.Series([one(t, int(n), int(w)) for t, n, w in zip(texts, most, soft)])


@F.pandas_udf(T.IntegerType())
def prefix_length(original: pd.Series, prefix: pd.Series) -> pd.Series:
    """Characters of ``original`` that spell ``prefix`` but for kinds of quotes, dashes and white space; null if none do."""
    folded = str.maketrans("‘’‚“”„–—‑", "'''\"\"\"---")

    def one(text, start):
        if text is None or start is None:
            return None
        want, k = "".join(start.translate(folded).split()), 0
        for i, c in enumerate(text):
            if k == len(want):
                return i
            if c.isspace():
                continue
            if c.translate(folded) != want[k]:
                return None
            k += 1
        return len(text) if k == len(want) else None

    return pd.Series([one(a, b) for a, b in zip(original, prefix)], dtype="Int32")


def nearest_message(messages: DataFrame, quotes: DataFrame, on: list[str], quote: str = "quote", content: str = "content", order: str = "message_index") -> DataFrame:
    """The message of a conversation most similar to a quote, the earlier one on ties."""
    j = messages.where(F.col(content).isNotNull()).join(quotes, on).withColumn("similarity", similarity(F.col(content), F.col(quote)))
    return j.groupBy(*on, quote).agg(F.max_by(order, F.struct("similarity", -F.col(order))).alias(order), F.max("similarity").alias("similarity"))


def without_margins(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", share: float = 0.6, least: int = 2) -> DataFrame:
    """Pages without first or last lines that recur on at least ``share`` of a document's pages, and ``least`` of them."""
    lines = pages.select(doc, page, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    ends = lines.join(lines.groupBy(doc, page).agg(F.max("n").alias("last")), [doc, page]).withColumn("edge", F.col("n").isin(0) | (F.col("n") == F.col("last")))
    total = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    seen = ends.where("edge AND trim(line) <> ''").groupBy(doc, F.trim("line").alias("margin")).agg(F.count_distinct(page).alias("k")).join(total, doc)
    margins = seen.where((F.col("k") >= least) & (F.col("k") >= share * F.col("pages"))).select(doc, "margin")
    marked = ends.withColumn("margin", F.when(F.col("edge"), F.trim("line")))
    kept = marked.join(margins.withColumn("drop", F.lit(True)), [doc, "margin"], "left").where("drop IS NULL")
    joined: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return pages.select(doc, page).join(kept.groupBy(doc, page).agg(joined.alias(text)), [doc, page], "left").withColumn(text, F.coalesce(text, F.lit("")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _contents(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            stack = [json.loads(text)] if text is not None else []
        except ValueError:
            return []
        out = []
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                if isinstance(node.get("content"), str):
                    out.append(node["content"])
                stack.extend(reversed([v for k, v in node.items() if not (k == "content" and isinstance(v, str))]))
            elif isinstance(node, list):
                stack.extend(reversed(node))
        return out

    return texts.map(one)


def json_contents(df: DataFrame, text: str) -> DataFrame:
    """One row per string under a key ``content``, at any depth of the JSON in ``text`` (F40); malformed text has none."""
    return df.withColumn("content", F.explode(_contents(F.col(text))))
