"""Terms of texts by TF-IDF: one and two words in a row, stop words left out.

A text is one row, so its terms are counted where it is; two passes over the texts, each with a small shuffle:
of term counts, combined per Arrow batch, and of weights per (group, term) of the vocabulary.

Defined results: null texts are no documents, texts without terms count as documents with no weight; ties of use go by
the term; repeated rows count as often as they stand; an empty table has no terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\b\w\w+\b")


def grams(text: str, stops: frozenset[str]) -> list[str]:
    """Words of two characters or more that are no stop words, and each two of them in a row."""
    words = [w for w in _WORD.findall(text.lower()) if w not in stops]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def vocabulary(texts: DataFrame, text: str, stops: frozenset[str], size: int, least: int) -> DataFrame:
    """(term, df, uses) of the ``size`` most used terms that stand in ``least`` texts at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses, docs = Counter(), Counter()
            for t in batch.column(0).to_pylist():
                counts = Counter(grams(t, stops))
                uses.update(counts)
                docs.update(counts.keys())
            terms = list(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([docs[t] for t in terms], pa.int64()), pa.array([uses[t] for t in terms], pa.int64())], ["term", "df", "uses"]
            )

    counts = texts.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "term string, df bigint, uses bigint")
    total = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("uses").alias("uses"))
    return total.where(F.col("df") >= least).orderBy(F.desc("uses"), "term").limit(size)


def mean_weights(texts: DataFrame, text: str, group: str, stops: frozenset[str], size: int, least: int) -> DataFrame:
    """(group, term, weight): mean over a group's texts of smoothed TF-IDF, each text of length 1.

    The vocabulary, at most ``size`` terms, is collected and broadcast.
    """
    rows = texts.where(F.col(text).isNotNull())
    n = rows.count()
    known = vocabulary(rows, text, stops, size, least).collect()
    idf = rows.sparkSession.sparkContext.broadcast({r.term: math.log((n + 1) / (r.df + 1)) + 1 for r in known})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for batch in batches:
            sums: dict[tuple[str | None, str], float] = defaultdict(float)
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(x for x in grams(t, stops) if x in weight)
                parts = {x: k * weight[x] for x, k in counts.items()}
                length = math.sqrt(sum(v * v for v in parts.values()))
                for x, v in parts.items():
                    sums[g, x] += v / length
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in sums], pa.string()), pa.array([x for _, x in sums], pa.string()), pa.array(list(sums.values()), pa.float64())], [group, "term", "total"]
            )

    totals = rows.select(F.col(group).cast("string").alias(group), text).mapInArrow(run, f"`{group}` string, term string, total double").groupBy(group, "term").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(F.col(group).cast("string").alias("_group")).agg(F.count("*").alias("members"))
    return totals.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).select(group, "term", (F.col("total") / F.col("members")).alias("weight"))
