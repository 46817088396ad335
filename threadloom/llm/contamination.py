"""Evaluation texts leaking into documents (problem 9).

The test items form a BM25 inverted index whose postings carry block maxima. Every passage of every
document is a query; block-max WAND retrieves all items whose score reaches the threshold, skipping
blocks whose maxima cannot. The threshold loses nothing: an item's own is the least score that any
``run`` consecutive words of it give, and passages overlap by ``run - 1`` words, so a passage that
holds such a run scores at least that. Retrieved items are then verified word by word.

Defined results: words are runs of letters and digits, case-folded; null, empty and wordless texts
hold nothing; items shorter than ``run`` words cannot leak; copies of an item are found under each id;
repeated documents give one row per id. Items are indexed in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters (one item alone may exceed the latter), so what is broadcast and indexed at
once has a bound whatever the number of items; each block costs one scan of the text column.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
PASSAGE = 24
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Items longer than this many characters are indexed in pieces that overlap by ``run - 1`` words.
PIECE_WORDS = 2_000
_POSTINGS = 16
_K1, _B = 1.2, 0.75
_WORDS = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Case-folded runs of letters and digits."""
    if not text:
        return []
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFC", text))
    return _WORDS.findall(text.casefold())


class Index:
    """BM25 index of items with block maxima; ``items`` are (id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run = run
        pieces = []
        for key, w in items:
            for at in range(0, max(1, len(w) - run + 1), PIECE_WORDS):
                part = w[at : at + PIECE_WORDS + run - 1]
                if len(part) >= run:
                    pieces.append((key, part))
        pieces.sort(key=lambda p: sorted(p[1]))  # alike items share blocks, which keeps block maxima tight
        self.ids = [k for k, _ in pieces]
        self.grams = [{" ".join(w[i : i + run]) for i in range(len(w) - run + 1)} for _, w in pieces]
        n = len(pieces)
        mean = sum(len(w) for _, w in pieces) / max(n, 1)
        counts = [Counter(w) for _, w in pieces]
        df = Counter(t for c in counts for t in c)
        postings: dict[str, list[tuple[int, float]]] = {}
        for d, (c, (_, w)) in enumerate(zip(counts, pieces)):
            norm = _K1 * (1 - _B + _B * len(w) / mean)
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (_K1 + 1) / (tf + norm) for t, tf in c.items()}
            # Scores are in units of what the item's weakest run gives, so one threshold serves all items.
            least = min(sum(weight[t] for t in set(w[i : i + run])) for i in range(len(w) - run + 1))
            for t, x in weight.items():
                postings.setdefault(t, []).append((d, x / least))
        self.threshold = 1 - 1e-9
        self.terms = {}
        for t, p in postings.items():
            blocks = [p[i : i + _POSTINGS] for i in range(0, len(p), _POSTINGS)]
            self.terms[t] = ([d for d, _ in p], [x for _, x in p], [b[-1][0] for b in blocks], [max(x for _, x in b) for b in blocks], max(x for _, x in p))

        self.best = {t: x[4] for t, x in self.terms.items()}

    def retrieve(self, terms: set[str]) -> list[int]:
        """Ordinals of all items whose score for ``terms`` reaches their threshold (block-max WAND)."""
        known = self.terms
        lists = [known[t] for t in terms if t in known]
        threshold = self.threshold
        if sum(x[4] for x in lists) < threshold:
            return []
        at = [0] * len(lists)
        alive = list(range(len(lists)))
        out = []
        while alive:
            alive.sort(key=lambda i: lists[i][0][at[i]])
            bound, pivot = 0.0, -1
            for n, i in enumerate(alive):
                bound += lists[i][4]
                if bound >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                break
            doc = lists[alive[pivot]][0][at[alive[pivot]]]
            while pivot + 1 < len(alive) and lists[alive[pivot + 1]][0][at[alive[pivot + 1]]] == doc:
                pivot += 1
            bound, edge = 0.0, math.inf
            for i in alive[: pivot + 1]:
                # The block that would hold ``doc``: postings before it need not be read.
                ends, maxima = lists[i][2], lists[i][3]
                b = at[i] // _POSTINGS
                while b < len(ends) and ends[b] < doc:
                    b += 1
                if b < len(ends):
                    bound += maxima[b]
                    edge = min(edge, ends[b])
            if bound >= threshold:
                score = 0.0
                for i in alive[: pivot + 1]:
                    docs, k = lists[i][0], at[i]
                    while k < len(docs) and docs[k] < doc:
                        k += 1
                    if k < len(docs) and docs[k] == doc:
                        score += lists[i][1][k]
                        k += 1
                    at[i] = k
                if score >= threshold:
                    out.append(doc)
            else:
                # No item up to the nearest block end, or before the next list starts, can reach it.
                after = lists[alive[pivot + 1]][0][at[alive[pivot + 1]]] if pivot + 1 < len(alive) else math.inf
                goal = min(edge + 1, after)
                if goal <= doc:
                    goal = doc + 1
                for i in alive[: pivot + 1]:
                    docs, k = lists[i][0], at[i]
                    ends = lists[i][2]
                    b = k // _POSTINGS
                    while b < len(ends) and ends[b] < goal:
                        b += 1
                    k = max(k, b * _POSTINGS)
                    while k < len(docs) and docs[k] < goal:
                        k += 1
                    at[i] = k
            alive = [i for i in alive if at[i] < len(lists[i][0])]
        return out

    def leaks(self, w: list[str]) -> dict[int, int]:
        """item id to the number of its runs that stand in the words of a document."""
        run, size = self.run, max(PASSAGE, 2 * self.run)
        found: dict[int, set[str]] = {}
        known = self.terms
        if len(w) < run:
            return {}
        # What a passage can score at most, from running sums: its words' greatest weights, repeats included.
        best = [self.best.get(t, 0.0) for t in w]
        upto = [0.0, *accumulate(best)]
        enough = self.threshold - 1e-6
        # A run of an item has no word that the index lacks: passages are laid within stretches of known words.
        gaps = [-1, *[i for i, x in enumerate(best) if not x], len(w)]
        passages = [(begin, min(begin + size, to)) for at, to in zip(gaps, gaps[1:]) if to - at > run for begin in range(at + 1, to - run + 1, size - run + 1)]
        for begin, end in passages:
            if upto[end] - upto[begin] < enough:
                continue
            passage = w[begin:end]
            terms = set(passage)
            for d in self.retrieve(terms):
                grams = self.grams[d]
                for i in range(len(passage) - run + 1):
                    g = " ".join(passage[i : i + run])
                    if g in grams:
                        found.setdefault(self.ids[d], set()).add(g)
        return {k: len(v) for k, v in found.items()}


_MADE: dict[str, Index] = {}


def _indexed(name: str, items: list[tuple[int, list[str]]], run: int) -> Index:
    """The block's index, built once per Python worker."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Index(items, run)
    return _MADE[name]


def answered(hits: DataFrame, documents: DataFrame, items: DataFrame, text: str = "text", answer: str = "answer", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``hits`` with ``answer_seen``: every word of the item's answer stands in the document, too; null without an answer.

    Only documents with hits are split into words.
    """
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    said = documents.select(doc_id, F.col(text).alias("_text")).join(hits.select(doc_id).distinct(), doc_id, "left_semi").select(doc_id, split(F.col("_text")).alias("_words")).distinct()
    asked = items.groupBy(item_id).agg(split(F.max(answer)).alias("_answer"))
    seen = F.when(F.size("_answer") > 0, F.size(F.array_except("_answer", "_words")) == 0)
    return hits.distinct().join(said, doc_id).join(asked, item_id).select(*hits.columns, seen.alias("answer_seen"))


def leaked(documents: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", run: int = RUN) -> DataFrame:
    """(doc_id, item_id, runs): documents that hold at least ``run`` consecutive words of an item.

    ``runs`` counts the distinct runs found. Documents are scanned once per block of items, without a shuffle.
    """
    spark = documents.sparkSession
    key, other = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {key}, `{item_id}` {other}, runs int"
    rows = documents.select(doc_id, text)
    out: DataFrame | None = None
    block: list[tuple[int, list[str]]] = []
    held = 0

    def scan(part: list[tuple[int, list[str]]]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _indexed(name, shared.value, run)
            for batch in batches:
                at, ids, runs = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for item, n in index.leaks(words(t)).items():
                        at.append(i)
                        ids.append(item)
                        runs.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(runs, pa.int32())], [doc_id, item_id, "runs"])

        return rows.mapInArrow(run_, schema)

    chosen = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t"))
    for r in chosen.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or held + len(r.t) > BLOCK_CHARS):
            out, block, held = (scan(block) if out is None else out.unionByName(scan(block))), [], 0
        block.append((r.i, words(r.t)))
        held += len(r.t)
    if block or out is None:
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out
