"""Byte-level BPE with a public vocabulary (problem 8).

Text is split by the vocabulary's pattern; within each piece merges are taken from a priority queue of
merge ranks over a doubly linked list of symbols, entries that have gone stale being skipped. A task
remembers the ids of pieces it has seen, which are few beside the pieces of a corpus. Ids are decoded
by concatenating vocabulary strings.

Defined results: null and empty texts have an empty list; strings that look like special tokens are
ordinary text; texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary lies unless told otherwise; it is read by the driver only.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a task, and the longest that is.
REMEMBERED, LONGEST = 200_000, 64
#: A vocabulary file larger than this is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def load(path: str = VOCABULARY) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """(token to id, merged pair to rank) of a vocabulary file."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file {path} is too large to broadcast")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return model["vocab"], {p: rank for rank, p in enumerate(pairs)}


class Encoder:
    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int]):
        import regex

        self.vocab, self.ranks = vocab, ranks
        self.split = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.known: dict[str, tuple[int, ...]] = {}
        self._strings: dict[int, str] | None = None

    def piece(self, piece: str) -> tuple[int, ...]:
        letters = self.letters
        symbols: list = [letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if n > 1:
            ranks = self.ranks
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            heap = []
            for i in range(n - 1):
                rank = ranks.get((symbols[i], symbols[i + 1]))
                if rank is not None:
                    heap.append((rank, i, symbols[i], symbols[i + 1]))
            heapq.heapify(heap)
            while heap:
                _, i, left, right = heapq.heappop(heap)
                j = after[i] if symbols[i] is not None else -1
                if j < 0 or symbols[i] != left or symbols[j] != right:
                    continue  # stale: one of the two has merged since
                symbols[i], symbols[j] = left + right, None
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    rank = ranks.get((symbols[i], symbols[k]))
                    if rank is not None:
                        heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
                h = before[i]
                if h >= 0:
                    rank = ranks.get((symbols[h], symbols[i]))
                    if rank is not None:
                        heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
        vocab = self.vocab
        return tuple(vocab[s] for s in symbols if s is not None)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        if self._strings is None:
            self._strings = {i: t for t, i in self.vocab.items()}
        byte = {c: b for b, c in enumerate(self.letters)}
        return bytes(byte[c] for i in ids for c in self._strings[i]).decode("utf-8", "surrogatepass")


def _vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(load(path))


def encoded(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of every row. One pass, no shuffle; the vocabulary's size is checked."""
    shared = _vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = [np.asarray(encoder.encode(t), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                kind = pa.list_(pa.field("element", pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), type=kind)], [doc_id, "ids"])

    return df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {dict(df.dtypes)[doc_id]}, ids array<int>")


def decoded(df: DataFrame, ids: str = "ids", doc_id: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of lists of ids; a null list has a null text."""
    shared = _vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [doc_id, "text"])

    return df.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {dict(df.dtypes)[doc_id]}, text string")
