"""A uniform sample of fixed size from data of unknown length (problem 7).

Each shard keeps a geometric file: accepted records gather in a buffer; a full buffer is shuffled and
flushed as a new segment, and what it displaces is cut from the ends of the older segments, the
numbers per segment drawn hypergeometrically. As every segment is in random order, cutting its end
removes a uniform choice, so segments shrink geometrically and are never rewritten. Only record ids
are held, at most ``size`` + buffer per shard. Shards are merged by drawing how many of the final
sample come from each, multivariate hypergeometric in the shards' populations.

Defined results: a record sent several times is one record; with fewer records than ``size`` all are
returned; nulls in a key are values of their own; an empty table gives an empty sample. Records reach
a shard in key order, so a task that runs again after a lost executor draws the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import staged


LEAST_SHARDS, SHARD_RECORDS = 8, 1_000_000


class GeometricFile:
    """Uniform sample of up to ``size`` ids of those offered."""

    def __init__(self, size: int, rng: np.random.Generator, buffer: int | None = None):
        self.size, self.rng = size, rng
        self.limit = max(1, min(size, buffer or max(64, size // 8)))
        self.segments: list[np.ndarray] = []
        self.buffer: list[int] = []
        self.seen = 0

    def _flush(self) -> None:
        fresh = np.array(self.buffer, np.int64)
        self.rng.shuffle(fresh)
        room = self.size - sum(map(len, self.segments))
        out = max(0, len(fresh) - room)
        if out:
            sizes = np.array([len(s) for s in self.segments])
            cut = self.rng.multivariate_hypergeometric(sizes, out, method="marginals")
            self.segments = [s[: len(s) - c] for s, c in zip(self.segments, cut) if len(s) > c]
        self.segments.append(fresh)
        self.buffer = []

    def offer(self, ids: np.ndarray) -> None:
        fill = min(len(ids), max(0, self.size - self.seen))
        if fill:  # until there are ``size`` records all are taken, without displacing any
            for at in range(0, fill, self.limit):
                part = ids[at : min(fill, at + self.limit)]
                self.buffer = list(part)
                self._flush()
        rest = ids[fill:]
        places = self.seen + fill + 1 + np.arange(len(rest))
        for i in np.flatnonzero(self.rng.random(len(rest)) * places < self.size):
            # A new record displaces any of the sample alike, those in the buffer included.
            if self.buffer and self.rng.random() * self.size < len(self.buffer):
                self.buffer[self.rng.integers(len(self.buffer))] = int(rest[i])
            else:
                self.buffer.append(int(rest[i]))
                if len(self.buffer) >= self.limit:
                    self._flush()
        self.seen += len(ids)

    def sample(self) -> np.ndarray:
        """The sample in random order."""
        if self.buffer:
            self._flush()
        out = np.concatenate(self.segments) if self.segments else np.empty(0, np.int64)
        self.rng.shuffle(out)
        return out


def _shards(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        file = GeometricFile(size, np.random.default_rng([seed, shard]))
        for batch in batches:
            file.offer(batch.column(0).to_numpy())
        ids = file.sample()
        n = len(ids)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, file.seen, np.int64)), pa.array(np.arange(n, dtype=np.int64)), pa.array(ids)],
                ["shard", "population", "rank", "record"],
            )

    return run


def draw(populations: list[int], size: int, rng: np.random.Generator) -> list[int]:
    """How many of the sample come from each shard."""
    total = sum(populations)
    left, out = min(size, total), []
    for n in populations:
        k = 0 if not left else int(_hypergeometric(rng, n, total - n, left))
        out.append(k)
        left -= k
        total -= n
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad >= 10**9:  # beyond numpy's range the draw is from ranks of a uniform choice
        hit = 0
        for i in range(n):
            hit += rng.random() * (good + bad - i) < good - hit
        return hit
    return rng.hypergeometric(good, bad, n)


def fixed_size_sample(df: DataFrame, key: list[str], record_id: str, size: int, seed: int = 7) -> DataFrame:
    """``size`` records of ``df``, each distinct ``key`` equally likely: key columns and the least record id.

    Copies of a key are combined before the shuffle, so a record sent very often is one row per task.
    There is a shard for every ``SHARD_RECORDS`` distinct records, whatever the cluster, so the sample depends on
    data and seed only; a shard holds at most ``size`` ids. The driver sees one population per shard.
    """
    spark = df.sparkSession
    distinct = staged(df.groupBy(*key).agg(F.min(record_id).alias(record_id)), "distinct")
    # Spread by a hash, ordered by id: what a shard holds does not depend on arrival.
    width = max(LEAST_SHARDS, -(-distinct.count() // SHARD_RECORDS))
    sharded = distinct.select(F.col(record_id).cast("bigint").alias("record")).repartition(width, F.xxhash64("record")).sortWithinPartitions("record")
    kept = staged(sharded.mapInArrow(_shards(size, seed), "shard int, population bigint, rank bigint, record bigint"), "shards")
    sizes = sorted((r.shard, r.population) for r in kept.groupBy("shard").agg(F.max("population").alias("population")).collect())
    quota = draw([n for _, n in sizes], size, np.random.default_rng([seed]))
    allowed = spark.createDataFrame([(s, k) for (s, _), k in zip(sizes, quota)] or [(-1, 0)], "shard int, quota bigint")
    chosen = kept.join(allowed, "shard").where("rank < quota").select(F.col("record").alias(record_id))
    return distinct.join(chosen, record_id)
