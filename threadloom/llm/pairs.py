"""Items that appear together, in one record or within the next K records of a session (problem 1).

Every co-occurrence is packed into one 64-bit code, ``kind << 60 | x << 30 | y``. Each Arrow batch of
codes becomes a sorted run with run lengths, which is all that leaves a task; Spark's external sorter
spills and merges the runs by code, and equal codes are summed in passing. Codes, not records, are
shuffled, and a code that a third of all records hold arrives as one row per batch.

Sessions are never gathered: records are range-partitioned and sorted by session and position, which
splits a hot session over tasks. The windows that cross a partition's end are completed from the first
and last K records of each partition, 2K rows per partition.

Defined results: wholly equal rows count once; null or missing scores are neither positive nor scored;
null keys form sessions of their own; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import staged

WITH_ITEM, SCORED, TOGETHER, FOLLOWS = 0, 1, 2, 3
_ITEM_BITS = 30
_LIST = pa.list_(pa.field("element", pa.int32()))


def pack(kind: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64-bit codes; x and y are below 2**30."""
    return (np.int64(kind) << np.int64(60)) | (x.astype(np.int64) << np.int64(_ITEM_BITS)) | y.astype(np.int64)


def _cross(values: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (item of record a[i], item of record b[i]) pairs, without a loop over records."""
    n = size[a] * size[b]
    keep = n > 0
    a, b, n = a[keep], b[keep], n[keep]
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(a)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = size[b][owner]
    return values[start[a][owner] + inner // width], values[start[b][owner] + inner % width]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return flat, offsets[:-1], np.diff(offsets)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted run and its run lengths."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.concatenate((first, [len(codes)])))


def _window_batches(window: int):
    """Sorted (row_hash, session, place, items, scored) to (code, n, tail fields).

    Rows with a null code are fragments: the first and last ``window`` records of the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last_hash = None
        held: pa.Table | None = None  # the last records seen, whose windows are still open
        seen = 0

        def fragments(t: pa.Table, at: int, where: list[int], ends: list[bool]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(where), pa.int64()), pa.nulls(len(where), pa.int64()),
                    pa.array([part] * len(where), pa.int32()), pa.array([at + i for i in where], pa.int64()),
                    pa.array(ends, pa.bool_()), t["session"].take(pa.array(where)).combine_chunks(), t["items"].take(pa.array(where)).combine_chunks().cast(_LIST),
                ],
                ["code", "n", "part", "seq", "is_end", "session", "items"],
            )

        def counted(codes: list[np.ndarray]) -> pa.RecordBatch:
            code, n = _runs(np.concatenate(codes) if codes else np.empty(0, np.int64))
            k = len(code)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(code), pa.array(n.astype(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, _LIST),
                ],
                ["code", "n", "part", "seq", "is_end", "session", "items"],
            )

        for batch in batches:
            t = pa.Table.from_batches([batch])
            h = np.stack([t["h1"].to_numpy(), t["h2"].to_numpy()])
            if not t.num_rows:
                continue
            before = np.concatenate((np.array(last_hash).reshape(2, 1) if last_hash is not None else h[:, :1] + 1, h[:, :-1]), axis=1)
            last_hash = h[:, -1].copy()
            fresh = (h != before).any(axis=0)  # equal rows are neighbours
            if not fresh.all():
                t = t.filter(pa.array(fresh))
            if not t.num_rows:
                continue
            new = t.num_rows
            codes = []
            scored, start, size = _lists(t["scored"].combine_chunks())
            flat = scored[start[0] : start[-1] + size[-1]] if new else scored
            codes.append(pack(SCORED, flat, flat))
            items, start, size = _lists(t["items"].combine_chunks())
            flat = items[start[0] : start[-1] + size[-1]]
            codes.append(pack(WITH_ITEM, flat, flat))
            every = np.arange(new)
            x, y = _cross(items, start, size, every, every)
            codes.append(pack(TOGETHER, x[x < y], y[x < y]))
            if seen < window:
                head = min(window - seen, new)
                yield fragments(t, seen, list(range(head)), [False] * head)
            seen += new
            open_ = t if held is None else pa.concat_tables([held, t])
            old = open_.num_rows - new
            items, start, size = _lists(open_["items"].combine_chunks())
            session = open_["session"].to_numpy()
            for step in range(1, window + 1):
                b = np.arange(max(old, step), open_.num_rows)
                a = b - step
                same = session[a] == session[b]
                x, y = _cross(items, start, size, a[same], b[same])
                codes.append(pack(FOLLOWS, x, y))
            held = open_.slice(max(0, open_.num_rows - window))
            yield counted(codes)
        if held is not None:
            k = held.num_rows
            yield fragments(held, seen - k, list(range(k)), [True] * k)

    return run


def _stitched(parts: DataFrame, window: int) -> DataFrame:
    """Codes of the windows that reach into a later partition, from the partitions' edges.

    An edge record's followers in later partitions are edge records too, so they stand next to it
    once the edges of a session are ordered. 2 x window rows per partition come here.
    """
    edges = parts.where("code is null").groupBy("part", "seq", "session").agg(F.max("is_end").alias("is_end"), F.first("items").alias("items"))
    order = Window.partitionBy("session").orderBy("part", "seq")
    ahead = [F.struct(F.lead("part", s).over(order).alias("part"), F.lead("items", s).over(order).alias("items")) for s in range(1, window + 1)]
    reach = edges.withColumn("ahead", F.array(*ahead)).where("is_end")
    pairs = reach.select("part", "items", F.explode("ahead").alias("to"))
    pairs = pairs.where("to.part > part").select(F.explode("items").alias("x"), F.col("to.items").alias("ys")).select("x", F.explode("ys").alias("y"))
    code = F.expr(f"shiftleft({FOLLOWS}L, 60) | shiftleft(cast(x as bigint), {_ITEM_BITS}) | cast(y as bigint)")
    return pairs.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sums over codes that arrive merged in order."""
    code, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, counts = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        sums = np.add.reduceat(counts, first)
        out_codes, out_sums = codes[first], sums.copy()
        if code is not None:
            if out_codes[0] == code:
                out_sums[0] += total
            else:
                out_codes, out_sums = np.concatenate(([code], out_codes)), np.concatenate(([total], out_sums))
        code, total = int(out_codes[-1]), int(out_sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(out_codes[:-1]), pa.array(out_sums[:-1])], ["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], ["code", "n"])


def counts(records: DataFrame, session: list[str], place: str, items: Column, scored: Column, window: int = 3, distinct: bool = True) -> DataFrame:
    """(kind, x, y, n): records with an item, records scored for it, records with both x < y, and x followed by y.

    ``items`` and ``scored`` are array<int> columns of positive and of scored item numbers. With
    ``distinct``, wholly equal rows count once.
    """
    whole = F.struct(*records.columns)
    rows = records.select(
        *session, F.col(place).alias("_place"), items.alias("items"), scored.alias("scored"),
        (F.xxhash64(whole) if distinct else F.monotonically_increasing_id()).alias("h1"),
        F.xxhash64(F.lit(1), whole).alias("h2"),
    )
    keys = [*session, "_place", "h1", "h2"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = ordered.select("h1", "h2", F.xxhash64(*session).alias("session"), "items", "scored").mapInArrow(
        _window_batches(window), "code bigint, n bigint, part int, seq bigint, is_end boolean, session bigint, items array<int>"
    )
    parts = staged(parts, "pair-runs")
    runs = parts.where("code is not null").select("code", "n").unionByName(_stitched(parts, window))
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merged, "code bigint, n bigint")
    mask = (1 << _ITEM_BITS) - 1
    return merged.select(
        F.expr("cast(shiftrightunsigned(code, 60) as int)").alias("kind"),
        F.expr(f"cast(shiftrightunsigned(code, {_ITEM_BITS}) & {mask} as int)").alias("x"),
        F.expr(f"cast(code & {mask} as int)").alias("y"),
        "n",
    )


def enrichment(tallies: DataFrame, names: DataFrame, window: int = 3) -> DataFrame:
    """(k, x, y, n_x, n_y, scored_y, c_k, enrichment, log_odds) for every direction with a count.

    ``names`` maps item to name. enrichment = (c_k / n_x) / (n_y / scored_y). log_odds compares
    y among records with x to y among the other scored records, with 0.5 added to each cell.
    """
    with_item = tallies.where(F.col("kind") == WITH_ITEM).select(F.col("x").alias("i"), F.col("n").alias("with_item"))
    scored = tallies.where(F.col("kind") == SCORED).select(F.col("x").alias("i"), F.col("n").alias("scored"))
    per_item = names.join(with_item, names["item"] == with_item["i"], "left").drop("i").join(scored, names["item"] == scored["i"], "left").drop("i")
    both = tallies.where(F.col("kind") == TOGETHER)
    together = both.select(F.lit(0).alias("k"), "x", "y", "n").unionByName(both.select(F.lit(0).alias("k"), F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    follows = tallies.where(F.col("kind") == FOLLOWS).select(F.lit(window).alias("k"), "x", "y", "n")
    px = per_item.select(F.col("item").alias("x"), F.col("name").alias("x_name"), F.col("with_item").alias("n_x"))
    py = per_item.select(F.col("item").alias("y"), F.col("name").alias("y_name"), F.col("with_item").alias("n_y"), F.col("scored").alias("scored_y"))
    joined = together.unionByName(follows).join(px, "x").join(py, "y")
    a, b = F.col("n") + 0.5, F.greatest(F.col("n_x") * F.greatest(F.col("k"), F.lit(1)) - F.col("n"), F.lit(0)) + 0.5
    c = F.greatest(F.col("n_y") - F.col("n"), F.lit(0)) + 0.5
    d = F.greatest(F.col("scored_y") - F.col("n_x") - F.col("n_y") + F.col("n"), F.lit(0)) + 0.5
    return joined.select(
        "k", F.col("x_name").alias("x"), F.col("y_name").alias("y"), "n_x", "n_y", "scored_y", F.col("n").alias("c_k"),
        ((F.col("n") / F.col("n_x")) / (F.col("n_y") / F.col("scored_y"))).alias("enrichment"),
        F.log(a * d / (b * c)).alias("log_odds"),
    )
