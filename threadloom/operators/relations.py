"""Joins, set operations, selection and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import KEY


def attach_content(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Rows with their message's content, empty where there is none."""
    first = content.groupBy(*KEY).agg(F.min_by("content", "row_id").alias("content"))
    return rows.join(first, list(KEY), "left").withColumn("content", F.coalesce("content", F.lit("")))


def only_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Semi join on requested keys."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def unseen(df: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Anti join on keys already done."""
    return df.join(seen.select(*on).distinct(), on, "left_anti")


def checked_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key; a key with several raises."""
    agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value))
    return agg.withColumn(value, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("conflicting values for "), F.col(key).cast("string")))).otherwise(F.col(value))).drop("_n")


def duplicate_groups(df: DataFrame, text: str, group: str) -> DataFrame:
    """Texts that stand in several groups, with counts."""
    per = df.where(F.col(text).isNotNull() & (F.trim(text) != "")).groupBy(text, group).agg(F.count("*").alias("n"))
    return per.groupBy(text).agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).where("groups >= 2")


def overlaps(df: DataFrame, text: str, group: str) -> DataFrame:
    """Per pair of groups the rows they share, sum of the lesser counts.

    Codes of texts are joined, and only of texts that stand in several groups.
    """
    per = df.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(group).isNotNull()).groupBy(F.xxhash64(text).alias("h"), F.md5(text).alias("t"), F.col(group).alias("g")).agg(F.count("*").alias("n"))
    shared = per.join(per.groupBy("h", "t").agg(F.count("*").alias("k")).where("k >= 2").select("h", "t"), ["h", "t"], "left_semi")
    a, b = shared.alias("a"), shared.alias("b")
    j = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.g") < F.col("b.g")))
    return j.groupBy(F.col("a.g").alias("first"), F.col("b.g").alias("second")).agg(F.sum(F.least("a.n", "b.n")).alias("shared"))


def repeated_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group in a stated order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def hashed(seed: int, *key: str) -> Column:
    """An order that depends on seed and key only: the same sample whatever the partitioning."""
    return F.xxhash64(F.lit(seed), *key)


def extremes(df: DataFrame, value: str, tie: str, low: int, high: int) -> DataFrame:
    """The most negative and the most positive rows."""
    down = df.where(F.col(value) < 0).orderBy(F.asc(value), tie).limit(low)
    up = df.where(F.col(value) > 0).orderBy(F.desc(value), tie).limit(high)
    return down.unionByName(up)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered table (O06); cut before anything is attached to its rows."""
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def quotas(sizes: DataFrame, total: int, by: str, size: str = "n", equal: bool = False) -> DataFrame:
    """Largest-remainder allocation of ``total`` over groups, capped by their sizes.

    Proportional shares need no second round for caps; equal shares hand back what a small group
    cannot use in proportion to the room left.
    """
    everything = Window.partitionBy(F.lit(1))
    n = F.col(size).cast("double")
    want = F.least(F.lit(float(total)), F.sum(n).over(everything))
    if equal:
        # Water level: groups in order of size; a group gets an equal share of what is left.
        o = Window.partitionBy(F.lit(1)).orderBy(size, by)
        before = F.coalesce(F.sum(n).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        groups = F.count("*").over(everything)
        ranked = sizes.withColumns({"_w": want, "_rn": F.row_number().over(o), "_level": (want - before) / (groups - F.row_number().over(o) + 1)})
        # The level is that of the first group which exceeds its own.
        first = F.min_by("_level", F.when(F.col(size) > F.col("_level"), F.col("_rn"))).over(everything)
        level = F.coalesce(first, F.max(size).over(everything).cast("double"))
        shared = ranked.withColumn("_share", F.least(F.col(size).cast("double"), level))
    else:
        shared = sizes.withColumns({"_w": want, "_share": want * n / F.sum(n).over(everything)})
    floors = shared.withColumns({"_floor": F.floor("_share"), "_rest": F.col("_share") - F.floor("_share")})
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("_rest", 9)), by))
    left = F.round(F.col("_w") - F.sum("_floor").over(everything))
    out = floors.withColumns({"_rank": rank, "_left": left})
    return out.select(by, size, (F.col("_floor") + F.when((F.col("_rank") <= F.col("_left")) & (F.col("_floor") < F.col(size)), 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified(df: DataFrame, quota: DataFrame, by: str, order: Column, salts: int = 64) -> DataFrame:
    """Rows of each group up to its quota in a stated order.

    A group is first cut to its quota in ``salts`` parts, so one that holds a third of all rows is no single
    task; at most ``salts`` times the quota of a group meet in the second cut.
    """
    part = F.pmod(F.xxhash64(order), F.lit(salts))
    ranked = df.join(quota.select(by, "quota"), by).withColumns({"_o": order, "_part": part})
    some = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "_part").orderBy("_o"))).where("_rn <= quota")
    return some.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("_o"))).where("_rn <= quota").drop("_rn", "_o", "_part", "quota")


def whole_conversations(sizes: DataFrame, total: int, by: str, order: Column) -> DataFrame:
    """Conversations in a stated order until ``total`` messages are reached (O09); the last may exceed it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("length").over(w), F.lit(0))).where(F.col("_before") < total).drop("_before")


def first_match(messages: DataFrame, quotes: DataFrame, on: list[str], quote: str = "quote", content: str = "content", order: str = "message_index") -> DataFrame:
    """Earliest message that contains a quote, case-sensitive hits first."""
    j = messages.join(quotes, on)
    kind = F.when(F.contains(content, quote), 0).when(F.contains(F.lower(content), F.lower(quote)), 1)
    return j.withColumn("_pass", kind).where("_pass IS NOT NULL").groupBy(*on, quote).agg(F.min_by(order, F.struct("_pass", order)).alias(order))


def enrichment_entropy(df: DataFrame, group: str, topic: str) -> DataFrame:
    """Share of each topic in a group, log enrichment over its share in all, entropy of the group."""
    c = df.groupBy(group, topic).agg(F.count("*").alias("n"))
    g = Window.partitionBy(group)
    p = F.col("n") / F.sum("n").over(g)
    overall = c.groupBy(topic).agg(F.sum("n").alias("tn"))
    total = overall.agg(F.sum("tn").alias("alln"))
    s = c.join(overall, topic).crossJoin(F.broadcast(total)).withColumns({"p": p, "q": F.col("tn") / F.col("alln")})
    return s.select(group, topic, "n", "p", F.ln((F.col("p") + 1e-9) / (F.col("q") + 1e-9)).alias("enrichment"), (-F.sum(F.col("p") * F.ln("p")).over(g)).alias("entropy"))


def updated(rows: DataFrame, news: DataFrame, on: list[str], column: str) -> DataFrame:
    """Rows with ``column`` from ``news`` where that has a value (J18); ``news`` has one row per key."""
    return rows.join(news.select(*on, F.col(column).alias("_new")), on, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def score_maps(wide: DataFrame) -> DataFrame:
    """(key, scores): one map of annotation id to score per message, unscored ones left out."""
    names = [c for c in wide.columns if c.startswith("score__")]
    cells = F.filter(F.array(*[F.struct(F.lit(n.removeprefix("score__")).alias("k"), F.col(f"`{n}`").alias("v")) for n in names]), lambda e: e["v"].isNotNull() & ~F.isnan(e["v"]))
    return wide.select(*KEY, cells.alias("_c")).groupBy(*KEY).agg(F.max("_c").alias("_c")).where("size(_c) > 0").select(*KEY, F.map_from_entries("_c").alias("scores"))


def first_wins(rows: DataFrame, other: DataFrame, on: list[str], column: str, order: str) -> DataFrame:
    """Rows with the first value of ``other`` by ``order``, and whether there were several."""
    first = other.groupBy(*on).agg(F.min_by(column, order).alias(column), (F.count("*") > 1).alias("repeated"))
    return rows.join(first, on, "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


def texts_with_quotes(texts: DataFrame, quotes: DataFrame, text: str, quote: str, run: int = 4) -> DataFrame:
    """Rows of both tables where the text contains the quote, whatever the letter case.

    The words inside a quote, its first and last left aside, stand whole in any text that contains it: the first ``run`` of
    them are looked up among the texts' runs of words by an equi-join, and what is found is verified. Quotes
    with fewer words are compared with every text. Null and empty quotes have no rows.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = quotes.where(F.col(quote) != "").withColumn("_w", words(F.col(quote)))
    long, short = asked.where(F.size("_w") >= run + 2), asked.where(F.size("_w") < run + 2).drop("_w")
    anchors = long.withColumn("_g", F.xxhash64(F.array_join(F.slice("_w", 2, run), " "))).drop("_w")
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - run + 1), lambda k: F.xxhash64(F.array_join(F.slice("_w", k, run), " ")))
    runs = texts.withColumn("_w", words(F.col(text))).where(F.size("_w") >= run).withColumn("_g", F.explode(F.array_distinct(grams))).drop("_w")
    holds = F.contains(F.lower(text), F.lower(quote))
    found = runs.join(anchors, "_g").drop("_g").where(holds)
    return found.unionByName(texts.join(short, holds).select(*found.columns))


def with_cached(rows: DataFrame, cache: DataFrame, on: list[str], value: str, make) -> DataFrame:
    """Rows with ``value`` from a cache, and made by the caller's model where the cache has none.

    ``make`` takes the rows to do and adds ``value``; it is the only costly step and sees each missing row once.
    """
    held = cache.where(F.col(value).isNotNull()).groupBy(*on).agg(F.first(value).alias(value))
    there = rows.join(held, on)
    return there.unionByName(make(rows.join(held, on, "left_anti")).select(*there.columns))
