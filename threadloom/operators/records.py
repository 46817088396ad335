"""Label records: reading state from them, their statistics, planning and re-checking them.

A record has the message key, role, annotation_id, score, matches (quotes) and error. Null scores are
unscored; records without a full key or an annotation id are left out where a key is needed; an empty
table gives empty results, and one row of zeros where a total is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUOTE_ERROR, matched_quotes, quotes_of_error, stripped, unmatched_quotes
from .model import KEY, in_scope, message_key, positive_trunc, role_word


def annotation_id(raw: Column) -> Column:
    """Trimmed id, null where there is none."""
    return F.nullif(F.trim(raw.cast("string")), F.lit(""))


def role_filter(raw: str | None) -> str | None:
    """user or assistant, None for both (P09); other words raise."""
    word = (raw or "").strip().lower()
    if word in ("", "all", "any", "both", "auto"):
        return None
    if word not in ("user", "assistant"):
        raise ValueError(f"no role: {raw!r}")
    return word


def scope_overrides(values: list[str]) -> dict[str, list[str]]:
    """``id:role1,role2`` texts as id to roles (P25); malformed ones raise."""
    out = {}
    for value in values:
        name, _, roles = value.partition(":")
        words = [r.strip().lower() for r in roles.split(",") if r.strip()]
        if not name.strip() or not words or not {*words} <= {"user", "assistant"}:
            raise ValueError(f"not of the form id:role1,role2: {value!r}")
        out[name.strip()] = words
    return out


def with_scopes(annotations: DataFrame, overrides: dict[str, list[str]]) -> DataFrame:
    """Annotations with some scopes replaced (P25)."""
    scope = F.col("scope")
    for name, roles in overrides.items():
        scope = F.when(F.col("annotation_id") == name, F.array(*[F.lit(r) for r in roles])).otherwise(scope)
    return annotations.withColumn("scope", scope)


def conversation_key(df: DataFrame) -> DataFrame:
    """Rows with participant, source (source_path, else source_file), chat_index; others are dropped."""
    source = [F.nullif(F.trim(c), F.lit("")) for c in ("source_path", "source_file") if c in df.columns]
    out = df.withColumns({"participant": F.nullif(F.trim("participant"), F.lit("")), "source_path": F.coalesce(*source), "chat_index": F.expr("try_cast(chat_index AS INT)")})
    return out.where("participant IS NOT NULL AND source_path IS NOT NULL AND chat_index IS NOT NULL")


def positive_by_matches(matches: Column, score: Column, cutoff: Column | None = None) -> Column:
    """There are quotes and, with a cutoff, the truncated score reaches it."""
    has = F.coalesce(F.size(matches) > 0, F.lit(False))
    return has if cutoff is None else has & positive_trunc(score, cutoff)


def family_state(records: DataFrame, annotations: DataFrame, cutoffs: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(key, role, annotation_id, is_pos) of raw records (P20).

    Records with an error that is not about quotes are left out, and so are unknown annotations,
    incomplete keys and excluded participants. Two records of one annotation on one message, two roles of
    one message and a known annotation without cutoff raise. Everything is one aggregation by
    (annotation, message) and one by message.
    """
    fine = F.col("error").isNull() | (F.col("error") == "") | F.startswith("error", F.lit(QUOTE_ERROR))
    rows = message_key(records.where(fine)).withColumn("annotation_id", annotation_id(F.col("annotation_id")))
    rows = rows.join(annotations.select("annotation_id").distinct(), "annotation_id").join(cutoffs.groupBy("annotation_id").agg(F.max("cutoff").alias("cutoff")), "annotation_id", "left")
    if excluded:
        rows = rows.where(~F.lower("participant").isin(*[x.lower() for x in excluded]))
    no_cutoff = F.raise_error(F.concat(F.lit("no cutoff for "), "annotation_id")).cast("int")
    rows = rows.where(F.col("role").isNotNull()).withColumn("cutoff", F.coalesce("cutoff", no_cutoff))
    pairs = rows.groupBy("annotation_id", *KEY).agg(F.count("*").alias("n"), F.min("role").alias("lo"), F.max("role").alias("role"), F.max(positive_trunc(F.col("score"), F.col("cutoff"))).alias("is_pos"))
    message = Window.partitionBy(*KEY)
    bad = F.when(F.col("n") > 1, "annotation twice on one message").when(F.min("lo").over(message) != F.max("role").over(message), "two roles of one message")
    checked = pairs.withColumn("bad", bad)
    return checked.select(*KEY, F.when(F.col("bad").isNull(), role_word(F.col("role"))).otherwise(F.raise_error(F.col("bad")).cast("string")).alias("role"), "annotation_id", "is_pos")


def run_analysis(analysis: Callable[..., DataFrame], state: DataFrame, **settings) -> DataFrame:
    """An analysis of the caller over the state table (X01, X02): a function of DataFrames, so its plan joins the state's."""
    out = analysis(state, **settings)
    if not isinstance(out, DataFrame):
        raise TypeError("an analysis returns a DataFrame")
    return out


def classified(tasks: DataFrame, complete: Callable[[DataFrame], DataFrame], cutoff: int | None = None) -> DataFrame:
    """Tasks with score, matches and error of a model's answers.

    ``complete`` is the caller's client: tasks with ``prompt`` in, with ``answer`` out. Quotes that do not
    stand in ``content`` become the error about quotes.
    """
    from ..functions.text import response

    read = complete(tasks).withColumn("r", response(F.col("answer")))
    lost = unmatched_quotes(F.col("r.matches"), F.col("content"))
    quoted = F.concat(F.lit(QUOTE_ERROR + ": "), F.array_join(F.transform(lost, lambda q: F.concat(F.lit('"'), q, F.lit('"'))), ", "))
    out = read.select(*tasks.columns, F.col("r.score").alias("score"), matched_quotes(F.col("r.matches"), F.col("content")).alias("matches"), F.coalesce(F.col("r.error"), F.when(F.size(lost) > 0, quoted)).alias("error"))
    return out if cutoff is None else out.withColumn("is_pos", positive_by_matches(F.col("matches"), F.col("score"), F.lit(cutoff)))


def split_thoughts(tasks: DataFrame, complete: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Texts cut into thought and answer by a model that repeats the thought.

    ``complete`` adds ``answer``, the beginning of ``content`` that is thought; quotes, dashes and white space may differ
    in it. Where it is no beginning the whole text is the answer.
    """
    from ..functions.python import prefix_length

    n = F.coalesce("_n", F.lit(0))
    cut = complete(tasks).withColumn("_n", prefix_length("content", "answer"))
    return cut.select(*tasks.columns, F.nullif(stripped(F.substr("content", F.lit(1), n)), F.lit("")).alias("thought"), stripped(F.substr("content", n + 1)).alias("response"))


def rewritten(messages: DataFrame, complete: Callable[[DataFrame], DataFrame], roles: tuple[str, ...] = ("user",)) -> DataFrame:
    """Messages with the content of some roles as a model puts it (X13, X17); null and blank answers change nothing."""
    mine = complete(messages.where(F.col("role").isin(*roles)))
    told = mine.withColumn("content", F.coalesce(F.nullif(stripped(F.col("answer")), F.lit("")), "content")).select(*messages.columns)
    return told.unionByName(messages.where(~F.coalesce(F.col("role").isin(*roles), F.lit(False))))


def scored_subsets(tasks: DataFrame, done: DataFrame, on: list[str], complete: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Subsets not done yet with their three scores (X18); ``complete`` adds ``answer``."""
    from ..functions.text import subset_response

    todo = tasks.join(done.select(*on).distinct(), on, "left_anti")
    return complete(todo).withColumn("_r", subset_response(F.col("answer"))).select(*tasks.columns, "_r.*")


def applicable(messages: DataFrame, annotations: DataFrame, seen: DataFrame, enough: DataFrame | None = None, quota: int = 0) -> DataFrame:
    """(message, annotation) still to be labelled: role in scope, not seen, quota of positives not reached."""
    scopes = annotations.select("annotation_id", F.explode("scope").alias("_r"))
    any_role = annotations.where("size(scope) = 0").select("annotation_id")
    todo = messages.join(scopes, messages["role"] == scopes["_r"]).select(*messages.columns, "annotation_id")
    todo = todo.unionByName(messages.join(any_role).select(*messages.columns, "annotation_id"))
    todo = todo.join(seen.select(*KEY, "annotation_id").distinct(), [*KEY, "annotation_id"], "left_anti")
    if quota > 0 and enough is not None:
        todo = todo.join(enough.where(F.col("positives") >= quota).select("annotation_id"), "annotation_id", "left_anti")
    return todo


def sorted_table(df: DataFrame) -> DataFrame:
    """By participant, source, conversation, place (O01): a range exchange, so files come out in order."""
    return df.orderBy(*KEY)


def family_stats(records: DataFrame, by: list[str] | None = None, cutoff: int | None = None, prefix: str = QUOTE_ERROR) -> DataFrame:
    """Rows, errors (fatal ones and those about quotes) and positives of records (A05), in all or by columns."""
    error = F.coalesce(F.col("error"), F.lit("")) != ""
    quote = error & F.startswith("error", F.lit(prefix))
    positive = F.coalesce(F.col("score").cast("int") >= cutoff if cutoff is not None else F.col("score").cast("int") > 0, F.lit(False))
    counts = {
        "rows": F.count("*"), "errors": F.count_if(error), "fatal": F.count_if(error & ~quote), "quote_errors": F.count_if(quote), "positives": F.count_if(positive),
        "positives_with_error": F.count_if(positive & error), "positives_with_quote_error": F.count_if(positive & quote),
        "positives_with_matches": F.count_if(positive & F.coalesce(F.size("matches") > 0, F.lit(False))),
        "unscored_without_error": F.count_if(F.col("score").isNull() & ~error), "messages": F.count_distinct(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in KEY]),
    }
    return records.groupBy(*(by or [])).agg(*[v.alias(k) for k, v in counts.items()])


def fatal_errors(records: DataFrame, prefix: str = QUOTE_ERROR) -> DataFrame:
    """(error, n) of errors that are not about quotes (A06); the whole histogram, the caller orders and cuts it."""
    return records.where((F.coalesce(F.col("error"), F.lit("")) != "") & ~F.startswith("error", F.lit(prefix))).groupBy("error").agg(F.count("*").alias("n"))


def rechecked(records: DataFrame, content: DataFrame) -> DataFrame:
    """Records with an error about quotes that now (partly) stand in the message: new matches and error.

    ``content`` has the key and content. Other parts of the error (`` | `` between them) are kept; records none of whose
    quotes is found are left out, and so are those without content.
    """
    rows = records.where(F.contains("error", F.lit(QUOTE_ERROR))).withColumn("_q", quotes_of_error(F.col("error"))).where(F.size("_q") > 0)
    j = rows.join(content.where("content <> ''").select(*KEY, F.col("content").alias("_c")), list(KEY))
    j = j.withColumns({"_hit": matched_quotes(F.col("_q"), F.col("_c")), "_miss": unmatched_quotes(F.col("_q"), F.col("_c"))}).where(F.size("_hit") > 0)
    base = F.filter(F.split("error", r" \| "), lambda p: (p != "") & ~F.startswith(F.ltrim(p), F.lit(QUOTE_ERROR)))
    fresh = F.when(F.size("_miss") > 0, F.array(F.concat(F.lit(QUOTE_ERROR + ": "), F.array_join(F.transform("_miss", lambda q: F.concat(F.lit('"'), q, F.lit('"'))), ", ")))).otherwise(F.array().cast("array<string>"))
    held = F.coalesce("matches", F.array().cast("array<string>"))
    return j.withColumns({"matches": F.concat(held, F.array_except(F.array_distinct("_hit"), held)), "error": F.nullif(F.array_join(F.concat(base, fresh), " | "), F.lit(""))}).drop("_q", "_c", "_hit", "_miss")


def request_stats(tasks: DataFrame, by: str) -> DataFrame:
    """Requests, distinct messages, annotations and requests per annotation of each participant or annotation."""
    return tasks.groupBy(by).agg(
        F.count("*").alias("requests"), F.count_distinct(*KEY).alias("messages"), F.count_distinct("annotation_id").alias("annotations"),
        (F.count("*") / F.count_distinct("annotation_id")).alias("per_annotation"),
    )


def token_stats(records: DataFrame, text: Column, per_token: int = 4) -> DataFrame:
    """Rows, tokens and tokens per row of answers, a token being ``per_token`` characters, rounded up."""
    tokens = F.ceil(F.length(F.coalesce(text, F.lit(""))) / per_token)
    return records.agg(F.count("*").alias("rows"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.avg(tokens).alias("per_row"))


def running_before(df: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows with ``<column>_before``, the sum over the earlier rows of their group.

    Rows are cut into ranges of (group, order), so a group that holds a third of all rows spreads over tasks: running sums
    within a range start from the sums of the group's earlier ranges, one row per group and range.
    """
    from ..runtime import staged

    cut = staged(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    ranges = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(by, "_p").agg(*[F.sum(c).alias(c) for c in columns]).select(F.col(by).alias("_by"), F.col("_p").alias("_q"), *[F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    joined = rows.join(sums, rows[by].eqNullSafe(sums["_by"]) & (rows["_p"] == sums["_q"]))
    return joined.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in columns}).drop("_p", "_by", "_q", *[f"_{c}" for c in columns])


def batches(tasks: DataFrame, tokens: str, size: str, order: list[str], by: str, token_budget: int, byte_budget: int) -> DataFrame:
    """Tasks with the number of their batch within ``by``.

    Running totals are cut at multiples of either budget, whichever comes first, so a batch begins where a
    total passes a multiple and holds at most a budget plus its first task; running totals, unlike a greedy
    fill, need no sequential pass over all tasks.
    """
    cut = F.struct(F.floor(F.col(f"{tokens}_before") / token_budget).alias("t"), F.floor(F.col(f"{size}_before") / byte_budget).alias("b"))
    marked = running_before(tasks, by, order, [tokens, size]).withColumn("_cut", cut).drop(f"{tokens}_before", f"{size}_before")
    numbers = marked.select(F.col(by).alias("_by"), F.col("_cut").alias("_c")).distinct().withColumn("batch", F.row_number().over(Window.partitionBy("_by").orderBy("_c")).cast("bigint") - 1)
    return marked.join(numbers, marked[by].eqNullSafe(numbers["_by"]) & (marked["_cut"] == numbers["_c"])).drop("_cut", "_by", "_c")


def pending(manifests: DataFrame) -> DataFrame:
    """Tasks not written yet and the share written of every manifest."""
    return manifests.groupBy("manifest").agg(F.count("*").alias("tasks"), F.count_if("written").alias("written"), F.count_if(~F.col("written")).alias("open"))


def best_matches(matches: DataFrame) -> DataFrame:
    """The row of the highest score_cutoff of each message."""
    return matches.groupBy(*KEY).agg(F.max_by(F.struct("annotation_id", "score", "score_cutoff"), F.struct("score_cutoff", "score", "annotation_id")).alias("b")).select(*KEY, "b.*")


def query_records(long: DataFrame, participant: str | None = None, annotation: str | None = None, least: float | None = None, equal: float | None = None) -> DataFrame:
    """Scored records by participant, annotation and score (P27); every filter reaches the scan."""
    out = long
    for name, value in (("participant", participant), ("annotation_id", annotation), ("score", equal)):
        out = out if value is None else out.where(F.col(name) == value)
    return out if least is None else out.where(F.col("score") >= least)


def harmful_summary(messages: DataFrame, scores: DataFrame, annotations: DataFrame, subset: list[str], cutoff: int, early: int) -> DataFrame:
    """Per subset its harmful annotations, the earliest turn with one and whether that is early.

    ``messages`` has the key and ``turn``; scores are rounded half-even before the cutoff.
    """
    harmful = scores.join(annotations.where("is_harmful").select("annotation_id"), "annotation_id").where(F.bround("score") >= cutoff)
    hits = messages.where("turn IS NOT NULL").join(harmful.select(*KEY, "annotation_id"), list(KEY))
    return hits.groupBy(*subset).agg(F.array_sort(F.collect_set("annotation_id")).alias("harmful"), F.min("turn").alias("earliest")).withColumn("is_early", F.col("earliest") < early)


def numbered(df: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """Rows with their number ``row`` from 1 in a stated order.

    Without ``by`` the number is a prefix sum over range partitions: partition sizes go to the driver, one per
    partition, and no row leaves its task.
    """
    if by is not None:
        return df.withColumn("row", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    from ..runtime import staged

    ordered = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "numbered")
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first")).orderBy("_p").collect()
    base, rows = 0, []
    for r in sizes:
        rows.append((r["_p"], r["first"], base))
        base += r["n"]
    starts = df.sparkSession.createDataFrame(rows or [(-1, 0, 0)], "_p int, _first bigint, _base bigint")
    return ordered.join(starts, "_p").withColumn("row", F.col("_base") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_first", "_base")


def demographics(people: DataFrame) -> DataFrame:
    """One row per measure (A38): age count, min, max, mean, median; per gender count and share of those stated."""
    age = people.where("age IS NOT NULL").agg(
        F.count("*").cast("double").alias("count"), F.min("age").cast("double").alias("min"), F.max("age").cast("double").alias("max"), F.avg("age").alias("mean"), F.median("age").alias("median")
    ).unpivot([], ["count", "min", "max", "mean", "median"], "measure", "value")
    stated = people.where("trim(gender) <> ''").withColumn("gender", F.trim("gender"))
    total = stated.agg(F.count("*").alias("_n"))
    gender = stated.groupBy("gender").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return (
        age.where("value IS NOT NULL").select(F.lit("age").alias("topic"), "measure", "value")
        .unionByName(gender.select(F.lit("gender").alias("topic"), F.concat("gender", F.lit(" count")).alias("measure"), F.col("n").cast("double").alias("value")))
        .unionByName(gender.select(F.lit("gender").alias("topic"), F.concat("gender", F.lit(" percentage")).alias("measure"), (100 * F.col("n") / F.col("_n")).alias("value")))
    )


def highest_rate(frequencies: DataFrame, mean: str, sd: str, n: str) -> DataFrame:
    """The greatest mean plus 1.96 standard errors, 0 at least."""
    upper = F.col(mean) + F.when(F.col(n) > 0, 1.96 * F.col(sd) / F.sqrt(n)).otherwise(0.0)
    return frequencies.agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(~F.isnan(upper), upper)), F.lit(0.0))).alias("highest"))


def role_view(frequencies: DataFrame, annotations: DataFrame, role: str) -> DataFrame:
    """Rates of one role of the annotations whose scope takes it, under the common column name."""
    scoped = frequencies.join(annotations.select("annotation_id", "scope"), "annotation_id").where(in_scope(F.lit(role), F.col("scope")))
    return scoped.where(F.col(f"rate_{role}").isNotNull()).select("annotation_id", F.col(f"rate_{role}").alias("rate"))


def agreement_rows(metrics: DataFrame, section: str, keep_humans: bool = True, label: str = "Humans (all annotators)") -> DataFrame:
    """Rows of one section, optionally without the row of all humans."""
    out = metrics.where(F.col("section") == section)
    return out if section != "inter_annotator" or keep_humans else out.where(F.col("row_label") != label)


def conversations(messages: DataFrame, name: str) -> DataFrame:
    """Per conversation its bucket, label, date, length and points (place, size) in order."""
    from ..functions.text import bucket

    points = F.array_sort(F.collect_list(F.struct("message_index", F.length(F.coalesce("content", F.lit(""))).alias("size"))))
    return messages.groupBy(*KEY[:3]).agg(F.max("chat_key").alias("label"), F.max("chat_date").alias("date"), F.count("*").alias("length"), points.alias("points")).withColumn(name, bucket(F.col("source_path")))


def by_date(chats: DataFrame, group: list[str], when: str, key: str, order: str) -> DataFrame:
    """Chats with their place in ``group``: newest first, later key first on ties, or as they came if any has no date."""
    whole = Window.partitionBy(*group)
    dated = F.min(F.col(when).isNotNull()).over(whole)
    place = Window.partitionBy(*group).orderBy(F.when(F.col("_dated"), -F.unix_micros(when)), F.when(F.col("_dated"), F.lower(key)).desc(), order)
    return chats.withColumn("_dated", dated).withColumn("place", F.row_number().over(place)).drop("_dated")


def latest_per_group(df: DataFrame, group: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each group, the greater name on ties."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(when, tie)).alias("_r")).select(*group, "_r.*")


def around(df: DataFrame, ts: str, centre: Column, half: str) -> DataFrame:
    """Rows at most ``half`` before or after a moment, both ends included, in order of time."""
    width = F.expr(f"INTERVAL {half}")
    return df.where(F.col(ts).between(centre - width, centre + width))
