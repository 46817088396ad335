"""Keys, roles, scores and positives: the tables every analysis starts from.

Null or malformed key parts give null keys, which the builders drop; null scores are unscored; wholly
equal rows of the wide table count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("participant", "source_path", "chat_index", "message_index")
CONVERSATION = KEY[:3]
PREFIX = "score__"
# Spellings of the two roles.
USER_WORDS = ("user", "human", "you")
ASSISTANT_WORDS = ("assistant", "ai", "bot", "model")


def message_key(df: DataFrame, participant: str = "participant", fallback: str | None = None) -> DataFrame:
    """Rows with a complete location key (P01, P02): trimmed participant, integer indices; others are dropped."""
    who = F.nullif(F.trim(F.col(participant)), F.lit(""))
    if fallback and fallback in df.columns:
        who = F.coalesce(who, F.nullif(F.trim(F.col(fallback)), F.lit("")))
    out = df.withColumns({
        "participant": who,
        "chat_index": F.expr("try_cast(chat_index AS INT)"),
        "message_index": F.expr("try_cast(message_index AS INT)"),
    })
    return out.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY))


def coerced_index(name: str) -> Column:
    """An integer index, -1 where it is none."""
    return F.coalesce(F.expr(f"try_cast({name} AS INT)"), F.lit(-1))


def role_word(role: Column) -> Column:
    """user, assistant, or the trimmed lower-case word; null stays null."""
    word = F.lower(F.trim(role))
    return F.when(word.isin(*USER_WORDS), "user").when(word.isin(*ASSISTANT_WORDS), "assistant").otherwise(word)


def scope_list(raw: Column) -> Column:
    """Scope tokens of a comma or semicolon list."""
    return F.filter(F.transform(F.split(F.lower(raw), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def in_scope(role: Column, scope: Column) -> Column:
    """Empty scope takes any role."""
    return F.coalesce((F.size(scope) == 0) | F.array_contains(scope, F.lower(role)), F.lit(False))


def prompt_scope_any(scope: Column) -> Column:
    """Whether a prompt goes to any role: no scope, or both/all."""
    return (F.size(scope) == 0) | F.arrays_overlap(scope, F.array(F.lit("both"), F.lit("all")))


def positive_trunc(score: Column, cutoff: Column) -> Column:
    """Truncated score reaches the cutoff; null is not positive."""
    return F.coalesce(score.cast("int") >= cutoff, F.lit(False))


def positive_float(score: Column, cutoff: Column) -> Column:
    """Plain comparison."""
    return F.coalesce(score >= cutoff, F.lit(False))


def positive_half_even(score: Column, cutoff: Column) -> Column:
    """Half-even rounding before the comparison."""
    return F.coalesce(F.bround(score) >= cutoff, F.lit(False))


def positive_half_up(score: Column, cutoff: Column) -> Column:
    """Half-up rounding, as a viewer shows it."""
    return F.coalesce(F.floor(score + 0.5) >= cutoff, F.lit(False))


def positive_any(score: Column) -> Column:
    """Any score above zero, as summary statistics count it."""
    return F.coalesce(score > 0, F.lit(False))


def quotes_verified(matches: Column, content: Column) -> Column:
    """Every quote stands in the content, and there is one."""
    return F.coalesce((F.size(matches) > 0) & F.forall(matches, lambda m: (m != "") & F.contains(content, m)), F.lit(False))


def messages(wide: DataFrame) -> DataFrame:
    """One row per message of the wide table: key and role word.

    Wholly equal rows are told by two 64-bit codes of the row, so the exchange carries no score column.
    """
    row = F.struct(*wide.columns)
    slim = wide.select(*KEY, "role", F.xxhash64(row).alias("_a"), F.xxhash64(F.lit(1), row).alias("_b"))
    return slim.distinct().select(*KEY, role_word(F.col("role")).alias("role"))


def score_columns(wide: DataFrame) -> list[str]:
    return sorted(c for c in wide.columns if c.startswith(PREFIX))


def long_scores(wide: DataFrame) -> DataFrame:
    """(key, role, annotation_id, score): one row per scored cell."""
    ids = [*KEY, "role"]
    columns = score_columns(wide)
    rows = wide.select(*wide.columns).distinct().withColumn("role", role_word(F.col("role")))
    long = rows.unpivot(ids, columns, "annotation_id", "score")
    return long.where("score IS NOT NULL AND NOT isnan(score)").withColumn("annotation_id", F.substr("annotation_id", F.lit(len(PREFIX) + 1)))


def scored(wide: DataFrame, annotations: DataFrame, cutoffs: DataFrame, check: bool = False) -> DataFrame:
    """Long scores with metadata, cutoff, ``is_pos`` and ``in_scope``.

    With ``check`` a scored annotation without a cutoff raises. The dimension sides are joined by
    equi-joins; the planner broadcasts them while their size allows.
    """
    long = long_scores(wide).join(annotations, "annotation_id").join(cutoffs, "annotation_id", "left" if check else "inner")
    if check:
        long = long.withColumn("cutoff", F.when(F.col("cutoff").isNull(), F.raise_error(F.lit("scored annotation without cutoff"))).otherwise(F.col("cutoff")))
    return long.withColumns({"is_pos": positive_trunc(F.col("score"), F.col("cutoff")), "in_scope": in_scope(F.col("role"), F.col("scope"))})


def pivoted(long: DataFrame, ids: list[str]) -> DataFrame:
    """Long scores back to one wide row per message (K02, A02); the id list is explicit, so no extra job."""
    return long.groupBy(*KEY).pivot("annotation_id", ids).agg(F.max("score"))


def role_split(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Role-masked copies of score columns, base columns kept."""
    role = role_word(F.col("role"))
    return wide.withColumns({f"{PREFIX}{r}-{i}": F.when(role == r, F.col(f"`{PREFIX}{i}`")) for i in ids for r in ("user", "assistant")})


def role_split_metadata(annotations: DataFrame, ids: list[str]) -> DataFrame:
    """Base ids replaced by one id per role in scope."""
    split = annotations.where(F.col("annotation_id").isin(ids)).select("*", F.explode("scope").alias("_r"))
    split = split.where(F.col("_r").isin("user", "assistant")).select(
        F.concat_ws("-", "_r", "annotation_id").alias("annotation_id"), "category", F.array("_r").alias("scope"), "is_harmful"
    )
    return annotations.where(~F.col("annotation_id").isin(ids)).select("annotation_id", "category", "scope", "is_harmful").unionByName(split)


def cutoff_roles(cutoffs: DataFrame) -> DataFrame:
    """Role-specific ids inherit the base cutoff unless they have their own."""
    roles = cutoffs.select("*", F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("_r"))
    made = roles.select(F.concat_ws("-", "_r", "annotation_id").alias("annotation_id"), "cutoff")
    return cutoffs.unionByName(made.join(cutoffs, "annotation_id", "left_anti"))


def analysis_metadata(annotations: DataFrame, categories: tuple[str, ...] = ("test",), ids: tuple[str, ...] = ()) -> DataFrame:
    """Metadata without excluded categories and ids."""
    keep = ~F.lower("category").isin(*categories) if categories else F.lit(True)
    return annotations.where(keep & ~F.col("annotation_id").isin(*ids) if ids else keep)


def without_participants(df: DataFrame, blocked: tuple[str, ...]) -> DataFrame:
    """Participants not on a block list, whatever the letter case (P10)."""
    return df.where(~F.lower("participant").isin(*[b.lower() for b in blocked])) if blocked else df


def display_ids(ids: DataFrame) -> DataFrame:
    """Ids to show: a base id goes where a role-specific one is there."""
    bases = ids.where(F.col("annotation_id").rlike("^(user|assistant)-")).select(F.regexp_replace("annotation_id", "^(user|assistant)-", "").alias("annotation_id"))
    return ids.join(bases.distinct(), "annotation_id", "left_anti")


def in_scope_messages(wide: DataFrame, annotations: DataFrame) -> DataFrame:
    """(key, role, annotation_id): every message with each annotation whose scope takes its role.

    The scope list is exploded per role, so this is an equi-join on the role, not a cross join; an
    empty scope takes every role and is joined to the roles that occur.
    """
    m = messages(wide)
    roles = m.select("role").distinct()
    scopes = annotations.select("annotation_id", F.explode("scope").alias("role")).unionByName(
        annotations.where(F.size("scope") == 0).select("annotation_id").join(roles)
    )
    return m.join(scopes, "role")


def missing_pairs(wide: DataFrame, annotations: DataFrame) -> DataFrame:
    """In-scope (message, annotation) pairs without a score."""
    have = long_scores(wide).select(*KEY, "annotation_id")
    return in_scope_messages(wide, annotations).select(*KEY, "annotation_id").join(have, [*KEY, "annotation_id"], "left_anti")
