"""Contents that are the same but for white space, letter case, punctuation or field order (problem 3).

Every content is reduced once to integers: a *text code* of its folded letters and digits and, if it
is a pasted record (JSON object, ``key=value; ...``, ``Key: value`` lines), a *record code* of its
sorted (field, value) integer tuples. Codes are pairs of 64-bit hashes, so the integers need no global
numbering pass; 128 bits keep the chance of a false match below 1e-18 for 1e10 contents.

Defined results: null and blank contents fold to the empty text and belong to no group (fewer than 30
letters and digits); repeated rows count as copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import staged
from .components import components

_IGNORED = r"[\p{P}\p{Z}\p{C}$+<=>^`|~]+"
_FIELD = r"[\p{L}_][\p{L}\p{N}_ .\-]{0,39}"
_PAIRS = rf"^\s*{_FIELD}=[^=;\n]*(?:;\s*{_FIELD}=[^=;\n]*)+;?\s*$"
_LINES = rf"^\s*{_FIELD}:[^\n]*(?:\n\s*{_FIELD}:[^\n]*)+\s*$"
MIN_LETTERS = 30


def folded(text: Column) -> Column:
    """Without white space, controls and punctuation, in one letter case; sharp s has no single capital and equals ss."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _IGNORED, "")


def code(value: Column) -> Column:
    """A 128-bit code as a struct of two longs."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def _tuples(pairs: Column, split_at: str) -> Column:
    return F.transform(pairs, lambda x: F.struct(F.substring_index(x, split_at, 1).alias("k"), F.substr(x, F.instr(x, F.lit(split_at)) + 1).alias("v")))


def record_fields(text: Column) -> Column:
    """array<struct<k, v>> of a pasted record, null for prose."""
    bare = F.trim(text)
    json = F.map_entries(F.from_json(bare, "map<string,string>"))
    as_json = F.when(
        F.size(json) >= 2, F.transform(json, lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))
    )
    pairs = F.filter(F.split(bare, r";\s*"), lambda x: x.contains("="))
    lines = F.filter(F.split(bare, r"\r?\n\s*"), lambda x: x.contains(":"))
    return (
        F.when(bare.startswith("{") & bare.endswith("}"), as_json)
        .when(bare.contains("=") & bare.contains(";") & bare.rlike(_PAIRS), _tuples(pairs, "="))
        .when(bare.contains("\n") & bare.contains(":") & bare.rlike(_LINES), _tuples(lines, ":"))
    )


def record_code(text: Column) -> Column:
    """Code of the sorted integer tuples of a record, null for prose."""
    tuples = F.transform(record_fields(text), lambda e: F.xxhash64(F.xxhash64(folded(e["k"])), F.xxhash64(folded(e["v"]))))
    return F.when(record_fields(text).isNotNull(), code(F.array_sort(tuples)))


def coded(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ("row_id",), min_letters: int = MIN_LETTERS) -> DataFrame:
    """``keep`` columns with text_code and record_code; contents under ``min_letters`` are left out."""
    rows = df.select(*keep, F.coalesce(F.col(content), F.lit("")).alias("_c"))
    if min_letters:
        rows = rows.where(F.col("_c").rlike(rf"^(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{{min_letters}}}"))
    return rows.select(*keep, code(folded(F.col("_c"))).alias("text_code"), record_code(F.col("_c")).alias("record_code"))


def _grouped(codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The dictionary with group_code: the record's code where the text is a record, else the text's.

    One text may be read as several records (``a b=c; d=e`` and ``a=b c; d=e``), which makes these the
    same group; such records are joined as components, whose links are few.
    """
    several = dictionary.where("record_code <> other")
    plain = dictionary.withColumn("group_code", F.coalesce("record_code", "text_code")).drop("record_code", "other")
    if several.isEmpty():
        return plain
    links = (
        codes.where("record_code is not null").join(several.select("text_code", F.col("record_code").alias("least")), "text_code")
        .select("least", "record_code").where("least <> record_code").distinct()
    )
    home = components(links)
    return plain.join(home, plain["group_code"] == home["node"], "left").withColumn("group_code", F.coalesce("component", "group_code")).drop("node", "component")


def copies(df: DataFrame, content: str = "content", row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(codes, entries): coded rows, and per repeated text code its group's first row and number of copies.

    The dictionary holds each distinct text once. Text codes that spell the same record are joined
    through the record code; partial aggregation runs before each shuffle, so a group that holds a
    third of all rows arrives as one row per task. Both results are written tables.
    """
    codes = staged(coded(df.select(F.col(row_id).alias("row_id"), F.col(content).alias("content"))), "codes")
    dictionary = (
        codes.groupBy("text_code")
        .agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n"), F.min("record_code").alias("record_code"), F.max("record_code").alias("other"))
        .where("n > 1 or record_code is not null")
    )
    dictionary = staged(dictionary, "dictionary")
    dictionary = _grouped(codes, dictionary)
    groups = dictionary.groupBy("group_code").agg(F.min("first_row_id").alias("first_row_id"), F.sum("n").alias("copies")).where("copies > 1")
    entries = dictionary.select("text_code", "group_code").join(groups, "group_code").select("text_code", "first_row_id", "copies")
    return codes, staged(entries, "entries")


def repeats(df: DataFrame, content: str = "content", row_id: str = "row_id") -> DataFrame:
    """(first_row_id, row_id) of every row that is not the first of its group.

    The join is planned on two written tables, so the planner knows the dictionary's size and splits
    the rows of a hot text over tasks.
    """
    codes, entries = copies(df, content, row_id)
    return codes.join(entries, "text_code").where("row_id <> first_row_id").select("first_row_id", "row_id")


def survivors(df: DataFrame, content: str = "content", row_id: str = "row_id") -> DataFrame:
    """(first_row_id, copies): one row per group with more than one copy."""
    _, entries = copies(df, content, row_id)
    return entries.select("first_row_id", "copies").distinct()
