"""Sinks: tables, quoted CSV, sharded JSON lines, nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transcript_tables(df: DataFrame, path: str) -> None:
    """An index without content and the full table, both by participant."""
    df.drop("content").write.mode("overwrite").partitionBy("participant").parquet(f"{path}/index")
    df.write.mode("overwrite").partitionBy("participant").parquet(f"{path}/full")


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A parquet table, optionally partitioned."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Quoted CSV with header; nulls are empty and doubles may be rounded here, not before."""
    out = df.select(*[F.format_number(c, digits).alias(c) if digits is not None and t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("nullValue", "").option("escape", '"').csv(path)


def csv_by_transcript(df: DataFrame, path: str) -> None:
    """One folder of CSV per participant and source."""
    df.write.mode("overwrite").partitionBy("participant", "source_path").option("header", True).csv(path)


def jsonl(df: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """JSON lines in files of bounded length."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def metrics(per_annotation: DataFrame, key: str = "annotation_id") -> DataFrame:
    """One JSON payload of per-annotation rows (K08); bounded by the number of annotations."""
    rest = [c for c in per_annotation.columns if c != key]
    return per_annotation.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.struct(*rest)))))).alias("payload"))


def cases(values: DataFrame, item: list[str]) -> DataFrame:
    """An item with every annotator's label as a JSON line."""
    return values.groupBy(*item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("annotator", "label")))).alias("labels")).select(F.to_json(F.struct(*item, "labels")).alias("value"))


def flattened(df: DataFrame) -> DataFrame:
    """Columns in name order, nested ones as JSON text, ready for CSV."""
    def flat(name: str, kind: str) -> Column:
        return F.to_json(name).alias(name) if kind.startswith(("array", "map", "struct")) else F.col(name)

    return df.select(*[flat(c, t) for c, t in sorted(df.dtypes)])


def manifest(tasks: DataFrame, path: str, **meta: str) -> None:
    """A header table and a task table (K13); a change of state rewrites the small header only."""
    head = tasks.agg(F.count("*").alias("tasks")).select("tasks", *[F.lit(v).alias(k) for k, v in meta.items()])
    head.write.mode("overwrite").json(f"{path}/meta")
    tasks.write.mode("overwrite").json(f"{path}/tasks")


def pages(messages: DataFrame, path: str, by: list[str], order: str) -> None:
    """One HTML page per file of messages (K11), its conversations in order, each an anchor ``chat-N``; texts are escaped.

    A page is one row, so it must fit a task; pages go to folders named by the file.
    """
    safe = F.col("content")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(mark), F.lit(entity))
    line = F.concat(F.lit("<p><b>"), F.coalesce("role", F.lit("unknown")), F.lit("</b>: "), F.coalesce(safe, F.lit("")), F.lit("</p>"))
    rows = messages.select(*by, "chat_index", F.struct(F.col(order).alias("o"), line.alias("t")).alias("l"))
    chats = rows.groupBy(*by, "chat_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "").alias("t"))
    body = F.concat(F.lit("<h2 id='chat-"), (F.col("chat_index") + 1).cast("string"), F.lit("'></h2>"), "t")
    whole = chats.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chat_index", body.alias("t")))), lambda x: x["t"]), "").alias("value"))
    whole.withColumn("value", F.concat(F.lit("<html>"), "value", F.lit("</html>"))).write.mode("overwrite").partitionBy(*by).text(path)


def latex_table(df: DataFrame, order: list[str]) -> DataFrame:
    """A small table as rows of a LaTeX tabular in one text (K12); bounded by the table, which is a summary."""
    from ..functions.text import latex_escaped

    cells = F.concat_ws(" & ", *[latex_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("_t")))), lambda x: F.concat(x["_t"], F.lit(" \\\\"))), "\n")
    head = " & ".join(df.columns).replace("_", "\\_")
    return df.agg(F.concat(F.lit("\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + head + " \\\\\n"), body, F.lit("\n\\end{tabular}")).alias("tex"))
