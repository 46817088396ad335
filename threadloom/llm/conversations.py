"""Rebuilding conversations from message rows and finding the unusable ones (problem 6).

Defined results: a row whose chat_index is null belongs to the conversation its chat_key is linked to,
directly or over other rows; where no row of the component bears an index it stays null and ``lost_chat``,
the chat_key, tells these conversations of a file apart (null for all others). Rows without
message_index fill free places by their instants (see ``broken``). Null content has no visible text and
equals blank content. Repeated rows agree with themselves. An empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.timestamps import label_instants, with_clocks
from ..runtime import staged
from .components import components
from .sameness import code, folded, record_code

# Usual words for the speakers.
PERSON = (
    "user human you person me client customer participant patient student visitor guest member speaker prompt question "
    "usuario usuaria persona humano humana benutzer benutzerin nutzer nutzerin mensch utilisateur utilisatrice humain"
).split()
MACHINE = (
    "assistant ai bot model machine chatbot agent robot llm gpt chatgpt claude gemini bard copilot companion answer response "
    "asistente modelo maquina máquina assistent assistentin maschine modell ki ia modèle"
).split()
SYSTEM = ["system", "sistema", "systeme", "système"]
CONVERSATION = ("participant", "source_path", "chat_index", "lost_chat")


def speaker(role: Column) -> Column:
    """person, machine or system; null where the word is none of these."""
    word = F.lower(F.regexp_replace(role, r"[^\p{L}]+", ""))
    return F.when(word.isin(PERSON), "person").when(word.isin(MACHINE), "machine").when(word.isin(SYSTEM), "system")


def visible(text: Column) -> Column:
    """Has a character other than white space and zero-width characters."""
    return F.coalesce(text.rlike(r"[^\p{Z}\p{Cf}\s\x{0085}\x{180E}\x{2800}]"), F.lit(False))


def rebuilt(messages: DataFrame) -> DataFrame:
    """Rows with their conversation's index, speaker, visibility and content codes (a written table).

    Chat keys and chat indices are nodes, rows that carry both are links; the components tell which
    conversation a row without index belongs to.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    base = staged(
        messages.select(
            "row_id", "participant", "source_path", "chat_index", "chat_key", "message_index", "timestamp", "ingested_at",
            speaker(F.col("role")).alias("speaker"), visible(F.col("content")).alias("visible"),
            code(folded(text)).alias("text_code"), record_code(text).alias("record_code"),
        ),
        "rows",
    )
    lost = base.where("chat_index is null")
    if lost.isEmpty():
        return base.withColumn("lost_chat", F.lit(None).cast("string"))
    index_node = F.concat_ws("\u0001", "participant", "source_path", F.lit("0"), F.format_string("%012d", "chat_index"))
    key_node = F.concat_ws("\u0001", "participant", "source_path", F.lit("1"), "chat_key")
    # Only files with lost rows can matter: their links are few beside all links.
    files = lost.select("participant", "source_path").distinct()
    links = (
        base.where("chat_index is not null and chat_key is not null")
        .select("participant", "source_path", "chat_index", "chat_key").distinct()
        .join(files, ["participant", "source_path"], "left_semi")
        .select(index_node.alias("i"), key_node.alias("k"))
    )
    home = components(links).where(F.col("node").contains("\u00011\u0001") & F.col("component").contains("\u00010\u0001"))
    home = home.select(F.col("node").alias("_node"), F.element_at(F.split("component", "\u0001"), -1).cast("int").alias("_index"))
    found = lost.withColumn("_node", key_node).join(home, "_node", "left").withColumn("chat_index", F.col("_index")).drop("_node", "_index")
    found = staged(found.select(*base.columns), "found")
    # A key that is linked to no index is a component of its own.
    return base.where("chat_index is not null").unionByName(found).withColumn("lost_chat", F.when(F.col("chat_index").isNull(), F.col("chat_key")))


def broken(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Per unusable conversation its key and the reasons; see the module for the odd cases.

    Everything is aggregated in three steps, (conversation, place, text), (conversation, place),
    conversation, each with partial aggregation: no conversation is gathered in one task. Only
    conversations with rows that lack message_index have their time labels parsed: with F free places
    up to the largest index, rows later than the last indexed instant extend the conversation, the
    others fill the free places; a place stays free if there are fewer of them than F.
    """
    return _broken(rebuilt(messages), files)[0]


def _broken(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The unusable conversations of rebuilt rows, and the instants that ``_timed`` read for them."""
    conv = list(CONVERSATION)
    places = (
        rows.groupBy(*conv, "message_index", "text_code")
        .agg(
            F.min("record_code").alias("record_code"),
            F.max("record_code").alias("other"),
            F.max(F.col("speaker").isNull()).alias("nobody"),
            F.max((F.col("speaker") == "machine") & ~F.col("visible")).alias("mute"),
            F.max((F.col("speaker") == "person") & F.col("visible")).alias("asked"),
            F.max(F.when(F.col("visible") & (F.col("speaker") != "system"), F.col("speaker"))).alias("said_by"),
        )
        .withColumns({"g": F.coalesce("record_code", "text_code"), "h": F.coalesce("other", "text_code")})
        .groupBy(*conv, "message_index")
        .agg(
            ((F.min("g") != F.max("g")) & (F.min("h") != F.max("h"))).alias("clash"),
            *[F.max(c).alias(c) for c in ("nobody", "mute", "asked", "said_by")],
        )
    )
    placed = F.col("message_index") >= 0
    chats = places.groupBy(*conv).agg(
        F.coalesce(F.max("message_index") + 1, F.lit(0)).alias("length"),
        F.count_if(placed).alias("taken"),
        F.max(F.coalesce(F.col("clash") & placed, F.lit(False))).alias("clash"),
        F.max("nobody").alias("nobody"),
        F.max("mute").alias("mute"),
        F.max("asked").alias("asked"),
        F.max_by("said_by", F.when(placed & F.col("said_by").isNotNull(), F.col("message_index"))).alias("last"),
    )
    timed = _timed(rows, files)
    loose = None if timed is None else _loose(timed)
    judged = (
        chats if loose is None else chats.join(loose, [chats[c].eqNullSafe(loose["_" + c]) for c in conv], "left")
    )
    if loose is None:
        judged = judged.withColumns({"inner": F.lit(0), "loose": F.lit(0), "late": F.lit(None).cast("string")})
    free = F.col("length") - F.col("taken")
    gap = F.coalesce(F.col("inner"), F.lit(0)) < free
    last = F.when(F.col("late").isNotNull() & ((F.coalesce("loose", F.lit(0)) > free) | F.col("late_is_last")), F.col("late")).otherwise(F.col("last")) if loose is not None else F.col("last")
    reasons = {
        "unknown_speaker": F.coalesce(F.col("nobody"), F.lit(False)),
        "missing_place": gap,
        "clash": F.col("clash"),
        "empty_reply": F.coalesce(F.col("mute"), F.lit(False)),
        "no_person": ~F.coalesce(F.col("asked"), F.lit(False)),
        "no_reply": F.coalesce(last == "person", F.lit(False)),
    }
    return judged.select(*[chats[c] for c in conv], *[v.alias(k) for k, v in reasons.items()]).where(" or ".join(reasons)), timed


def _timed(rows: DataFrame, files: DataFrame) -> DataFrame | None:
    """Rows of the conversations with rows that lack message_index, with the instant t of each label."""
    lacking = rows.where("message_index is null")
    if lacking.isEmpty():
        return None
    conv = list(CONVERSATION)
    touched = lacking.select(*[F.col(c).alias("_" + c) for c in conv]).distinct()
    near = rows.join(touched, [rows[c].eqNullSafe(touched["_" + c]) for c in conv], "left_semi")
    timed = label_instants(
        with_clocks(near.drop("chat_key"), files).drop("chat_date"),
        fields=("timestamp",),
        keep=(*conv, "message_index", "speaker", "visible", "text_code", "row_id"),
        zone="clock",
        day_first="day_first",
    ).withColumn("t", F.col("utc_second"))
    return staged(timed, "timed")


def _instants(timed: DataFrame) -> DataFrame:
    """Per conversation and text the distinct instants of rows that lack message_index; copies share a group.

    Labels differ in precision, so instants less than a minute after the one before them are copies.
    """
    conv = list(CONVERSATION)
    distinct = timed.where("message_index is null and t is not null").groupBy(*conv, "text_code", "t").agg(F.max("speaker").alias("speaker"), F.max("visible").alias("visible"))
    order = Window.partitionBy(*conv, "text_code").orderBy("t")
    fresh = F.coalesce(F.col("t") - F.lag("t").over(order) >= 60, F.lit(True))
    return distinct.withColumn("fresh", fresh.cast("int")).withColumn("copy", F.sum("fresh").over(order)).drop("fresh")


def _bare(timed: DataFrame) -> DataFrame:
    """Per conversation the texts with an instant t but no message_index that need a place of their own."""
    conv = list(CONVERSATION)
    has_index = timed.where("message_index is not null")
    # A copy of a row that has its index needs no place of its own; copies of each other share one.
    bare = _instants(timed).groupBy(*conv, "text_code", "copy").agg(F.max("t").alias("t"), F.max("speaker").alias("speaker"), F.max("visible").alias("visible"))
    b, i = bare.alias("b"), has_index.where("t is not null").select(*conv, "text_code", F.col("t").alias("ti")).alias("i")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"i.{c}")) for c in (*conv, "text_code")]
    return b.join(i, [*same, F.abs(F.col("b.t") - F.col("i.ti")) < 60], "left_anti")


def _loose(timed: DataFrame) -> DataFrame:
    """Per conversation with rows that lack message_index: how many fill places, and who speaks latest."""
    conv = list(CONVERSATION)
    has_index, bare = timed.where("message_index is not null"), _bare(timed)
    talk = F.col("visible") & F.col("speaker").isin("person", "machine")
    ends = has_index.groupBy(*conv).agg(
        F.max("t").alias("t_max"), F.max_by("t", F.when(talk, F.col("message_index"))).alias("t_last")
    )
    both = bare.alias("b").join(ends.alias("e"), [F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}")) for c in conv], "left").select("b.*", "t_max", "t_last")
    return (
        both.groupBy(*conv)
        .agg(
            F.count_if(~F.coalesce(F.col("t") > F.col("t_max"), F.lit(False))).alias("inner"),
            F.count("*").alias("loose"),
            F.max_by("speaker", F.when(talk, F.col("t"))).alias("late"),
            F.coalesce(F.max(F.when(talk, F.col("t"))) > F.coalesce(F.max("t_last"), F.max("t_max")), F.lit(True)).alias("late_is_last"),
        )
        .select(*[F.col(c).alias("_" + c) for c in conv], "inner", "loose", "late", "late_is_last")
    )


def _placed(timed: DataFrame) -> DataFrame:
    """(row_id, place) of the rows of ``_timed`` that lack message_index; place is null where nothing shows it.

    A copy of an indexed row has its place, the one of the nearest instant. The others are ranked by their
    instants: those up to the last indexed instant take the free places in this order, the rest (and what
    the free places do not hold) follow the largest index. A row without instant has a place only if all
    rows of its text have the same one.
    """
    conv = list(CONVERSATION)
    on = lambda a, b, *more: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*conv, *more)]
    has_index = timed.where("message_index is not null")
    lacking = timed.where("message_index is null")
    lacking = lacking.alias("l").join(_instants(timed).alias("n"), on("l", "n", "text_code", "t"), "left").select("l.*", "n.copy")
    taken = has_index.where("message_index >= 0").select(*conv, "message_index").distinct()
    by_place = Window.partitionBy(*conv).orderBy("message_index")
    # Free places as ranges: from, how many, and how many are free before them.
    gaps = (
        taken.withColumn("start", F.coalesce(F.lag("message_index").over(by_place), F.lit(-1)) + 1)
        .withColumn("size", F.col("message_index") - F.col("start"))
        .where("size > 0")
        .withColumn("before", F.sum("size").over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .select(*conv, "start", "size", "before")
    )
    ends = has_index.groupBy(*conv).agg(
        F.max("t").alias("t_max"), F.coalesce(F.max("message_index"), F.lit(-1)).alias("top"),
        F.count_distinct(F.when(F.col("message_index") >= 0, F.col("message_index"))).alias("held"),
    )
    bare = (
        _bare(timed).alias("b").join(ends.alias("e"), on("b", "e"), "left")
        .select("b.*", F.coalesce(F.greatest("top", F.lit(-1)), F.lit(-1)).alias("top"), F.coalesce("held", F.lit(0)).alias("held"),
                F.coalesce(F.col("b.t") > F.col("t_max"), F.lit(False)).alias("later"))
        .withColumn("free", F.col("top") + 1 - F.col("held"))
    )
    ranked = bare.withColumn("rank", F.row_number().over(Window.partitionBy(*conv, "later").orderBy("t", "text_code", "copy")) - 1)
    ranked = ranked.withColumn("fills", ~F.col("later") & (F.col("rank") < F.col("free")))
    behind = Window.partitionBy(*conv, "fills").orderBy("t", "text_code", "copy")
    ranked = ranked.withColumn("tail", F.col("top") + F.row_number().over(behind))
    own = (
        ranked.alias("r").join(gaps.alias("g"), [*on("r", "g"), F.col("r.fills"), F.col("r.rank") >= F.col("g.before"), F.col("r.rank") < F.col("g.before") + F.col("g.size")], "left")
        .select("r.text_code", *[f"r.{c}" for c in conv], "r.copy", F.when(F.col("r.fills"), F.col("g.start") + F.col("r.rank") - F.col("g.before")).otherwise(F.col("r.tail")).alias("own"))
    )
    # Copies of an indexed row are within a minute of it, as in ``_bare``.
    copies = (
        lacking.alias("l").join(has_index.alias("i"), [*on("l", "i", "text_code"), F.abs(F.col("l.t") - F.col("i.t")) < 60])
        .groupBy("l.row_id").agg(F.min_by("i.message_index", F.struct(F.abs(F.col("l.t") - F.col("i.t")), "i.message_index")).alias("copied"))
    )
    told = (
        lacking.alias("l").join(own.alias("o"), on("l", "o", "text_code", "copy"), "left").select("l.*", "own").join(copies, "row_id", "left")
        .withColumn("place", F.coalesce("copied", "own"))
    )
    one = (
        told.select(*conv, "text_code", F.col("place").alias("p")).unionByName(has_index.select(*conv, "text_code", F.col("message_index").alias("p")))
        .groupBy(*conv, "text_code").agg(F.min("p").alias("least"), F.max("p").alias("most"))
    )
    timeless = F.when(F.col("t").isNull() & (F.col("least") == F.col("most")), F.col("least"))
    return told.alias("l").join(one.alias("o"), on("l", "o", "text_code"), "left").select("l.row_id", F.coalesce("l.place", timeless).cast("int").alias("place"))


def ordered(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Every place of the usable conversations: conversation key, place, speaker and row_id of its first delivery.

    Rows that lack message_index have the place that ``_placed`` gives them, and null where nothing shows
    one; rows of null place count as one only if their content is the same.
    """
    rows = rebuilt(messages)
    bad, timed = _broken(rows, files)
    bad = bad.select(*[F.col(c).alias("_" + c) for c in CONVERSATION])
    if timed is not None:
        places = _placed(timed).withColumnRenamed("row_id", "_row")
        lacking = rows.where("message_index is null").join(places, F.col("row_id") == F.col("_row"), "left").withColumn("message_index", F.col("place"))
        rows = rows.where("message_index is not null").unionByName(lacking.drop("_row", "place"))
    kept = rows.join(bad, [rows[c].eqNullSafe(bad["_" + c]) for c in CONVERSATION], "left_anti")
    kept = kept.withColumn("_text", F.when(F.col("message_index").isNull(), F.col("text_code")))
    return kept.groupBy(*CONVERSATION, "message_index", "_text").agg(F.max("speaker").alias("speaker"), F.min("row_id").alias("row_id")).drop("_text")
