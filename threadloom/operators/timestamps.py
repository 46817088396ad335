"""Mixed time labels to instants: formats, precisions, zones, and zones estimated where none is known.

A *label* is any string that an export put where a time belongs. ``classify`` recognises its form;
``label_instants`` turns two label columns of a table into UTC seconds with a status per label.

Results for the odd cases:

* null, empty and blank labels have status ``empty`` and no instant;
* words, placeholders, times without a date and months without a day are ``incomplete`` or ``no_time``;
* dates or clock times that cannot be are ``impossible``;
* local times that the clock showed twice are ``ambiguous``, those it never showed ``skipped``;
* everything else is ``instant``. Repeated rows are kept: one output row per input row and label.

Where a file's clock is unknown, :func:`estimate_histories` tries each candidate zone's offset history
against the order of the messages and the ingestion time and takes the history of zones that violates least;
a clock may move from one zone to another inside a file.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Month names (English, German, Spanish, French), by their first letters.
_MONTH_WORDS = (
    "january february march april may june july august september october november december;"
    "januar februar märz april mai juni juli august september oktober november dezember;"
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre;"
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
)
MONTHS: dict[str, int] = {}
for _row in _MONTH_WORDS.split(";"):
    for _n, _word in enumerate(_row.split(), 1):
        MONTHS[_word] = _n
        MONTHS.setdefault(_word[:3], _n)
        MONTHS.setdefault(_word[:4], _n)

# Hours east of UTC of the usual zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "JST": 9, "KST": 9, "SGT": 8, "AWST": 8, "ACST": 9.5,
    "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "EST": -5, "EDT": -4, "CST": -6,
    "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10, "BRT": -3,
}

#: Zones tried where a file's clock is unknown.
CANDIDATE_ZONES = (
    "UTC", "Europe/London", "Europe/Berlin", "America/New_York", "America/Chicago", "America/Denver",
    "America/Los_Angeles", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney",
)

STATUSES = ("instant", "empty", "no_time", "incomplete", "impossible", "ambiguous", "skipped")

_ZONE = r"(?:\s*(Z|\[?[A-Za-z]+/[A-Za-z_/+\-0-9]+\]?|(?:UTC|GMT)?\s?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,5}))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\b\.?)?(?:\s+Uhr)?"
_GAP = r"(?:,\s*|\s+)(?:(?:at|um|a las|à)\s+)?"

NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?")
ISO = re.compile(rf"(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:(?:[Tt]|,?\s+){_CLOCK}{_ZONE})?")
COMPACT = re.compile(rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE}")
NUMERIC = re.compile(rf"(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:{_GAP}{_CLOCK}{_ZONE})?")
MONTH_FIRST = re.compile(
    rf"(?:[^\W\d_]{{2,10}}\.?,\s*)?([^\W\d_]{{3,10}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:{_GAP}{_CLOCK}{_ZONE})?"
)
DAY_FIRST = re.compile(
    rf"(?:[^\W\d_]{{2,10}}\.?,\s*)?(\d{{1,2}})(?:\.|st|nd|rd|th)?[\s-]+(?:de\s+)?([^\W\d_]{{3,10}})\.?,?[\s-]+(?:de\s+)?(\d{{4}}|\d{{2}})"
    rf"(?:{_GAP}{_CLOCK}{_ZONE})?"
)
INCOMPLETE = re.compile(r"\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?|\d{4}-\d{1,2}(?:-\?+)?|[^\W\d_]{3,10}\.?\s+\d{4}|\d{4}-\?+(?:-\?+)?")
_OFFSET = re.compile(r"(?:UTC|GMT)?\s?([+-])(\d{1,2})(?::?(\d{2}))?")
_FORMS = (ISO, NUMBER, NUMERIC, MONTH_FIRST, DAY_FIRST, COMPACT, INCOMPLETE)
_SHAPE = str.maketrans("0123456789", "9999999999")
_EPOCH = dt.date(1970, 1, 1).toordinal()


def _clock(hour, minute, second, half):
    """Seconds of the day, or None where no clock shows that."""
    h, m, s = int(hour), int(minute), int(second or 0)
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half in "Pp" else 0)
    return None if h > 23 or m > 59 or s > 59 else h * 3600 + m * 60 + s


def _zone(text: str):
    """Seconds east of UTC, or the name of a zone, or None where the text names neither."""
    text = text.strip().strip("[]")
    if "/" in text:
        return text
    if (hours := ABBREVIATIONS.get(text)) is not None:
        return int(hours * 3600)
    if m := _OFFSET.fullmatch(text):
        h, mi = int(m[2]), int(m[3] or 0)
        if h <= 15 and mi < 60:
            return (h * 3600 + mi * 60) * (-1 if m[1] == "-" else 1)
    return None


def _number(text: str):
    value = float(text) if "." in text else int(text)
    if value <= 0:
        return "no_time", None, None
    whole = int(text.partition(".")[0])
    digits = len(str(whole))
    # Up to 11 digits are seconds, up to 14 thousandths, more are millionths.
    return "instant", (whole if digits <= 11 else whole // 1000 if digits <= 14 else whole // 1_000_000), 0


def classify(label: str, day_first: bool = True, shapes: dict | None = None):
    """(status, seconds, zone) of a label without surrounding space.

    status ``instant``: zone is seconds east of UTC (seconds are still local) or a zone's name, or None
    for the clock of the file; seconds count from 1970 on the label's own clock.
    """
    shape = label.translate(_SHAPE)
    form = shapes.get(shape) if shapes is not None else None
    m = form.fullmatch(label) if form is not None else None
    if m is None:
        for form in _FORMS:
            if m := form.fullmatch(label):
                break
        else:
            return "no_time", None, None
        if shapes is not None and len(shapes) < 4096:
            shapes[shape] = form
    if form is NUMBER:
        return _number(label)
    if form is INCOMPLETE:
        return "incomplete", None, None
    g = m.groups()
    if form is COMPACT:
        year, month, day, clock, zone = int(g[0]), int(g[1]), int(g[2]), (g[3], g[4], g[5], None), g[7]
    else:
        clock, zone = (g[3], g[4], g[5], g[7]), g[8]
        if form is ISO:
            year, month, day = int(g[0]), int(g[1]), int(g[2])
        elif form is NUMERIC:
            day, month = (int(g[0]), int(g[1])) if day_first else (int(g[1]), int(g[0]))
            year = int(g[2]) + (2000 if len(g[2]) == 2 else 0)
        else:
            word, number = (g[0], g[1]) if form is MONTH_FIRST else (g[1], g[0])
            month = MONTHS.get(word.lower())
            if month is None:
                return "no_time", None, None
            day, year = int(number), int(g[2]) + (2000 if len(g[2]) == 2 else 0)
    try:
        days = dt.date(year, month, day).toordinal() - _EPOCH
    except ValueError:
        return "impossible", None, None
    if clock[0] is None:
        return "instant", days * 86400, None if zone is None else _zone(zone)
    of_day = _clock(*clock)
    if of_day is None:
        return "impossible", None, None
    if zone is not None and (zone := _zone(zone)) is None:
        return "no_time", None, None
    return "instant", days * 86400 + of_day, zone


_DATETIME = dt.datetime(1970, 1, 1)


def to_utc(seconds: int, zone: str, zones: dict, date_only: bool = False):
    """(status, UTC seconds) of local seconds on the clock of a named zone."""
    tz = zones.get(zone, 0)
    if tz == 0:
        try:
            tz = ZoneInfo(zone)
        except Exception:  # an unknown name denotes no instant
            tz = None
        zones[zone] = tz
    if tz is None:
        return "no_time", None
    try:
        local = _DATETIME + dt.timedelta(seconds=seconds)
        first = tz.utcoffset(local.replace(tzinfo=tz))
        second = tz.utcoffset(local.replace(tzinfo=tz, fold=1))
    except (OverflowError, ValueError):
        return "impossible", None
    if first == second:
        return "instant", seconds - (first.days * 86400 + first.seconds)
    # Going forward the clock skips what it reads, going back it shows it twice.
    if date_only:  # the day starts at the first instant that bears its date
        return "instant", seconds - int(first.total_seconds())
    return ("skipped" if second > first else "ambiguous"), None


def _is_date_only(label: str) -> bool:
    return ":" not in label and "T" not in label[8:9]


def parse_batches(fields: tuple[str, ...], keep: tuple[str, ...], all_statuses: bool):
    """An Arrow function: keep columns + (zone, day_first, labels) to one row per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict = {}
        zones: dict = {}
        for batch in batches:
            zone_of = batch.column("_zone").to_pylist()
            order = batch.column("_day_first").to_pylist()
            index, names, seconds, states = [], [], [], []
            for field in fields:
                memo: dict = {}
                for i, label in enumerate(batch.column(field).to_pylist()):
                    key = (label, zone_of[i], order[i])
                    hit = memo.get(key)
                    if hit is None:
                        text = label.strip() if label is not None else ""
                        if not text:
                            hit = ("empty", None)
                        else:
                            status, value, zone = classify(text, order[i], shapes)
                            if status != "instant":
                                hit = (status, None)
                            elif isinstance(zone, int):
                                hit = (status, value - zone)
                            else:
                                hit = to_utc(value, zone or zone_of[i] or "UTC", zones, _is_date_only(text))
                        memo[key] = hit
                    if all_statuses or hit[0] == "instant":
                        index.append(i)
                        names.append(field)
                        states.append(hit[0])
                        seconds.append(hit[1])
            at = pa.array(index, pa.int64())
            columns = [batch.column(k).take(at) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(seconds, pa.int64()), pa.array(states, pa.string())],
                [*keep, "field_name", "utc_second", "status"],
            )

    return run


def label_instants(
    df: DataFrame,
    fields: tuple[str, ...] = ("timestamp", "chat_date"),
    keep: tuple[str, ...] = ("row_id",),
    zone: str | None = None,
    day_first: str | None = None,
    all_statuses: bool = True,
) -> DataFrame:
    """One row per row and label: ``keep`` columns, field_name, utc_second, status.

    ``zone`` and ``day_first`` name columns of ``df`` with the clock's zone (null: UTC) and whether
    numeric dates with the year last put the day first (null: true). One pass, no shuffle.
    """
    source = df.select(
        *[F.col(f"`{k}`") for k in dict.fromkeys((*keep, *fields))],
        (F.col(zone) if zone else F.lit(None).cast("string")).alias("_zone"),
        (F.coalesce(F.col(day_first), F.lit(True)) if day_first else F.lit(True)).alias("_day_first"),
    )
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "field_name string", "utc_second bigint", "status string"])
    return source.mapInArrow(parse_batches(tuple(fields), tuple(keep), all_statuses), schema)


def _candidate_batches(keep: tuple[str, ...], candidates: tuple[str, ...]):
    """An Arrow function: keep columns + (label, day_first) to keep columns + the instant under each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict = {}
        zones: dict = {}
        for batch in batches:
            memo: dict = {}
            at, instants = [], []
            for i, (label, first) in enumerate(zip(batch.column("_label").to_pylist(), batch.column("_day_first").to_pylist())):
                key = (label, first)
                if key not in memo:
                    text = label.strip()
                    status, value, zone = classify(text, first, shapes) if text else ("empty", None, None)
                    if status != "instant":
                        memo[key] = None
                    elif isinstance(zone, int):
                        memo[key] = [value - zone] * len(candidates)
                    else:
                        memo[key] = [to_utc(value, zone or c, zones, _is_date_only(text))[1] for c in candidates]
                if memo[key] is not None:
                    at.append(i)
                    instants.append(memo[key])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in keep], pa.array(instants, pa.list_(pa.field("element", pa.int64())))], [*keep, "instants"])

    return run


#: A file's chats are cut into this many stretches, between which its clock may have moved; a move costs this many violations.
STRETCHES, MOVE = 16, 3


def _fit_of_candidates(rows: DataFrame, candidates: tuple[str, ...], block: int, stretches: int) -> DataFrame:
    """(source_path, stretch, first_chat, last_chat, rank, violations, gap_s) of every candidate in every stretch of a file.

    Each label is read once and placed in time under all candidates at once.
    """
    files = rows.where("chat_index is not null").groupBy("source_path").agg(F.max("chat_index").alias("_top"))
    known = rows.where("chat_index is not null and message_index is not null and timestamp is not null and ingested_at is not null").join(files, "source_path")
    keep = ("source_path", "chat_index", "message_index", "ingested_at", "stretch")
    source = known.select(
        "source_path", "chat_index", "message_index", "ingested_at", F.least(F.lit(stretches - 1), F.floor(F.col("chat_index") * stretches / (F.col("_top") + 1))).cast("int").alias("stretch"),
        F.col("timestamp").alias("_label"), F.expr("coalesce(date_order, 'dmy') <> 'mdy'").alias("_day_first"),
    )
    types = dict(source.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + ", instants array<bigint>"
    placed = source.mapInArrow(_candidate_batches(keep, candidates), schema).select(*keep, F.posexplode("instants").alias("rank", "utc_second")).where("utc_second is not null")
    near = Window.partitionBy("source_path", "rank", "chat_index", F.expr(f"message_index div {block}")).orderBy("message_index", "utc_second")
    gap = F.col("utc_second") - F.lag("utc_second").over(near)
    late = F.col("utc_second") > F.unix_timestamp(F.col("ingested_at").cast("timestamp"))
    return placed.withColumn("gap", gap).groupBy("source_path", "stretch", "rank").agg(
        F.min("chat_index").alias("first_chat"), F.max("chat_index").alias("last_chat"), (F.count_if(F.col("gap") < 0) + F.count_if(late)).alias("violations"), F.sum(F.abs("gap")).alias("gap_s")
    )


def estimate_zones(rows: DataFrame, candidates: tuple[str, ...] = CANDIDATE_ZONES, block: int = 1024) -> DataFrame:
    """(source_path, zone, violations, gap_s): the one zone whose offset history fits a file best.

    Every label is placed in time under each candidate (labels that carry a zone of their own stay
    fixed). Neighbouring messages of a conversation must not go back in time and must not lie after
    their ingestion when others of the file do not; the candidate with the fewest violations wins,
    then the one with the smaller total gap between neighbours, then the first of the list. Neighbours
    are looked for inside blocks of ``block`` places, so that a huge conversation spreads over tasks.
    """
    fits = _fit_of_candidates(rows, candidates, block, 1)
    best = fits.groupBy("source_path").agg(F.min(F.struct("violations", "gap_s", "rank")).alias("best"))
    zone = F.element_at(F.array(*[F.lit(z) for z in candidates]), F.col("best.rank") + 1)
    return best.select("source_path", zone.alias("zone"), F.col("best.violations").alias("violations"), F.col("best.gap_s").alias("gap_s"))


def estimate_histories(rows: DataFrame, candidates: tuple[str, ...] = CANDIDATE_ZONES, block: int = 1024, stretches: int = STRETCHES) -> DataFrame:
    """(source_path, first_chat, zone, violations): from which chat on a file's clock ran in which zone.

    As ``estimate_zones`` for every stretch of chats, joined to the history that has the fewest violations, a move
    of the clock counting as ``MOVE`` of them (Viterbi over the stretches; ties as there). What is gathered per file
    is one row per stretch and candidate.
    """
    n = len(candidates)

    def history(group):
        import pandas as pd

        parts = sorted(group["stretch"].unique())
        cost = {(r.stretch, r.rank): (int(r.violations), int(r.gap_s) if r.gap_s == r.gap_s else 0) for r in group.itertuples()}
        # A candidate that places none of a stretch's labels says nothing there, and counts as its worst.
        worst = {p: max((cost[p, k] for k in range(n) if (p, k) in cost), default=(0, 0)) for p in parts}
        best = [(0, 0, k) for k in range(n)]
        back = []
        for t, p in enumerate(parts):
            step, now = [], []
            lead = min(range(n), key=lambda k: best[k])
            for k in range(n):
                moved = (best[lead][0] + MOVE, *best[lead][1:])
                stay = t == 0 or best[k] <= moved
                base = best[k] if stay else moved
                v, g = cost.get((p, k), worst[p])
                step.append(k if stay else lead)
                now.append((base[0] + v, base[1] + g, base[2]))
            back.append(step)
            best = now
        at = min(range(n), key=lambda k: best[k])
        path = []
        for step in reversed(back):
            path.append(at)
            at = step[at]
        path.reverse()
        firsts = group.groupby("stretch")["first_chat"].min()
        rows_ = []
        for p, k in zip(parts, path):
            v = cost.get((p, k), worst[p])[0]
            if rows_ and rows_[-1][2] == candidates[k]:
                rows_[-1][3] += v
            else:
                rows_.append([group["source_path"].iloc[0], int(firsts[p]), candidates[k], v])
        return pd.DataFrame(rows_, columns=["source_path", "first_chat", "zone", "violations"])

    fits = _fit_of_candidates(rows, candidates, block, stretches)
    return fits.groupBy("source_path").applyInPandas(history, "source_path string, first_chat int, zone string, violations bigint")


def with_clocks(messages: DataFrame, files: DataFrame) -> DataFrame:
    """``messages`` with ``clock`` (zone name) and ``day_first`` from ``files``.

    A file that is described has its stated zone (null: UTC); files missing from ``files`` get the
    estimated history, a row without chat_index the history's first zone. The description side is joined
    by plain equi-join, so the planner broadcasts it only while its measured size allows; whether a file is
    missing is asked of the distinct paths alone.
    """
    described = files.groupBy("source_path").agg(
        F.max(F.coalesce("clock_zone", F.lit("UTC"))).alias("_stated"),
        F.max("date_order").alias("date_order"),
    )
    messages = messages.drop("date_order", "clock", "day_first", "_stated", "_guess")
    joined = messages.join(described, "source_path", "left").withColumn("day_first", F.expr("coalesce(date_order, 'dmy') <> 'mdy'"))
    missing = messages.select("source_path").distinct().join(described, "source_path", "left_anti")
    if missing.isEmpty():
        return joined.withColumn("clock", F.col("_stated")).drop("_stated")
    return _guessed(joined.where("_stated is not null").withColumn("clock", F.col("_stated")), joined.where("_stated is null")).drop("_stated")


def with_estimated_clocks(messages: DataFrame, files: DataFrame) -> DataFrame:
    """As ``with_clocks`` with every zone estimated; of ``files`` only the order of dates is read."""
    order = files.groupBy("source_path").agg(F.max("date_order").alias("date_order"))
    joined = messages.drop("date_order", "clock", "day_first", "_guess").join(order, "source_path", "left").withColumn("day_first", F.expr("coalesce(date_order, 'dmy') <> 'mdy'"))
    return _guessed(None, joined)


def _guessed(stated: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` with the zone of their file's estimated history, UTC without any, after the ``stated`` ones."""
    ordered = Window.partitionBy("source_path").orderBy("first_chat")
    spans = estimate_histories(rows).select(
        F.col("source_path").alias("_path"), F.col("zone").alias("_guess"), F.when(F.row_number().over(ordered) == 1, -(2**31)).otherwise(F.col("first_chat")).alias("_from"),
        F.coalesce(F.lead("first_chat").over(ordered), F.lit(2**31)).alias("_to"),
    )
    at = F.coalesce(F.col("chat_index"), F.lit(-1))
    guessed = rows.join(spans, (F.col("source_path") == F.col("_path")) & (at >= F.col("_from")) & (at < F.col("_to")), "left")
    guessed = guessed.withColumn("clock", F.coalesce("_guess", F.lit("UTC"))).drop("_path", "_guess", "_from", "_to")
    return guessed if stated is None else stated.unionByName(guessed)
