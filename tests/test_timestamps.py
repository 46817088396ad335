import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from threadloom.operators import timestamps as ts


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


CASES = [
    ("2024-03-10T00:16:40.618", "UTC", True, utc(2024, 3, 10, 0, 16, 40)),
    ("2025-04-28T15:54:40,275Z", "Europe/Berlin", True, utc(2025, 4, 28, 15, 54, 40)),
    ("12/18/2023, 13:22:34", "America/New_York", False, utc(2023, 12, 18, 18, 22, 34)),
    ("18/09/2023, 12:19:09", "Europe/London", True, utc(2023, 9, 18, 11, 19, 9)),
    ("1726262525.184", None, True, 1726262525), ("1754950810022", None, True, 1754950810), ("1708049938495314", None, True, 1708049938),
    ("20251213T190527Z", None, True, utc(2025, 12, 13, 19, 5, 27)),
    ("15-NOV-2023 23:41:59", "UTC", True, utc(2023, 11, 15, 23, 41, 59)),
    ("Feb 25, 2025, 5:03:01 AM", "UTC", True, utc(2025, 2, 25, 5, 3, 1)),
    ("Dec 16, 2024, 12:09:25 AM", "UTC", True, utc(2024, 12, 16, 0, 9, 25)),
    ("Sat, 11 Oct 2025 14:30:04 -0400", None, True, utc(2025, 10, 11, 18, 30, 4)),
    ("2023-06-08 20:42:08 GMT-4", None, True, utc(2023, 6, 9, 0, 42, 8)),
    ("2023-08-06 02:09:21 GMT+5:30", None, True, utc(2023, 8, 5, 20, 39, 21)),
    ("2024-04-23T18:33:01[America/Los_Angeles]", None, True, utc(2024, 4, 24, 1, 33, 1)),
    ("2024-04-30 10:19:58 America/Sao_Paulo", None, True, utc(2024, 4, 30, 13, 19, 58)),
    ("July 10, 2024 at 8:56:48 PM AEST", None, True, utc(2024, 7, 10, 10, 56, 48)),
    ("29/6/24, 6:55 AM", "Europe/Berlin", True, utc(2024, 6, 29, 4, 55)),
    ("15. Oktober 2023, 10:36 Uhr", "Europe/Berlin", True, utc(2023, 10, 15, 8, 36)),
    ("27. März 2022, 01:54 Uhr", "Europe/Berlin", True, utc(2022, 3, 27, 0, 54)),
    ("08.16.2025", "UTC", False, utc(2025, 8, 16)), ("19 September 2025", "Asia/Kolkata", True, utc(2025, 9, 18, 18, 30)),
    ("November 6, 2022 at 1:42:05 AM EDT", None, True, utc(2022, 11, 6, 5, 42, 5)),
]
OTHERS = [
    ("2024-11-03 01:27", "America/New_York", "ambiguous"), ("2024-03-31 02:30", "Europe/Berlin", "skipped"),
    ("2024-13-12 10:28:00 UTC", None, "impossible"), ("2024-02-30T02:40:00Z", None, "impossible"), ("2024-08-22T25:10:11Z", None, "impossible"),
    ("2024-10-??", None, "incomplete"), ("07:17", None, "incomplete"), ("2024-10", None, "incomplete"), ("0", None, "no_time"), ("-1", None, "no_time"),
    ("0.0", None, "no_time"), ("n/a", None, "no_time"), ("last Tuesday", None, "no_time"), ("", None, "empty"), ("   ", None, "empty"), (None, None, "empty"),
    ("31/12/2024", "UTC", "impossible"),
]


def rows(spark, cases, day_first=None):
    data = [(n, c[0], c[1], day_first if day_first is not None else c[2]) for n, c in enumerate(cases)]
    df = spark.createDataFrame(data, "row_id bigint, label string, z string, d boolean")
    return ts.label_instants(df, ("label",), ("row_id",), "z", "d").orderBy("row_id").collect()


def test_instants(spark):
    for r, c in zip(rows(spark, CASES), CASES):
        assert (r.status, r.utc_second) == ("instant", c[3]), c


def test_other_statuses(spark):
    for r, c in zip(rows(spark, OTHERS, False), OTHERS):
        assert (r.status, r.utc_second) == (c[2], None), c


def test_zone_from_order(spark):
    zone = "America/New_York"
    out = []
    base = utc(2024, 7, 1, 12)
    for k in range(60):
        t = base + 300 * k
        local = dt.datetime.fromtimestamp(t - 4 * 3600, dt.timezone.utc)
        label = f"{local:%Y-%m-%d %H:%M:%S}" if k % 3 else f"{t}"
        out.append((k, "p", "f", 0, k, label, None, dt.datetime(2030, 1, 1)))
    messages = spark.createDataFrame(out, "row_id bigint, participant string, source_path string, chat_index int, message_index int, timestamp string, chat_date string, ingested_at timestamp")
    files = spark.createDataFrame([], "source_path string, clock_zone string, date_order string")
    clocked = ts.with_clocks(messages, files)
    assert {r.clock for r in clocked.select("clock").distinct().collect()} == {zone}
    got = {r.row_id: r.utc_second for r in ts.label_instants(clocked, ("timestamp",), ("row_id",), "clock", "day_first").collect()}
    assert got == {k: base + 300 * k for k in range(60)}


def test_empty_and_clashing_columns(spark):
    messages = spark.createDataFrame([], "row_id bigint, source_path string, chat_index int, message_index int, timestamp string, chat_date string, ingested_at timestamp, date_order int, clock string")
    files = spark.createDataFrame([("f", None, "dmy", 1)], "source_path string, clock_zone string, date_order string, row_id int")
    clocked = ts.with_clocks(messages, files)
    assert ts.label_instants(clocked, zone="clock", day_first="day_first").count() == 0


@pytest.mark.parametrize("label", ["x" * 100_000, "9" * 400, "2024-01-01 " * 1000])
def test_very_long_labels(label):
    assert ts.classify(label, True, {})[0] in ("no_time", "instant", "impossible")


def test_clock_that_moves_inside_a_file(spark):
    """A clock in Berlin up to a chat and in New York from it on, beside labels with a zone of their own."""
    rows, truth = [], {}
    for chat in range(40):
        zone = ZoneInfo("Europe/Berlin" if chat < 24 else "America/New_York")
        for k in range(12):
            at = dt.datetime(2024, 2, 1, 9, tzinfo=dt.timezone.utc) + dt.timedelta(days=chat, minutes=7 * k)
            label = at.strftime("%Y-%m-%dT%H:%M:%SZ") if k % 3 == 0 else at.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S")
            rows.append((len(rows), "f", chat, k, label, None, at + dt.timedelta(days=50)))
            truth[len(rows) - 1] = int(at.timestamp())
    rows += [(-1, "f", None, None, None, None, None), (-2, "g", 0, 0, "no time", None, None)]
    messages = spark.createDataFrame(rows, "row_id bigint, source_path string, chat_index int, message_index int, timestamp string, chat_date string, ingested_at timestamp")
    files = spark.createDataFrame([("f", "Asia/Tokyo", "dmy")], "source_path string, clock_zone string, date_order string")
    got = [(r.first_chat, r.zone) for r in ts.estimate_histories(messages.withColumn("date_order", F.lit("dmy"))).orderBy("first_chat").collect()]
    assert [z for _, z in got] == ["Europe/Berlin", "America/New_York"] and abs(got[1][0] - 24) <= 2
    clocked = ts.with_estimated_clocks(messages, files)
    found = {r.row_id: r.utc_second for r in ts.label_instants(clocked, ("timestamp",), ("row_id",), "clock", "day_first", all_statuses=False).collect()}
    assert sum(found.get(k) == v for k, v in truth.items()) >= 0.95 * len(truth) and clocked.count() == len(rows)
