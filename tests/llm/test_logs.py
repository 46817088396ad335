import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import components, consensus, conversations, pairs, reservoir, sameness


def tallies(spark, rows, window=3, parts=None):
    df = spark.createDataFrame(rows, "s string, place int, pos array<int>, sc array<int>, code string")
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = pairs.counts(df, ["s"], "place", F.coalesce("pos", F.array().cast("array<int>")), F.coalesce("sc", F.array().cast("array<int>")), window)
        return {(r.kind, r.x, r.y): r.n for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute(rows, window=3):
    out = collections.Counter()
    once = {(r[0], r[1], tuple(r[2] or ()), tuple(r[3] or ()), r[4]) for r in rows}
    by = collections.defaultdict(list)
    for r in once:
        by[r[0]].append(r)
        out.update((pairs.WITH_ITEM, x, x) for x in r[2])
        out.update((pairs.SCORED, x, x) for x in r[3])
        out.update((pairs.TOGETHER, x, y) for x, y in itertools.product(r[2], r[2]) if x < y)
    for group in by.values():
        group.sort(key=lambda r: (r[1] is not None, r[1]))
        for i, r in enumerate(group):
            for t in group[i + 1 : i + 1 + window]:
                out.update((pairs.FOLLOWS, x, y) for x in r[2] for y in t[2])
    return dict(out)


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_pairs_equal_brute_force_with_a_hot_session(spark, parts):
    rng = np.random.default_rng(parts)
    rows = []
    for s, n in (("hot", 150), ("a", 2), ("b", 1), (None, 9), ("c", 40)):
        for place in range(n):
            sc = sorted(rng.choice(6, rng.integers(0, 6), replace=False).tolist())
            rows.append((s, place * 2, [x for x in sc if rng.random() < 0.5], sc, "x"))
    rows += rows[:20]
    assert tallies(spark, rows, 3, parts) == brute(rows)


def test_pairs_of_nothing(spark):
    assert tallies(spark, []) == {}
    assert tallies(spark, [("a", 1, None, None, None)] * 3) == {}


def test_enrichment(spark):
    t = spark.createDataFrame([(0, 1, 1, 10), (0, 2, 2, 20), (1, 1, 1, 100), (1, 2, 2, 100), (2, 1, 2, 8)], "kind int, x int, y int, n bigint")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "item int, name string")
    got = {(r.x, r.y): r for r in pairs.enrichment(t, names).collect()}
    assert math.isclose(got["a", "b"].enrichment, (8 / 10) / 0.2) and math.isclose(got["b", "a"].enrichment, (8 / 20) / 0.1)
    assert math.isclose(got["a", "b"].log_odds, math.log(8.5 * 78.5 / (2.5 * 12.5)))


LONG = "The quick brown fox jumps over the lazy dog today"
CONTENTS = [
    LONG, LONG.upper() + "!!", "the\tquick  brown-fox, jumps over the lazy dog today", "today the quick brown fox jumps over the lazy dog",
    '{"mood": "tense", "place": "Nowhere Hills", "minutes": "25"}', "minutes=25; place=nowhere hills; mood=TENSE", "Place: Nowhere Hills\nMinutes: 25\nMood: tense",
    "PLACE NOWHERE HILLS MINUTES 25 MOOD TENSE", '{"mood": "tense", "place": "Nowhere Hills", "minutes": "26"}', "short", "SHORT", "", None, None, "   ",
    "Die Straße am Fluss war heute sehr lang", "DIE STRASSE AM FLUSS WAR HEUTE SEHR LANG", '{"a": 1, "a": 2, "broken": ', "x" * 200_000, "X" * 200_000,
]


def test_sameness_groups(spark):
    df = spark.createDataFrame([(i + 1, c, "e") for i, c in enumerate(CONTENTS)], "row_id bigint, content string, codes string").withColumn("first_row_id", F.lit(0))
    got = {(r.first_row_id, r.row_id) for r in sameness.repeats(df).collect()}
    # A record without its punctuation spells the one notation of its letters' order, and so joins the group.
    assert got == {(1, 2), (1, 3), (5, 6), (5, 7), (5, 8), (16, 17), (19, 20)}
    assert {(r.first_row_id, r.copies) for r in sameness.survivors(df).collect()} == {(1, 3), (5, 4), (16, 2), (19, 2)}
    assert sameness.repeats(df.limit(0)).count() == 0


def test_sameness_of_one_text_read_as_several_records(spark):
    tail = "quiet hills and a long river; d=25 minutes of calm"
    rows = [f"a b=c {tail}", f"a=b c {tail}", f"d=25 minutes of calm; a b=c quiet hills and a long river", f"d=25 minutes of calm; a=b c quiet hills and a long river", f"a=b d {tail}"]
    df = spark.createDataFrame(list(enumerate(rows, 1)), "row_id bigint, content string")
    assert {(r.first_row_id, r.row_id) for r in sameness.repeats(df).collect()} == {(1, 2), (1, 3), (1, 4)}


def test_components_that_keep_changing_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(k, k + 1) for k in range(64)], "a bigint, b bigint"), max_rounds=1)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 80)] * 2
    edges += [(None, 5), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


SCHEMA = "row_id bigint, participant string, source_path string, chat_index int, message_index int, role string, timestamp string, chat_key string, chat_date string, content string, ingested_at timestamp, speaker int"


def chat(index, *turns, start=1_700_000_000):
    """(place, role, content[, seconds[, keep index]]) rows of one conversation."""
    return [(index, *t) for t in turns], start


def dropped(spark, *chats):
    rows, n = [], 0
    for turns, start in chats:
        for index, place, role, content, *more in turns:
            n += 1
            at = more[0] if more else (place or 0) * 60
            lost = len(more) > 1 and more[1]
            rows.append((n, "p", "f", None if lost else index, place, role, str(start + at), f"key {index}", None, content, None, 1))
    messages = spark.createDataFrame(rows, SCHEMA)
    files = spark.createDataFrame([("f", None, "dmy")], "source_path string, clock_zone string, date_order string")
    return {r.chat_index: {k for k, v in r.asDict().items() if v is True} for r in conversations.broken(messages, files).collect()}


def test_conversations(spark):
    fine = chat(0, (0, "user", "hi"), (1, "Assistant", "yes"))
    got = dropped(
        spark, fine,
        chat(1, (0, "user", "hi"), (1, "?", "yes")),
        chat(2, (0, "human", "hi"), (2, "bot", "yes")),
        chat(3, (0, "you", "hi"), (0, "user", "Hi there"), (1, "model", "yes")),
        chat(4, (0, "you", "hi"), (0, "user", " HI! "), (1, "model", "yes")),
        chat(5, (0, "user", "hi"), (1, "AI", "​ \n"), (2, "ai", "yes")),
        chat(6, (0, "assistant", "yes")),
        chat(7, (0, "user", "hi"), (1, "ai", "yes"), (2, "user", "and"), (3, "system", "end")),
        chat(8, (0, "user", "hi"), (1, "ai", "yes", 60, True), (2, "user", "hm"), (3, "ai", "ok")),
        chat(9, (0, "user", "hi"), (None, "ai", "lost", 70), (2, "user", "hm", 120), (3, "ai", "ok", 180)),
        chat(10, (0, "user", "hi"), (1, "user", "hm"), (None, "ai", "lost", 600)),
        chat(11, (0, "user", "hi"), (None, "ai", "late", 600), (2, "ai", "hm", 120)),
        chat(12, (0, "user", None), (1, "ai", "yes")),
        chat(13, (0, None, "hi"), (1, "ai", "yes")),
    )
    assert got == {
        1: {"unknown_speaker", "no_reply"}, 2: {"missing_place"}, 3: {"clash"}, 5: {"empty_reply"}, 6: {"no_person"}, 7: {"no_reply"}, 11: {"missing_place"},
        12: {"no_person"}, 13: {"unknown_speaker", "no_person"},
    }


def placed_in_order(spark, *chats):
    rows, n = [], 0
    for turns, start in chats:
        for index, place, role, content, at in turns:
            n += 1
            stamp = None if at is None else str(start + at)
            rows.append((n, "p", "f", index, place, role, stamp, f"key {index}", None, content, None, 1))
    files = spark.createDataFrame([("f", None, "dmy")], "source_path string, clock_zone string, date_order string")
    got = conversations.ordered(spark.createDataFrame(rows, SCHEMA), files).collect()
    return sorted((r.chat_index, -1 if r.message_index is None else r.message_index, r.speaker, r.row_id) for r in got)


def test_ordered_keeps_rows_without_place(spark):
    got = placed_in_order(
        spark,
        # Two loose rows out of order fill places 1 and 3, one is later than all indexed rows, one is a copy of place 4.
        chat(0, (0, "user", "a", 0), (None, "user", "late", 900), (2, "ai", "c", 120), (None, "ai", "d", 180), (None, "user", "b", 60), (4, "ai", "e", 240), (None, "ai", "E!", 250)),
        chat(1, (0, "user", "hi", 0), (None, "ai", "the last reply", 600)),
        # Nothing shows the place of the note; the other row without instant repeats place 1.
        chat(2, (0, "user", "hi", 0), (1, "ai", "yes", 60), (None, "ai", "a note", None), (None, "ai", "another note", None), (None, "ai", "Yes.", None)),
        chat(3, (0, "user", "hi", 0), (None, "ai", "unusable", 30), (4, "ai", "yes", 60)),
        chat(4, (0, "user", "hi", 0), (1, "ai", "yes", 60), (None, "ai", "twice", 600), (None, "ai", "Twice", 601), (None, "ai", "more", 700)),
    )
    assert [r for r in got if r[0] == 1] == [(1, 0, "person", 8), (1, 1, "machine", 9)]
    assert [r for r in got if r[0] == 2] == [(2, -1, "machine", 12), (2, -1, "machine", 13), (2, 0, "person", 10), (2, 1, "machine", 11)]
    assert not [r for r in got if r[0] == 3]
    assert [r for r in got if r[0] == 4] == [(4, 0, "person", 18), (4, 1, "machine", 19), (4, 2, "machine", 20), (4, 3, "machine", 22)]
    # The conversation ends with the person, so it is unusable until a reply follows.
    assert not [r for r in got if r[0] == 0]
    got = placed_in_order(
        spark,
        chat(0, (0, "user", "a", 0), (None, "ai", "late", 900), (2, "user", "c", 120), (None, "ai", "d", 180), (None, "ai", "b", 60), (4, "user", "e", 240), (None, "user", "E!", 250)),
    )
    assert got == [(0, 0, "person", 1), (0, 1, "machine", 5), (0, 2, "person", 3), (0, 3, "machine", 4), (0, 4, "person", 6), (0, 5, "machine", 2)]



def test_conversations_without_any_index_stay_apart(spark):
    turns = [("a", 0, "user", "hi"), ("a", 1, "ai", "yes"), ("b", 0, "user", "hello"), ("b", 1, "ai", "no"), ("c", 0, "user", "alone")]
    rows = [(n, "p", "f", None, place, role, str(1_700_000_000 + 60 * place), key, None, content, None, 1) for n, (key, place, role, content) in enumerate(turns)]
    messages = spark.createDataFrame(rows, SCHEMA)
    files = spark.createDataFrame([("f", None, "dmy")], "source_path string, clock_zone string, date_order string")
    assert [(r.lost_chat, r.clash, r.no_reply) for r in conversations.broken(messages, files).collect()] == [("c", False, True)]
    got = sorted((r.lost_chat, r.message_index, r.row_id) for r in conversations.ordered(messages, files).collect())
    assert got == [("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("b", 1, 3)]


def test_no_conversations(spark):
    files = spark.createDataFrame([], "source_path string, clock_zone string, date_order string")
    assert conversations.broken(spark.createDataFrame([], SCHEMA), files).count() == 0


def test_geometric_file_is_uniform():
    hits = np.zeros(60)
    for seed in range(3000):
        file = reservoir.GeometricFile(12, np.random.default_rng(seed), buffer=4)
        for at in range(0, 60, 7):
            file.offer(np.arange(at, min(60, at + 7)))
        s = file.sample()
        assert len(s) == len(set(s.tolist())) == 12
        hits[s] += 1
    expected = 3000 * 12 / 60
    assert ((hits - expected) ** 2 / expected).sum() < 110  # chi-square, 59 degrees of freedom, far beyond the 99.9 % point


def test_merge_draws():
    rng = np.random.default_rng(0)
    draws = np.array([reservoir.draw([10, 30, 0, 60], 20, rng) for _ in range(3000)])
    assert (draws.sum(1) == 20).all() and np.allclose(draws.mean(0), [2, 6, 0, 12], atol=0.15)
    assert reservoir.draw([3, 4], 100, rng) == [3, 4]
    assert sum(reservoir.draw([2 * 10**9, 10**9], 50, rng)) == 50


def test_fixed_size_sample(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("k"), F.col("id").alias("row_id"), F.lit(1).alias("rank")).unionByName(spark.createDataFrame([(None, 9999, 1)], "k bigint, row_id bigint, rank int"))
    a = reservoir.fixed_size_sample(df, ["k"], "row_id", 50).collect()
    b = reservoir.fixed_size_sample(df.repartition(7), ["k"], "row_id", 50).collect()
    assert len(a) == len({r.k for r in a}) == 50 and sorted(r.row_id for r in a) == sorted(r.row_id for r in b)
    assert reservoir.fixed_size_sample(df, ["k"], "row_id", 10_000).count() == 501
    assert reservoir.fixed_size_sample(df.limit(0), ["k"], "row_id", 5).count() == 0


ITEMS = "dataset_path string, sequence_index int, participant string, annotation_id string"
LABELS = "label_id bigint, annotator string, " + ITEMS + ", label string, labelled_at timestamp, p double"


def test_consensus_beats_majority(spark):
    import datetime as dt

    rng = np.random.default_rng(5)
    acc = {"good1": 0.95, "good2": 0.93, "fair": 0.8, "coin1": 0.5, "coin2": 0.5, "contrary": 0.12, "yes": None}
    truth = rng.random(300) < 0.4
    rows, majority = [], 0
    for i, z in enumerate(truth):
        up = 0
        for a in rng.choice(list(acc), 5, replace=False):
            y = True if acc[a] is None else bool(z) if rng.random() < acc[a] else not z
            up += y
            rows.append((len(rows), str(a), "d", i, "p", "x", "Yes " if y else "NO", dt.datetime(2025, 1, 1), 0.0))
        majority += (up > 2) == z
    rows += rows[:30]
    rows.append((-1, "good1", "d", 999, "p", "x", "yes", dt.datetime(2025, 1, 1), 0.0))  # no such item
    items = spark.createDataFrame([("d", i, "p", "x") for i in range(301)] * 2, ITEMS)
    per_item, raters = consensus.consensus(spark.createDataFrame(rows, LABELS), items, rounds=15)
    got = {r.sequence_index: r for r in per_item.collect()}
    assert len(got) == 301 and got[300].consensus is None
    right = sum((got[i].consensus == "yes") == z for i, z in enumerate(truth))
    ability = {r.annotator: r.ability for r in raters.collect()}
    assert right > majority + 15 and ability["good1"] > ability["fair"] > ability["coin1"] > ability["contrary"] and ability["contrary"] < 0


def test_latest_answer_holds(spark):
    import datetime as dt

    d = [dt.datetime(2025, 1, k) for k in (1, 2, 3)]
    rows = [(1, "a", "d", 1, "p", "x", "yes", d[0], 0.0), (2, "a", "d", 1, "p", "x", "no", d[1], 0.0), (3, "a", "d", 1, "p", "x", None, d[2], 0.0),
            (4, "b", "d", 1, "p", "x", "yes", d[0], 0.0), (5, "b", "d", 1, "p", "x", "unsure", d[1], 0.0)]
    got = consensus.answers(spark.createDataFrame(rows, LABELS), spark.createDataFrame([("d", 1, "p", "x")], ITEMS)).collect()
    assert [(r.annotator, r.y) for r in got] == [("a", 0)]
    empty = spark.createDataFrame([], LABELS)
    per_item, raters = consensus.consensus(empty, spark.createDataFrame([("d", 1, "p", "x")], ITEMS))
    assert [r.consensus for r in per_item.collect()] == [None] and raters.count() == 0


def test_consensus_with_yes_sayers(spark):
    """Annotators who nearly always say yes must not raise the share of yes."""
    import datetime as dt

    rng = np.random.default_rng(11)
    rates = {"a": (0.95, 0.04), "b": (0.92, 0.06), "c": (0.9, 0.08), "d": (0.97, 0.88), "e": (0.97, 0.3), "f": (0.5, 0.5), "g": (0.22, 0.76)}
    truth = rng.random(800) < np.where(np.arange(800) % 2, 0.2, 0.5)
    rows = []
    for i, z in enumerate(truth):
        for who in rng.choice(list(rates), 5, replace=False):
            y = rng.random() < rates[who][0 if z else 1]
            rows.append((len(rows), str(who), "d", i, "p", f"x{i % 2}", "yes" if y else "no", dt.datetime(2025, 1, 1), 0.0))
    items = spark.createDataFrame([("d", i, "p", f"x{i % 2}") for i in range(800)], ITEMS)
    per_item, raters = consensus.consensus(spark.createDataFrame(rows, LABELS), items)
    got = np.array([r.consensus == "yes" for r in per_item.orderBy("sequence_index").collect()])
    assert got[truth].mean() > 0.93 and truth[got].mean() > 0.93
    leaning = {r.annotator: r.leaning for r in raters.collect()}
    assert leaning["d"] > 1.5 and abs(leaning["a"]) < 0.6


def test_consensus_that_does_not_come_to_rest_is_an_error(spark):
    import datetime as dt

    rows = [(k, a, "d", k, "p", "x", w, dt.datetime(2025, 1, 1), 0.0) for k in range(9) for a, w in (("a", "yes"), ("b", "no" if k % 3 else "yes"))]
    with pytest.raises(RuntimeError):
        consensus.consensus(spark.createDataFrame(rows, LABELS), spark.createDataFrame([("d", k, "p", "x") for k in range(9)], ITEMS), rounds=2, tolerance=1e-9)
