import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as fx
from threadloom.operators import agreement, dynamics, model, rates, records, regression, relations, transcripts, windows
from threadloom.plans import catalogue

from . import oracle

SC = "participant string, source_path string, chat_index int, message_index int"


def one(df):
    return df.collect()[0]


def test_positive_rules_differ_on_halves(spark):
    df = spark.createDataFrame([(4.5,), (5.5,), (None,)], "s double")
    c = F.lit(5)
    got = [
        tuple(r)
        for r in df.select(
            model.positive_trunc(F.col("s"), c), model.positive_float(F.col("s"), c), model.positive_half_even(F.col("s"), c), model.positive_half_up(F.col("s"), c)
        ).collect()
    ]
    assert got == [(False, False, False, True), (True, True, True, True), (False,) * 4]


def test_scope_and_roles(spark):
    df = spark.createDataFrame([("USER ", ["user"]), ("system", ["user", "assistant"]), ("system", []), (None, ["user"])], "role string, scope array<string>")
    got = [r[0] for r in df.select(model.in_scope(model.role_word(F.col("role")), F.col("scope"))).collect()]
    assert got == [True, False, True, False]
    assert one(spark.range(1).select(model.scope_list(F.lit(" User; assistant,, ")))) [0] == ["user", "assistant"]


def test_keys_and_indices(spark):
    df = spark.createDataFrame([(" a ", None, "f", "1", "2"), (None, "b", "f", "x", "2"), (None, "b", "f", "1", "2"), (None, None, "f", "1", "2")],
                               "participant string, ppt_id string, source_path string, chat_index string, message_index string")
    assert [tuple(r)[:1] for r in model.message_key(df, fallback="ppt_id").select("participant").collect()] == [("a",), ("b",)]
    assert [r[0] for r in df.select(model.coerced_index("chat_index")).collect()] == [1, -1, 1, 1]


def test_repeated_wide_rows_count_once_and_missing_cutoff_raises(spark):
    wide = spark.createDataFrame([("p", "f", 0, 0, "user", 5.0, None)] * 2 + [("p", "f", 0, 1, "bot", None, 3.0)], SC + ", role string, `score__a` double, `score__b` double")
    assert model.long_scores(wide).count() == 2
    ann = spark.createDataFrame([("a", "c", ["user"], True), ("b", "c", ["assistant"], True)], "annotation_id string, category string, scope array<string>, is_harmful boolean")
    cut = spark.createDataFrame([("a", 5)], "annotation_id string, cutoff int")
    assert model.scored(wide, ann, cut).count() == 1
    with pytest.raises(Exception, match="without cutoff"):
        model.scored(wide, ann, cut, check=True).select("cutoff").collect()


def test_interval_degenerates_for_one_participant(spark):
    df = spark.createDataFrame([("p", True), ("p", False)], "participant string, hit boolean")
    r = one(rates.set_summary(df))
    assert (r.mean_rate, r.mean_low, r.mean_high, r.beta_mean) == (0.5, 0.5, 0.5, 0.5)


@pytest.fixture(scope="module")
def millions(spark, tmp_path_factory):
    """Tables of 2.2 million messages, whose number's cube is above 2^63; all in the scope of a sycophantic and of a harmful annotation."""
    folder = tmp_path_factory.mktemp("millions")
    rows = spark.range(0, 2_200_000, 1, 4).selectExpr(
        "concat('p', id % 7) AS participant", "'f' AS source_path", "cast(id div 1000 AS int) AS chat_index", "cast(id % 1000 AS int) AS message_index",
        "if(id % 2 = 0, 'user', 'assistant') AS role", "cast(pmod(hash(id), 3 + id % 7) AS double) AS `score__s`", "cast(pmod(hash(id, 1), 3 + id % 7) AS double) AS `score__h`",
    )
    rows.write.parquet(f"{folder}/preprocessed.parquet")
    ann = [("s", "sycophancy", [], False), ("h", "other", [], True)]
    spark.createDataFrame(ann, "annotation_id string, category string, scope array<string>, is_harmful boolean").write.parquet(f"{folder}/annotations.parquet")
    spark.createDataFrame([("s", 2), ("h", 4)], "annotation_id string, cutoff int").write.parquet(f"{folder}/cutoffs.parquet")
    return str(folder)


def test_annotation_set_frequency_over_millions_of_messages(spark, millions):
    df = catalogue.queries()["annotation_set_frequency"](spark, millions)
    oracle.same(df, oracle.connection(millions), catalogue.oracle_sql()["annotation_set_frequency"])
    assert one(df).messages == 2_200_000


def test_any_harmful_frequency_over_millions_of_messages(spark, millions):
    df = catalogue.queries()["any_harmful_frequency"](spark, millions)
    oracle.same(df, oracle.connection(millions), catalogue.oracle_sql()["any_harmful_frequency"])
    assert one(df).messages == 2_200_000


def test_any_harmful_frequency_of_a_key_with_two_roles(spark, tmp_path):
    rows = [("p", "f", 0, 0, "user", 5.0, None), ("p", "f", 0, 0, "assistant", None, 4.0), ("q", "f", 0, 0, "user", 0.0, None), ("q", "f", 0, 0, "bot", None, 9.0)]
    spark.createDataFrame(rows, SC + ", role string, `score__u` double, `score__a` double").write.parquet(f"{tmp_path}/preprocessed.parquet")
    ann = [("u", "c", ["user"], True), ("a", "c", ["assistant"], True)]
    spark.createDataFrame(ann, "annotation_id string, category string, scope array<string>, is_harmful boolean").write.parquet(f"{tmp_path}/annotations.parquet")
    spark.createDataFrame([("u", 4), ("a", 4)], "annotation_id string, cutoff int").write.parquet(f"{tmp_path}/cutoffs.parquet")
    df = catalogue.queries()["any_harmful_frequency"](spark, str(tmp_path))
    oracle.same(df, oracle.connection(tmp_path), catalogue.oracle_sql()["any_harmful_frequency"])
    assert (one(df).messages, one(df).positives) == (2, 2)


def test_beta_interval_of_billions(spark):
    low, high = rates.beta_ci(F.lit(4_000_000_000), F.lit(5_000_000_000))
    half = 1.96 * math.sqrt(4 / 9 * 5 / 9 / 9_000_000_001)
    assert tuple(one(spark.range(1).select(low, high))) == pytest.approx((4 / 9 - half, 4 / 9 + half), rel=1e-12)


def test_equal_timestamps(spark):
    df = spark.createDataFrame([(1, "u", 0, 1.0), (2, "u", 0, 3.0), (3, "u", 10, 5.0)], "event_id int, user_id string, s int, value double").withColumn("ts", F.timestamp_seconds("s"))
    peers = {r.event_id: r.rolling for r in windows.rolling_time(df, ["user_id"], "ts", "value", 10).collect()}
    alone = {r.event_id: r.rolling for r in windows.rolling_time_no_peers(df, ["user_id"], "ts", "event_id", "value", 10).collect()}
    assert peers == {1: 2.0, 2: 2.0, 3: 3.0} and alone == {1: 1.0, 2: 2.0, 3: 3.0}


def test_grid_equals_numpy(spark):
    x, y = [0, 1, 4, 9, 10], [0.0, 2.0, 1.0, 5.0, 4.0]
    df = spark.createDataFrame([("a", i, v) for i, v in zip(x, y)] + [("b", 3, 7.0)], "g string, x int, y double")
    got = windows.grid(df, ["g"], "x", "y", 7).orderBy("g", "bin").collect()
    want = np.interp(np.linspace(0, 1, 7), np.array(x) / 10, y)
    assert np.allclose([r.value for r in got if r.g == "a"], want) and [r.value for r in got if r.g == "b"] == [7.0] * 7


def test_sessions_spans_and_errors(spark):
    df = spark.createDataFrame([("l", "p", "f", 0, i) for i in (0, 2, 9, 10, 11)] + [("l", "q", "f", 0, 5)], "annotation_id string, " + SC)
    assert sorted(r.hits for r in windows.gap_sessions(df, 2).collect()) == [1, 2, 3]
    assert {r.participant: r.reached for r in windows.span_reached(df, 3, 2).collect()} == {"p": True, "q": False}
    r = one(windows.mean_with_errors(windows.gap_sessions(df, 2), ["annotation_id"]))
    assert r["mean"] == 2.0 and r.clusters == 2 and math.isclose(r.cluster_se, math.sqrt(2) / 3 * math.sqrt(2))


def test_forward_windows(spark):
    m = spark.createDataFrame([("p", "f", 0, i, "user") for i in range(3)] + [("p", "f", 1, 0, "user")], SC + ", role string")
    s = spark.createDataFrame([("p", "f", 0, 0, "a", True, True), ("p", "f", 0, 2, "b", True, True), ("p", "f", 1, 0, "a", True, True)],
                              SC + ", annotation_id string, is_pos boolean, in_scope boolean")
    lab = dynamics.label_sets(m, s)
    k2 = dynamics.windows(lab, 2)
    assert [tuple(r) for r in dynamics.pair_counts(k2).select("x", "y", "successes", "trials").collect()] == [("a", "b", 1, 1)]
    assert dynamics.pair_counts(dynamics.windows(lab, 1)).count() == 0
    t = {(r.x, r.y, r.z): r.successes for r in dynamics.triples(k2).collect()}
    assert t == {("a", "b", "b"): 1}  # a triple with y = z is the pair
    assert dynamics.windows(lab, 99).where("ahead > 0").count() == 2


def test_agreement_edges(spark):
    v = spark.createDataFrame([("d", 1, "a", x, y) for x, y in (("r1", True), ("r2", False))] + [("d", 2, "a", "r1", True)],
                              "dataset_path string, sequence_index int, annotation_id string, annotator string, label boolean")
    assert agreement.majority(v).count() == 1  # the tie is dropped
    assert {r["case"] for r in agreement.case_class(v).collect()} == {"single", "disagree"}
    same = v.where("annotator = 'r1'").unionByName(v.where("annotator = 'r1'").withColumn("annotator", F.lit("r9")))
    assert one(agreement.pairwise(same)).kappa is None and one(agreement.fleiss(same)).kappa is None


def test_best_cutoff_ties(spark):
    rows = [("a", c, 1.0 if c in (1, 3, 5, 7) else 0.5) for c in range(1, 11)] + [("b", c, None) for c in range(1, 11)]
    got = {r.annotation_id: r.cutoff for r in agreement.best_cutoff(spark.createDataFrame(rows, "annotation_id string, cutoff int, f1 double")).collect()}
    assert got == {"a": 3, "b": 5}


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = 200
    c, x, t = rng.integers(0, 8, n), rng.integers(0, 2, n), rng.random(n)
    y = 1 + 0.5 * x - t + rng.normal(size=n) + 0.3 * c
    df = spark.createDataFrame([("l", int(a), float(b), float(d), float(e)) for a, b, d, e in zip(c, x, t, y)], "l string, c int, x double, t double, y double")

    def sandwich(X):
        b = np.linalg.solve(X.T @ X, X.T @ y)
        e, inv = y - X @ b, np.linalg.inv(X.T @ X)
        u = np.array([X[c == g].T @ e[c == g] for g in range(8)])
        k = X.shape[1]
        return b, np.sqrt(np.diag(inv @ (u.T @ u) @ inv) * 8 / 7 * (n - 1) / (n - k))

    b, se = sandwich(np.column_stack([np.ones(n), x]))
    r = one(regression.ols_binary(df, "l", "y", "x", "c"))
    assert np.allclose([r.intercept, r.slope, r.se], [b[0], b[1], se[1]])
    b, se = sandwich(np.column_stack([np.ones(n), x, t]))
    r = one(regression.ols_with_control(df, "l", "y", "x", "t", "c"))
    assert np.allclose([r.slope_x, r.slope_t, r.se_x], [b[1], b[2], se[1]])
    flat = one(regression.ols_binary(df.withColumn("x", F.lit(1.0)), "l", "y", "x", "c"))
    assert flat.slope is None and flat.se is None


def test_quotas(spark):
    s = spark.createDataFrame([("a", 1), ("b", 10), ("c", 30)], "g string, n bigint")
    assert {r.g: r.quota for r in relations.quotas(s, 12, "g", equal=True).collect()} == {"a": 1, "b": 6, "c": 5}
    p = {r.g: r.quota for r in relations.quotas(s, 10, "g").collect()}
    assert sum(p.values()) == 10 and all(p[k] <= n for k, n in (("a", 1), ("b", 10), ("c", 30)))
    assert {r.g: r.quota for r in relations.quotas(s, 1000, "g").collect()} == {"a": 1, "b": 10, "c": 30}


def test_overlaps_and_conflicts(spark):
    d = spark.createDataFrame([("x", "t"), ("x", "t"), ("y", "t"), ("y", "u"), (None, "t"), ("x", None), ("x", " ")], "g string, t string")
    assert [tuple(r) for r in relations.overlaps(d, "t", "g").collect()] == [("x", "y", 1)]
    m = spark.createDataFrame([("k", "a"), ("k", "b"), (None, "c")], "k string, v string")
    with pytest.raises(Exception, match="conflicting"):
        relations.checked_map(m, "k", "v").collect()


def test_longest_path(spark):
    # 1 -> 2 -> 3 and 1 -> 4 -> 5 -> 6; 7 <-> 8 is a cycle.
    edges = {1: None, 2: 1, 3: 2, 4: 1, 5: 4, 6: 5, 7: 8, 8: 7}
    df = spark.createDataFrame([("t", k, v, k, int(k != 5)) for k, v in edges.items()], "tree string, node int, parent int, rank int, turn int")
    got = one(transcripts.longest_path(df))
    assert got.turns == 3 and got.leaf == 3  # the first of two with three turns


def test_text_functions(spark):
    df = spark.createDataFrame([("Él dijo  HOLA mundo, ok", ["hola MUNDO", "  ", "nope", "dijo hola"])], "c string, m array<string>")
    r = one(df.select(fx.unmatched_quotes(F.col("m"), F.col("c")).alias("u"), fx.matched_quotes(F.col("m"), F.col("c")).alias("k")))
    assert r.u == ["nope"] and r.k == ["hola MUNDO", "dijo hola"]
    r = one(spark.createDataFrame([('<think>hm</think> {"score": 11.6, "quotes": ["a", " "]}',), ("no",), ('{"score": }',), (None,)], "t string").select(fx.response(F.col("t")).alias("r")))
    assert r.r.score == 10 and r.r.matches == ["a"]
    parts = [F.lit(p) for p in ("a b", "f/x", "1", "2", "id|z")]
    enc = fx.encode_id(*parts)
    r = one(spark.range(1).select(enc.alias("e"), fx.decode_id(enc).alias("d"), fx.decode_id(F.lit("a|b")).alias("bad")))
    assert r.e == "a%20b|f%2Fx|1|2|id%7Cz" and r.d == ["a b", "f/x", "1", "2", "id|z"] and r.bad is None
    r = one(spark.createDataFrame([("a\r\n\r\n\n\nb\f",)], "t string").select(fx.normalize_text(F.col("t"))))
    assert r[0] == "a\n\nb"
    assert one(spark.range(1).select(fx.fix_cids(F.lit("o(cid:431)er(cid:9)")), fx.age_bin(F.lit(44)), fx.short_slug(F.lit("One, two three four five")), fx.title_of(F.lit(" "), F.lit("a/b.json"))))[:] == (
        "offer(cid:9)", "40-49", "one-two-three-four", "b",
    )


def test_poisson_of_every_group_equals_single_fits(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, (a, b) in {"p": (1.0, 0.3), "q": (2.5, -0.4)}.items():
        for u, v in rng.normal(size=(300, 2)):
            rows.append((g, float(rng.poisson(np.exp(a + b * u + 0.1 * v))), float(u), float(v)))
    rows += [("same", 3.0, 1.0, 1.0)] * 9 + [("p", 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, y double, u double, v double")
    got = {(r.g, r.term): (r.n, r.coefficient) for r in regression.poisson_by(df, "g", "y", ["u", "v"]).collect()}
    assert {g for g, _ in got} == {"p", "q", "same"}
    for g in "pq":
        for term, value in regression.poisson(df.where(F.col("g") == g), "y", ["u", "v"]):
            assert got[g, term][0] == 300 and math.isclose(got[g, term][1], value, abs_tol=1e-5)
    assert {got["same", t] for t in ("intercept", "u", "v")} == {(9, None)}
    assert regression.poisson_by(df.limit(0), "g", "y", ["u", "v"]).count() == 0


@pytest.mark.parametrize("name", ["poisson_glm_fixed", "trajectory_mean_ci"])
def test_every_annotation_has_a_result(spark, data, name):
    from threadloom.plans import catalogue

    ids = {r.annotation_id for r in catalogue.queries()[name](spark, data).select("annotation_id").distinct().collect()}
    assert len(ids) == 24


def test_pivot_of_every_annotation(spark, data):
    from threadloom.plans import catalogue

    df = catalogue.queries()["wide_pivot_all"](spark, data)
    scores = [c for c in spark.read.parquet(f"{data}/preprocessed.parquet").columns if c.startswith("score__")]
    assert set(df.columns) == {*model.KEY, *(c.removeprefix("score__") for c in scores)} and len(scores) == 24
    assert df.count() == df.select(*model.KEY).distinct().count() > 0


def test_terms_are_grams_without_stop_words(spark, data, tmp_path):
    from threadloom.plans import catalogue

    texts = ["The river house and the old bridge"] * 6 + ["An old river was there"] * 6 + ["the rare word"] * 4
    spark.createDataFrame([(k, t, "memo") for k, t in enumerate(texts)], "doc_id bigint, text string, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.term: r.weight for r in catalogue.queries()["tfidf_terms"](spark, str(tmp_path)).collect()}
    assert set(got) == {"river", "house", "old", "bridge", "river house", "house old", "old bridge", "old river"}
    assert catalogue.queries()["kmeans_topics"](spark, data).count() > 10


def test_texts_with_quotes(spark):
    texts = spark.createDataFrame([(1, "He said THE old bridge over the river was shut."), (2, "the old bridges over the river was shut"), (3, None), (4, ""), (5, "old")], "t int, text string")
    quotes = spark.createDataFrame([(1, "e old bridge over the river was sh"), (2, "Old"), (3, ""), (4, None), (5, "bridges over the river was shut!")], "q int, quote string")
    assert {(r.t, r.q) for r in relations.texts_with_quotes(texts, quotes, "text", "quote").collect()} == {(1, 1), (1, 2), (2, 2), (5, 2)}
    assert relations.texts_with_quotes(texts.limit(0), quotes, "text", "quote").count() == 0


def test_family_state_errors(spark):
    notes = spark.createDataFrame([("a",), ("b",)], "annotation_id string")
    cuts = spark.createDataFrame([("a", 5)], "annotation_id string, cutoff int")
    rows = lambda *x: spark.createDataFrame(list(x), "participant string, source_path string, chat_index int, message_index int, role string, annotation_id string, score double, error string")
    base = ("p", "f", 0, 1, "user", "a", 6.9, None)
    assert [r.is_pos for r in records.family_state(rows(base, (None, "f", 0, 1, "user", "a", 1.0, None), ("p", "f", 0, 2, "user", "a", 9.0, "fatal"), ("p", "f", 0, 3, "user", "zz", 9.0, None)), notes, cuts).collect()] == [True]
    for bad in ((base, base), (base, ("p", "f", 0, 1, "user", "b", 1.0, None))):
        with pytest.raises(Exception, match="twice|no cutoff"):
            records.family_state(rows(*bad), notes, cuts).collect()
    two = spark.createDataFrame([("a", 5), ("b", 5)], "annotation_id string, cutoff int")
    with pytest.raises(Exception, match="two roles"):
        records.family_state(rows(base, ("p", "f", 0, 1, "assistant", "b", 1.0, None)), notes, two).collect()
    assert records.role_filter("Both") is None and records.role_filter(" User") == "user"
    with pytest.raises(ValueError):
        records.role_filter("system")
    for bad in ("x", ":user", "a:", "a:system"):
        with pytest.raises(ValueError):
            records.scope_overrides([bad])


def test_empty_records(spark):
    empty = spark.createDataFrame([], "participant string, source_path string, chat_index int, message_index int, role string, annotation_id string, score double, matches array<string>, error string, content string")
    assert records.family_stats(empty).first()["rows"] == 0 and records.fatal_errors(empty).count() == 0
    assert records.rechecked(empty, empty.select(*model.KEY, "content")).count() == 0 and records.numbered(empty.select("score"), ["score"]).count() == 0
    people = spark.createDataFrame([(None, None), (None, " ")], "age int, gender string")
    assert [(r.measure, r.value) for r in records.demographics(people).collect()] == [("count", 0.0)]


def test_numbered_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = [(r.row, r.v) for r in records.numbered(df.repartition(7), ["v"]).orderBy("row").collect()]
    assert [n for n, _ in got] == list(range(1, 1001)) and [v for _, v in got] == sorted(v for _, v in got)


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if k % 3 else f"g{k % 5}" if k % 7 else None, k, int(rng.integers(0, 9))) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {r.k: r.v_before for r in records.running_before(df.repartition(9), "g", ["k"], ["v"]).collect()}
    seen, want = {}, {}
    for g, k, v in rows:
        want[k] = seen.get(g, 0)
        seen[g] = want[k] + v
    assert got == want


def test_stratified_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    quota = spark.createDataFrame([("hot", 70), ("18", 1), ("19", 0), ("none", 4)], "g string, quota bigint")
    got = relations.stratified(df, quota, "g", relations.hashed(7, "id")).collect()
    best = [r.id for r in df.where("g = 'hot'").orderBy(relations.hashed(7, "id")).limit(70).collect()]
    assert sorted(r.id for r in got if r.g == "hot") == sorted(best) and [r.id for r in got if r.g != "hot"] == [18]
