import io
import json
import zipfile

from pyspark.sql import functions as F

from threadloom.sources import readers, sinks
from threadloom.streaming import ingest

TREE = {
    "r": {"parent": None, "children": ["a"], "message": None},
    "a": {"parent": "r", "children": ["b", "c"], "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}},
    "b": {"parent": "a", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["one"]}}},
    "c": {"parent": "a", "children": ["d"], "message": {"author": {"role": "assistant"}, "content": {"parts": ["two", {"text": "x"}]}}},
    "d": {"parent": "c", "children": ["e"], "message": {"author": {"role": "tool"}, "content": {"text": "hidden"}}},
    "e": {"parent": "d", "children": [], "message": {"author": {"role": "user"}, "content": {"text": "bye"}}},
    "y": {"parent": "z", "children": ["z"], "message": None},
    "z": {"parent": "y", "children": ["y"], "message": None},
}


def test_tree_paths():
    assert [m["content"] for m in readers.linearise(TREE)] == ["hi", "two\nx", "bye"]
    assert [m["content"] for m in readers.linearise(TREE, "b", "current")] == ["hi", "one"]


def test_transcripts(spark, tmp_path):
    (tmp_path / "hl_01").mkdir()
    (tmp_path / "hl_01/a.json").write_text(json.dumps([{"title": "T", "mapping": TREE}]))
    (tmp_path / "hl_01/b.json").write_text(json.dumps({"messages": [{"role": "User", "content": "x"}, {"role": "bot", "content": " "}, {"content": {"k": 1}, "create_time": 0, "metadata": {"update_time": 5}}]}))
    (tmp_path / "hl_01/c.json").write_text("{not json")
    got = {(r.source_path, r.message_index): (r.participant, r.role, r.content, r.timestamp) for r in readers.transcripts(spark, str(tmp_path)).collect()}
    assert got[("hl_01/a.json", 1)] == ("hl_01", "assistant", "two\nx", None)
    assert got[("hl_01/b.json", 2)] == ("hl_01", "unknown", '{"k": 1}', "5") and len(got) == 5


def test_record_scan(spark, tmp_path):
    lines = ['{"type":"meta","model":"m","annotation_ids":["a"]}', "", "not json", '{"annotation_id":"a","score":5}', '{"annotation_id":"b","error":"fatal"}', '{"annotation_id":"b","error":"quote x"}']
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    assert readers.records(spark, str(tmp_path)).count() == 3
    assert readers.records(spark, str(tmp_path), ("quote",), True).count() == 2
    cat = readers.runs(spark, str(tmp_path))
    assert readers.select_runs(cat, "m", "a").count() == 1 and readers.select_runs(cat, "m", "zz").count() == 0
    assert readers.for_annotation(readers.records(spark, str(tmp_path)), "a").count() == 1


def test_small_sources(spark, tmp_path):
    (tmp_path / "spec.csv").write_text("id,category,scope,Harmful (by itself)?\na,c,\"User, assistant\",yes\nb,c,,\n")
    assert [(r.annotation_id, r.scope, r.is_harmful) for r in readers.annotation_specs(spark, str(tmp_path / "spec.csv")).collect()] == [("a", ["user", "assistant"], True), ("b", [], False)]
    (tmp_path / "cut.json").write_text('{"llm_score_cutoffs_by_annotation": {"a": 5, "b": "x"}}')
    assert [tuple(r) for r in readers.cutoffs(spark, str(tmp_path / "cut.json")).collect()] == [("a", 5)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/p1.json").write_text('{"age": "31", "gender": "f"}')
    assert [tuple(r) for r in readers.surveys(spark, str(tmp_path / "s")).collect()] == [("p1", 31, "f")]
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x.txt", "in")
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/o.zip", "w") as z:
        z.writestr("i.zip", inner.getvalue())
        z.writestr("t.txt", "out")
    assert sorted(r.member for r in readers.archive_members(spark, str(tmp_path / "z")).collect()) == ["i.zip!x.txt", "t.txt"]
    html = spark.createDataFrame([('<script>var jsonData = [{"a": "]"}];</script>',), ("none",), (None,)], "html string")
    assert [r.json for r in readers.embedded_json(html).collect()] == ['[{"a": "]"}]', None, None]


def test_labelled_turns(spark):
    df = spark.createDataFrame([(1, "preface\nUser: hi\nmore\n**Assistant**: yes"), (2, None), (3, "")], "doc_id int, text string")
    assert [tuple(r)[1:] for r in readers.labelled_turns(df).orderBy("message_index").collect()] == [(0, "user", "hi\nmore"), (1, "assistant", "yes")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", "f", 1.23456, ["a"], "x,\"y"), ("q", "f", None, [], None)], "participant string, source_path string, v double, m array<string>, content string")
    sinks.transcript_tables(df, str(tmp_path / "t"))
    assert "content" not in spark.read.parquet(str(tmp_path / "t/index")).columns
    sinks.csv(sinks.flattened(df), str(tmp_path / "c"), 3)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert {(r.v, r.content) for r in back.collect()} == {("1.235", 'x,"y'), (None, None)}
    sinks.jsonl(df, str(tmp_path / "j"), 1)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    payload = json.loads(sinks.metrics(df.select(F.col("participant").alias("annotation_id"), "v")).first().payload)
    assert payload["p"] == {"v": 1.23456}
    sinks.manifest(df.select("participant"), str(tmp_path / "m"), status="open")
    assert spark.read.json(str(tmp_path / "m/meta")).first().tasks == 2


def test_stream_is_idempotent(spark, data, tmp_path):
    src = tmp_path / "in"
    once = spark.read.parquet(f"{data}/messages.parquet").limit(200)
    once.write.parquet(str(src))
    once.write.mode("append").parquet(str(src))
    stream = ingest.once(ingest.deliveries(spark, str(src), once.schema))
    for _ in range(2):
        ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == once.dropDuplicates(ingest.KEY).count()
