import json

import pytest
from pyspark.sql import functions as F

from vellum.sources import files
from vellum.streaming.ingest import append_once, arrivals, json_stream


def test_books(spark, tmp_path):
    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "b" / "x.txt").write_bytes(b"a\xffb\r\nc")
    (tmp_path / "b" / "c" / "y.txt").write_text("other")
    (tmp_path / "b" / "z.md").write_text("no")
    rows = files.in_path_order(files.read_books(spark, str(tmp_path))).collect()
    assert [(r.path[-7:], r.text) for r in rows] == [("c/y.txt", "other"), ("b/x.txt", "ab\nc")]


def test_text_column(spark):
    assert files.text_column(spark.createDataFrame([("a", "b")], "content string, body string")) == "content"
    assert files.text_column(spark.createDataFrame([("a", "longer")], "x string, y string")) == "y"
    assert files.text_column(spark.createDataFrame([(1,)], "x int")) is None
    assert files.text_column(spark.createDataFrame([], "text string")) is None


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("a_x", "c", "s", "x", 0.9, None)], files.KEPT_PAIR)
    files.write_jsonl(df, path)
    files.write_jsonl(df.limit(0), path, overwrite=False)
    assert [tuple(r) for r in files.read_jsonl(spark, path, files.KEPT_PAIR).collect()] == [("a_x", "c", "s", "x", 0.9, None)]
    assert "sem_sim" not in (next((tmp_path / "p").glob("*.json"))).read_text()
    assert files.read_splits(spark, {"train": path, "val": path}, files.PAIR).groupBy("split").count().count() == 2


def test_keyed_json(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"a": {"id": "a", "outline": {"setting": "x"}}, "b": "text"}, indent=2))
    rows = {r.id: r.e for r in files.read_keyed_json(spark, str(tmp_path / "o.json")).select("id", F.to_json("entry").alias("e")).collect()}
    assert json.loads(rows["a"])["outline"]["setting"] == "x" and rows["b"] == '"text"'


def test_keyed_json_loses_nothing(spark, tmp_path):
    rows = spark.range(60_000).select(F.concat(F.lit('k"'), F.lpad("id", 7, "0")).alias("id"), F.to_json(F.struct(F.repeat(F.lit("xé"), 500).alias("t"))).alias("entry"))
    files.write_keyed_json(rows, str(tmp_path / "big"))
    read = files.read_keyed_json(spark, str(tmp_path / "big"))
    assert read.agg(F.count("*"), F.min("id"), F.sum(F.length(F.try_variant_get("entry", "$.t", "string")))).first()[:] == (60_000, 'k"0000000', 60_000_000)
    for i, bad in enumerate(('{"a": 1, "b"', '[1]', '{"a": 1} x', '{"a": 1,}', "")):
        (tmp_path / f"{i}.json").write_text(bad)
        with pytest.raises(Exception, match="keyed file|Expecting|MALFORMED"):
            files.read_keyed_json(spark, str(tmp_path / f"{i}.json")).collect()
    assert list(files.entries(' {"a": {"b": [1, "}"]}, "c":2 } ')) == [("a", '{"b": [1, "}"]}'), ("c", "2")] and not list(files.entries("{}"))


def test_files_of_rows(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "x\r\ny"), ("b.txt", None), ("c.txt", "é")], "name string, text string")
    assert files.write_files(df, str(tmp_path / "f")) == 3 == files.write_files(df, (tmp_path / "f").as_uri())
    assert {(r.path[-5:], r.text) for r in files.read_books(spark, str(tmp_path / "f")).collect()} == {("a.txt", "x\ny"), ("c.txt", "é")}


def test_append_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, "c", "s", "t") for i in ids], files.PAIR)
    assert files.append_new(rows("a", "b", "c"), path, "id", files.PAIR, size=2) == 2
    assert files.append_new(rows("b", "c", "d"), path, "id", files.PAIR) == 1
    assert files.append_new(rows("a"), path, "id", files.PAIR) == 0
    assert sorted(r.id for r in files.read_jsonl(spark, path, files.PAIR).collect()) == ["a", "b", "c", "d"]


def test_existing(spark, tmp_path):
    (tmp_path / "a").touch()
    paths = {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}
    assert list(files.existing(spark, paths)) == ["a"] and files.existing(spark, paths, ["b"]) == {}


def test_reports_lines_and_numbers(spark, tmp_path):
    assert files.write_report(spark.createDataFrame([(1.5, "x")], "a double, b string"), str(tmp_path / "r" / "x.json")) == json.loads((tmp_path / "r" / "x.json").read_text())
    files.write_lines(spark.createDataFrame([(" one",), ("",), ("two",)], "p string"), "p", str(tmp_path / "l"))
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "l")).collect()] == ["one", "two"]
    df = spark.range(25).select("id", F.col("id").cast("string").alias("text")).repartition(5)
    assert {(r.name, r.text) for r in files.numbered(df, "id").collect()} == {(f"{i:05d}.txt", str(i)) for i in range(25)}
    assert [r.id for r in files.first_rows(df, 3, "id").collect()] == [0, 1, 2]
    assert {len(r.text) for r in files.sampled_heads(df, "id", "text", 5, 1).collect()} == {1}


def test_stream_appends_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def run():
        q = append_once(json_stream(spark, str(src), files.PAIR), out, "id", str(tmp_path / "cp"))
        q.awaitTermination(60)

    (src / "1.json").write_text('{"id": "a", "clean": "x"}\n{"id": "a", "clean": "x"}\n{"id": "b"}\n')
    run()
    (src / "2.json").write_text('{"id": "b"}\n{"id": "c"}\n')
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_arrivals_by_window(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text('{"at": "2025-03-01T00:10:00Z", "teacher": "h"}\n{"at": "2025-03-01T00:50:00Z", "teacher": "h"}\n{"at": "2025-03-01T01:10:00Z", "teacher": "h"}\n')
    stream = json_stream(spark, str(tmp_path / "e"), "at timestamp, teacher string")
    q = arrivals(stream, "at", "teacher").writeStream.outputMode("complete").format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("select * from arrived").collect()) == [1, 2]
