"""Files, settings and the stream of sessions."""

import json

from pyspark.sql import functions as F

from shelfspark.operators import catalog as cat
from shelfspark.sources import files
from shelfspark.streaming import conversations


def test_catalog_lines(spark, tmp_path):
    lines = ['{"parent_asin": "A", "title": "first", "details": {"Department": "Boys"}, "features": ["x"]}', "", "{broken", '{"parent_asin": " "}', '{"title": "no id"}', '{"parent_asin": "A", "title": "second"}', "[1]", '{"parent_asin": "B", "average_rating": 4.5, "rating_number": 7}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    got = {r["parent_asin"]: r for r in cat.products(files.read_catalog(spark, str(tmp_path / "c.jsonl"))).collect()}
    assert set(got) == {"A", "B"} and got["A"]["title"] == "first" and got["A"]["gender"] == "boys" and got["B"]["rating_number"] == 7


def test_trace_and_lines_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "A", [0.5]), ("s", 2, "B", None)], "session_id string, turn int, candidate_asin string, features array<double>")
    files.append_trace(rows, str(tmp_path / "t"))
    files.append_trace(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("turn = 2").count() == 2
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "session_id string, turn int").count() == 2


def test_settings_overlay(tmp_path):
    defaults = {"retrieval": {"k1": 1.2, "depth": 10}, "path": None}
    path = str(tmp_path / "deep" / "s.json")
    files.save_settings({"retrieval": {"k1": 2.0, "unknown": 1}, "path": "x", "more": 1}, path)
    assert files.load_settings(defaults, path) == {"retrieval": {"k1": 2.0, "depth": 10}, "path": "x"}
    (tmp_path / "n.json").write_text(json.dumps({"retrieval": None}))
    assert files.load_settings(defaults, str(tmp_path / "n.json")) == defaults


def test_fold_ignores_repeats_and_takes_late_turns():
    state = conversations.fold(([], [], 0), [(2, ["Wool"]), (2, ["again"]), (1, [])])
    assert state == ([1, 2], ["wool"], 2)
    assert conversations.fold(state, [(1, ["x"]), (4, ["WOOL", "silk"]), (3, ["late"])]) == ([1, 2, 3, 4], ["wool", "late", "silk"], 4)


def test_stream_keeps_state_over_batches(spark, tmp_path):
    schema = "session_id string, turn int, user_message string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "For that, what matters is: wool; red."), ("b", 1, None), (None, 1, "x")], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([("a", 2, "For that, what matters is: wool; blue."), ("a", 2, "For that, what matters is: wool; blue.")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = conversations.run_to_table(stream).groupBy("session_id").agg(F.max("n_spans"), F.max("last_turn"))
    assert sorted(map(tuple, rows.collect())) == [("a", 3, 2), ("b", 0, 1)]


def test_stream_without_messages(spark, tmp_path):
    schema = "session_id string, turn int, user_message string"
    (tmp_path / "none").mkdir()
    assert conversations.run_to_table(spark.readStream.schema(schema).parquet(str(tmp_path / "none"))).count() == 0


def test_staged_tables_can_be_cleared(spark):
    from shelfspark.session import clear_staged, stage

    assert stage(spark.range(5).toDF("x"), "t").count() == 5
    clear_staged(spark)
    assert stage(spark.range(3).toDF("x"), "t").count() == 3
