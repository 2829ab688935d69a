"""Session state, learners, answered batches and the readers beside them."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog as cat
from shelfspark.operators import dialogue, evaluate, learn, nested, state
from shelfspark.operators.latest import latest, latest_of_wide
from shelfspark.sources import files


@pytest.fixture(scope="module")
def said(spark):
    rows = [
        ("s", 1, "I'm looking for Women Dresses. A key requirement is: red cotton."),
        ("s", 2, "For that, what matters is: machine wash only; size large."),
        ("s", 3, "Actually, ignore my earlier preference. What I need is: blue instead of red."),
        ("t", 1, "I'm looking for shoes. A key requirement is: black leather."),
        ("t", 2, "Actually, ignore my earlier preference. What I need is: arch support."),
        ("u", 1, ""),
    ]
    df = spark.createDataFrame([(*r, dt.datetime(2026, 1, 1)) for r in rows], "session_id string, turn int, user_message string, loaded_at timestamp")
    return dialogue.parse(dialogue.turns(df)).cache()


@pytest.fixture
def parts(said, catalog):
    products = cat.products(catalog([{"listing_id": 1, "parent_asin": "A", "title": "Dress", "categories": ["Women", "Dresses"], "store": "Zarf Kolm"}]))
    stated = state.statements(said)
    named = said.select(F.col("category_phrase").alias("text"))
    values = state.slot_values(stated.select("text").unionByName(named), products, dialogue.brand_vocabulary(products)).cache()
    events = state.touched_slots(stated, values).cache()
    return said, stated, values, events, state.phrases(said, events)


def test_a_change_of_color_takes_back_the_color_only(parts):
    said, stated, values, events, named = parts
    spans = {(r["session_id"], r["turn"], r["text"]): (r["weight"], r["superseded"]) for r in state.span_states(stated, events, values, said).collect()}
    assert spans["s", 2, "red cotton"] == (1.0, False) and spans["s", 3, "red cotton"] == (0.25, True)
    assert spans["s", 3, "size large"] == (1.0, False) and spans["s", 3, "blue"] == (1.0, False)
    slots = {(r["session_id"], r["turn"], r["slot"]): r["value"] for r in state.slot_states(stated, events, values, named).collect()}
    assert slots["s", 2, "colors"] == "red" and slots["s", 3, "colors"] == "blue" and slots["s", 3, "sizes"] == "large" and slots["s", 3, "gender"] == "women"


def test_a_change_that_names_nothing_takes_back_everything_soft(parts):
    said, stated, values, events, named = parts
    slots = {(r["turn"], r["slot"]) for r in state.slot_states(stated, events, values, named).where("session_id = 't'").collect()}
    assert (1, "colors") in slots and (1, "materials") in slots and not {(2, "colors"), (2, "materials")} & slots
    spans = {(r["turn"], r["text"]): r["weight"] for r in state.span_states(stated, events, values, said).where("session_id = 't'").collect()}
    assert spans[2, "black leather"] == 0.25 and spans[2, "arch support"] == 1.0


def test_later_statements_weigh_more_and_withdrawn_ones_less(spark, parts):
    said, stated, values, events, named = parts
    none = spark.createDataFrame([], "token string, canonical string")
    got = {(r["field"], r["term"]): r["weight"] for r in state.weighted_terms(state.span_states(stated, events, values, said), named, none).where("session_id = 's' and turn = 3").collect()}
    assert got["features", "blue"] == pytest.approx(1.3) and got["features", "cotton"] == pytest.approx(0.25) and got["features", "large"] == pytest.approx(1.15)
    assert got["title", "dress"] == pytest.approx(1.0)
    common = spark.createDataFrame([("blue", 0.35)], "term string, commonness double")
    damped = state.weighted_terms(state.span_states(stated, events, values, said), named, none, common, penalty=1.0).where("session_id = 's' and turn = 3 and term = 'blue' and field = 'features'").first()
    assert damped["weight"] == 0.0
    empty = said.where("false")
    assert state.span_states(state.statements(empty), events, values, empty).count() == 0


def test_kept_text(spark):
    df = spark.createDataFrame([("white sneakers instead of black shoes",), ("Not red, blue",), ("knot",), (None,)], "text string")
    assert [r[0] for r in df.select(state.kept_text(F.col("text"))).collect()] == ["white sneakers", "", "knot", None]


def test_last_list_is_remembered(spark):
    lists = spark.createDataFrame([("s", 1, ["A"]), ("s", 2, []), ("s", 4, ["B"])], "session_id string, turn int, items array<string>")
    turns = spark.createDataFrame([("s", k) for k in range(1, 6)] + [("t", 1)], "session_id string, turn int")
    assert [r["items"] for r in state.remembered(lists, turns).orderBy("session_id", "turn").collect()] == [["A"], ["A"], ["A"], ["B"], ["B"], None]


def test_override_turn_is_that_of_the_generator(spark):
    keys = [f"s{i}\0intent_override" for i in range(20)]
    got = spark.createDataFrame([(k,) for k in [*keys, None]], "k string").select(evaluate.override_turn("k")).collect()
    assert [r[0] for r in got] == [random.Random(k).choice([3, 4]) for k in keys] + [None]


def test_separable_vectors_are_told_from_others(spark):
    good = spark.createDataFrame([([1.0, 0.2],), ([0.5, -0.1],), ([0.0, 1.0],)], "d array<double>")
    w, _ = learn.perceptron(good, 2, 50)
    assert w is not None and learn.satisfied(good, w) == 3
    bad = good.unionByName(spark.createDataFrame([([-1.0, -0.2],)], "d array<double>"))
    assert learn.perceptron(bad, 2, 20)[0] is None
    many, w = learn.greedy_subset(bad, 2, 20, 20)
    assert 2 <= many <= 3 and learn.greedy_subset(good.where("false"), 2)[0] == 0
    assert [round(x, 6) for x in learn.unit(spark.createDataFrame([([3.0, 4.0],)], "d array<double>")).first()["d"]] == [0.6, 0.8]


def test_weights_survive_a_file(tmp_path):
    path = str(tmp_path / "m" / "weights.json")
    files.save_weights({"a": 0.5, "b": -1.0}, {"buying": {"a": 0.0}}, path)
    assert files.load_weights(["b", "a", "c"], path) == ({"b": -1.0, "a": 0.5, "c": 0.0}, {"buying": {"a": 0.0}})


def test_wide_rows_stay_where_they_are(spark, monkeypatch):
    at = [dt.datetime(2026, 1, k) for k in (1, 2)]
    rows = [(1, "a", at[0]), (1, "b", at[1]), (2, "c", at[0]), (2, "c", at[0]), (3, "d", None), (4, "e", None), (4, "f", at[0]), (None, "g", at[0]), (5, "h", None), (5, "h", None)]
    df = spark.createDataFrame(rows, "id long, x string, loaded_at timestamp")
    want = sorted(map(tuple, latest(df, "id", ["x"]).collect()))
    assert want == [(1, "b"), (2, "c"), (3, "d"), (4, "f"), (5, "h")]
    assert sorted(map(tuple, latest_of_wide(df, "id", ["x"]).collect())) == want
    assert "Window" not in latest_of_wide(df.where("id in (1, 3)"), "id", ["x"])._jdf.queryExecution().toString()
    monkeypatch.setattr("shelfspark.operators.latest.SENT", 1)
    assert sorted(map(tuple, latest_of_wide(df, "id", ["x"]).collect())) == want
    assert latest_of_wide(df.where("false"), "id", ["x"]).count() == 0


def test_record_itself_is_the_root_row(spark):
    record = {"title": "T", "details": json.dumps({"Color": "red", "variants": [{"color": "red", "offers": {"sku": "1"}}]}), "odd": [[{"deep": [1]}]]}
    raw = spark.createDataFrame([(1, json.dumps(record)), (2, "{"), (3, None), (4, "{}")], "record_id long, payload string")
    got = {(r["record_id"], r["child_path"], r["ordinals"]): r for r in nested.typed_tables(raw).collect()}
    root = got[1, "_record", ""]
    assert json.loads(root["fields"]) == {"title": "T", "details": {"Color": "red"}} and root["parent_path"] is None
    assert got[1, "details.variants", "0"]["parent_path"] == "_record" and got[1, "details.variants.offers", "0.0"]["parent_ordinals"] == "0"
    assert (4, "_record", "") in got and (2, "_corrupt", "") in got and (3, "_corrupt", "") in got
    assert nested.list_paths(raw.where("record_id = 1")) == ["details.variants", "odd"]
    assert nested.list_paths(raw.where("false")) == []
