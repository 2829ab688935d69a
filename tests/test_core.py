"""Operators of the engine on small fixtures; the queries' SQL is checked in test_oracle."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.text import bigrams, char_ngrams, clean_constraint, overlap, stem, surface_tokens, tokens
from shelfspark.operators import catalog as cat
from shelfspark.operators import dialogue, evaluate, fusion, learn, lexical, nested, ngrams, ranking, stemming
from shelfspark.operators.latest import latest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("word, want", [("bodies", "body"), ("dresses", "dress"), ("watches", "watch"), ("boxes", "box"), ("shirts", "shirt"), ("brass", "brass"), ("bus", "bus"), ("his", "his"), ("as", "as"), ("", "")])
def test_default_plural_rules(spark, word, want):
    assert one(spark, stem(F.lit(word))) == want


def test_tokens_drop_stop_words_and_single_characters(spark):
    assert one(spark, surface_tokens(F.lit("The New Dresses & a 4-pack, I want!"))) == ["dresses", "pack"]
    assert one(spark, tokens(F.lit("Dresses shirts"))) == ["dress", "shirt"]
    assert one(spark, surface_tokens(F.lit(None).cast("string"))) == []


def test_bigrams_and_ngrams_of_short_input(spark):
    assert one(spark, bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a\0b", "b\0c"]
    assert one(spark, bigrams(F.array(F.lit("a")))) == []
    assert one(spark, char_ngrams(F.lit("ab"))) == [" ab "]
    assert one(spark, char_ngrams(F.lit("a"))) == []
    assert one(spark, char_ngrams(F.lit("A-b1"))) == [" a b", "a b1", " b1 "]


def test_overlap_and_cleaning(spark):
    q = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, overlap(q, F.array(F.lit("b")))) == 0.5
    assert one(spark, overlap(F.array().cast("array<string>"), q)) == 0.0
    assert one(spark, clean_constraint(F.lit("  - soft;  cotton ,. "))) == "soft; cotton"


def counts(spark, table):
    return spark.createDataFrame(list(table.items()), "token string, n long")


@pytest.mark.parametrize(
    "table, want",
    [
        ({"scarves": 60, "scarf": 50, "gloves": 70, "glove": 30}, {"scarves": "scarf", "gloves": "glove"}),
        ({"capes": 33, "cape": 40, "cap": 90}, {"capes": "cape"}),
        ({"lens": 50, "lenses": 60, "lense": 1}, {"lens": "lens", "lenses": "lens"}),
        ({"women": 300, "woman": 5}, {"woman": "women"}),
        ({"hoodies": 30, "hoodie": 25, "hoody": 24}, {"hoodies": "hoodie"}),
        ({"rares": 3, "rare": 2}, {}),
        ({}, {}),
    ],
)
def test_catalog_decides_singulars(spark, table, want):
    got = {r[0]: r[1] for r in stemming.canonical_stems(counts(spark, table)).collect()}
    assert got == want


def test_products_defaults_and_first_wins(catalog):
    import datetime as dt

    rows = [
        {"listing_id": 2, "parent_asin": " A ", "title": "Women's Dress", "categories": ["Clothing, Shoes & Jewelry", "Women, Dresses", None, ""], "store": "Some Brand", "features": ["a", None, "b"]},
        {"listing_id": 1, "parent_asin": "A", "title": "later", "loaded_at": dt.datetime(2026, 2, 1)},
        {"listing_id": 3, "parent_asin": " "},
        {"listing_id": 4, "parent_asin": None},
        {"listing_id": 5, "parent_asin": "B", "details": {"Department": "Unisex_Child"}},
    ]
    got = {r["parent_asin"]: r for r in cat.products(catalog(rows)).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"]["doc_id"] == 2 and got["A"]["gender_fallback"] == "women" and got["A"]["category_path"] == ["Shoes & Jewelry", "Women", "Dresses"] or got["A"]["category_path"] == ["Women", "Dresses"]
    assert got["B"]["gender"] == "kids" and got["B"]["title"] == "" and got["B"]["rating_number"] == 0


def test_bm25_prefers_the_rarer_term_and_breaks_ties_by_id(catalog):
    rows = cat.products(catalog([{"listing_id": i, "parent_asin": f"P{i}", "title": t} for i, t in enumerate(["red boot", "red hat", "blue boot", "green sock", "grey sock", "red hat"])]))
    canonical = stemming.canonical_stems(cat.surface_counts(rows))
    index = lexical.postings(rows, canonical)
    queries = rows.sparkSession.createDataFrame([(9, "hat sock hat")], "query_id long, text string")
    shares, stats = lexical.weighed(index, rows), lexical.term_stats(index, rows)
    got = lexical.bm25_scores(shares, stats, lexical.query_terms(queries, canonical, ("title",)), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 3, 4, 5]
    assert lexical.bm25_scores(shares, stats, lexical.query_terms(queries.where("query_id < 0"), canonical), 5).count() == 0


def test_cosine_finds_a_misspelled_title(catalog):
    rows = cat.products(catalog([{"listing_id": i, "parent_asin": f"P{i}", "title": t} for i, t in enumerate(["leather wallet", "cotton shirt", "wool scarf", "silk tie", "linen pants", "denim skirt"])]))
    texts = rows.select("doc_id", F.col("title").alias("text"))
    queries = rows.sparkSession.createDataFrame([(1, "lether walet"), (2, "")], "query_id long, text string")
    got = ngrams.cosine_scores(ngrams.gram_postings(texts), texts, queries, 3).where("rank = 1").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 0)]


def test_injection_keeps_candidates_and_spans_never_widen(spark, catalog):
    rows = cat.products(catalog([{"listing_id": i, "parent_asin": f"P{i}", "title": t} for i, t in enumerate(["soft red wool hat", "soft hat", "red wool sock"])]))
    spans = spark.createDataFrame([(1, ["soft", "wool"]), (2, ["red wool"]), (3, []), (4, ["soft", None]), (5, ["", "oo"]), (6, [""])], "query_id long, spans array<string>")
    survivors = fusion.span_survivors(rows, spans)
    assert sorted(map(tuple, survivors.collect())) == [(1, 0), (2, 0), (2, 2), (5, 0), (5, 2)]
    assert sorted(map(tuple, fusion.span_survivors(rows, spans, 1).collect())) == sorted(map(tuple, survivors.collect()))
    assert fusion.span_survivors(rows, spans.where("query_id = 3")).count() == 0
    pool = spark.createDataFrame([(1, 1), (2, 2)], "query_id long, doc_id long")
    assert sorted(map(tuple, fusion.inject(pool, survivors.where("query_id < 3"), spans).collect())) == [(1, 0, True), (1, 1, False), (2, 2, False)]


def test_fusion_divides_by_the_largest(spark):
    lex = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0)], "query_id long, doc_id long, score double")
    dense = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "query_id long, doc_id long, score double")
    got = {r["doc_id"]: r["score"] for r in fusion.convex_combine(lex, dense, 0.5).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: 0.25}


@pytest.mark.parametrize("want, have, out", [("women", "women", "satisfied"), ("women", "unisex", "satisfied"), ("unisex", "men", "unknown"), ("kids", "boys", "satisfied"), ("boys", "kids", "unknown"), ("boys", "girls", "violated"), (None, "men", "unknown"), ("men", None, "unknown"), ("kids", "unisex", "unknown")])
def test_gender_outcomes(spark, want, have, out):
    assert one(spark, ranking.check_gender(F.lit(want).cast("string"), F.lit(have).cast("string"))) == out


@pytest.mark.parametrize("text, out", [("faux leather bag", "unknown"), ("genuine leather bag", "satisfied"), ("faux leather with leather trim", "satisfied"), ("cowhide", "satisfied"), ("cloth", "unknown")])
def test_leather_is_not_faux_leather(spark, text, out):
    assert one(spark, ranking.check_material(F.array(F.lit("leather")), F.lit(text))) == out


PARSED = [
    ("I'm looking for Women Boots. A key requirement is: rubber sole.", "Women Boots", ["rubber sole"], None, False, False),
    ("For that, what matters is: soft; color: red.", "", ["soft", "color: red"], None, False, False),
    ("I don't have a preference for size; please use your judgment.", "", [], "size", False, False),
    ("Those options are not quite right yet. Ask me about one specific attribute.", "", [], None, True, False),
    ("Actually, ignore my earlier preference. What I need is: wool.", "", ["wool"], None, False, True),
    ("I'm looking for Hats, but I'm still exploring.", "Hats", [], None, False, False),
    ("", "", [], None, False, False),
]


@pytest.mark.parametrize("text, phrase, spans, refused, nudge, override", PARSED)
def test_parse(spark, text, phrase, spans, refused, nudge, override):
    r = dialogue.parse(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["category_phrase"], r["spans"], r["refused"], r["is_nudge"], r["is_override"]) == (phrase, spans, refused, nudge, override)


def test_turns_keep_the_last_loaded_and_drop_null_keys(spark):
    rows = spark.createDataFrame([("s", 1, "old", 1), ("s", 1, "new", 2), (None, 1, "x", 1), ("s", 2, None, 1)], "session_id string, turn int, user_message string, t int")
    got = dialogue.turns(rows.withColumn("loaded_at", F.timestamp_seconds("t"))).orderBy("turn").collect()
    assert [tuple(r) for r in got] == [("s", 1, "new"), ("s", 2, "")]


@pytest.mark.parametrize("text, want", [("baby girls bodysuit", "girls"), ("toddler hat", "kids"), ("for women and boys", "women"), ("nothing", None)])
def test_audience_of_messages(spark, text, want):
    assert one(spark, dialogue.audience_of(F.lit(text))) == want


def test_metrics_with_one_hit_and_one_miss(spark):
    rows = spark.createDataFrame([("a", "x", True, 2, 2, 0.5), ("b", "x", False, None, None, 0.0)], "sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")
    got = {r["scenario_type"]: r for r in evaluate.metrics(rows).collect()}
    assert (got["all"]["hit_rate"], got["all"]["mrr"], got["all"]["mttc"]) == (0.5, 0.25, 6.5)
    assert evaluate.metrics(rows.where("false")).where("sample_count > 0").count() == 0


def test_gap_means_at_a_half_do_not_hang_on_the_order_of_rows(spark):
    # (0.457349 + 0.816812) / 2 is 0.6370805, in floats a little less
    rows = spark.createDataFrame([("x", 0.457349), ("x", 0.816812), ("y", -0.457349), ("y", -0.816812)], "feature string, contribution double")
    assert {r["feature"]: r["mean_gap"] for r in evaluate.gap_summary(rows).collect()} == {"x": 0.637081, "y": -0.637081}


def test_commitment_edges(spark):
    rows = [("one", 1, 0.5), *[("flat", i, 1.0) for i in (1, 2, 3)], ("zero", 1, 0.0), ("zero", 2, 0.0)]
    long = [("long", i, 1.0 if i == 1 else 0.5) for i in range(1, 300)]
    ten = [("ten", i, 1.0 if i == 1 else 0.5) for i in range(1, 11)]
    got = {r[0]: r[1] for r in evaluate.commitment(spark.createDataFrame(rows + long + ten, "k string, rank int, score double"), ["k"]).collect()}
    assert got["one"] == 1.0 and got["flat"] == 0.0 and got["zero"] == 0.0 and got["long"] == got["ten"]


def test_valid_lists(spark, catalog):
    known = catalog([{"listing_id": i, "parent_asin": a} for i, a in enumerate("AB")])
    lists = spark.createDataFrame([("s", 1, ["X", " B ", "A", "B", None])], "session_id string, turn int, items array<string>")
    got = evaluate.valid_lists(lists, known).orderBy("place").collect()
    assert [(r["parent_asin"], r["place"]) for r in got] == [("B", 1), ("A", 2)]


def test_mmr_spreads_titles_and_keeps_everything(spark):
    rows = [("s", 1, "a", 1.0, 1, ["x", "y"]), ("s", 1, "b", 0.99, 2, ["x", "y"]), ("s", 1, "c", 0.98, 3, ["z"]), ("s", 1, "d", 0.1, 4, [])]
    df = spark.createDataFrame(rows, "session_id string, turn int, item string, score double, rank int, terms array<string>")
    got = ranking.mmr(df, ["session_id", "turn"], "item", 3).orderBy("rank").collect()
    assert [r["item"] for r in got] == ["a", "c", "b", "d"]


def test_pairwise_fit_reduces_violations(spark):
    d = spark.createDataFrame([("s", 1, "w", [1.0, -1.0]), ("s", 2, "w", [0.5, -2.0])], "session_id string, turn int, winner string, d array<double>")
    weights, history = learn.fit_pairwise(d, [0.0, 1.0], 30, 1.0, 0.01)
    assert history[0] == 1 or history[0] == 2
    assert learn._gradient(d, __import__("numpy").array(weights))[1] == 0


def test_positional_join(spark):
    a = spark.createDataFrame([(i,) for i in (5, 3, 9)], "x int")
    b = spark.createDataFrame([(s,) for s in "cab"], "y string")
    got = learn.positional_join(a, b, ["x"], ["y"]).orderBy("position").collect()
    assert [(r["x"], r["y"]) for r in got] == [(3, "a"), (5, "b"), (9, "c")]
    with pytest.raises(ValueError):
        learn.positional_join(a, b.limit(2), ["x"], ["y"])


def test_latest_takes_the_last_row_and_only_the_columns_asked_for(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (2, None, None)], "id long, v string, t int").withColumn("loaded_at", F.timestamp_seconds("t"))
    assert sorted(map(tuple, latest(rows, "id", ["v"]).collect())) == [(1, "b"), (2, None)]


NESTED = [
    (1, '{"categories": ["a", null, "b"], "details": {"variants": [{"color": "x", "offers": {"sku": "1"}}, null]}}', [("categories", "0"), ("categories", "2"), ("details.variants", "0"), ("details.variants.offers", "0.0")]),
    (2, '{"categories": "alone", "details": null}', [("categories", "0")]),
    (3, '{"user_profile": "{\\"preference_tags\\": [{\\"tag\\": \\"t\\", \\"evidence\\": [{\\"kind\\": \\"k\\"}]}]}"}', [("user_profile.preference_tags", "0"), ("user_profile.preference_tags.evidence", "0.0")]),
    (4, None, [("_corrupt", "")]),
    (5, "", [("_corrupt", "")]),
    (6, "[1]", [("_corrupt", "")]),
    (7, '{"a": 1', [("_corrupt", "")]),
    (8, "{}", []),
    (9, '{"categories": [], "details": "not json"}', []),
    (10, '{"details": {"care": {"steps": {"step": "s", "notes": "n"}}}}', [("details.care.steps", "0"), ("details.care.steps.notes", "0.0")]),
    (11, '{"categories": ["' + "long " * 50_000 + '"]}', [("categories", "0")]),
    (12, "[" * 100_000, [("_corrupt", "")]),
]


def test_nested_elements(spark):
    raw = spark.createDataFrame([(i, p, "clash") for i, p, _ in NESTED], "record_id long, payload string, ordinals string")
    got = sorted(map(tuple, nested.list_elements(raw).collect()))
    assert got == sorted((i, path, at) for i, _, rows in NESTED for path, at in rows)
    assert nested.list_elements(raw.where("false")).count() == 0


def test_nested_tables_keep_links(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"details": {"variants": [{"color": "x", "offers": [{"sku": "s", "size": 4, "stock": [{"depot": "D", "qty": 3}]}]}]}}')], "record_id long, payload string")
    tagged = nested.flatten_records(raw)
    offer = nested.nested_table(tagged, "details.variants.offers").first()
    assert (offer["sku"], offer["size"], offer["parent_path"], offer["parent_ordinals"], offer["ordinals"]) == ("s", "4", "details.variants", "0", "0.0")
    stock = nested.nested_table(tagged, "details.variants.offers.stock").first()
    assert (stock["depot"], stock["qty"], stock["parent_ordinals"]) == ("D", 3, "0.0")
    nested.write_tables(raw, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4  # the record itself, too
    assert nested.read_table(spark, str(tmp_path / "t"), "details.variants.offers.stock").first()["qty"] == 3
