"""What queries keep on disk and in memory, and that they give the same rows however their work is cut."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shelfspark import session
from shelfspark.functions import text
from shelfspark.operators import catalog as cat
from shelfspark.operators import fusion, lexical, ngrams, search, stemming


def shuffled(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_shuffles_of_a_staged_table_are_gone_once_it_is_written(spark):
    before = shuffled(spark)
    kept = session.stage(spark.range(10_000).repartition(4).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")), "counts")
    assert not shuffled(spark) - before
    assert kept.agg(F.sum("n")).first()[0] == 10_000


def test_first_rows_are_the_same_without_a_shuffle_of_wide_rows(catalog):
    at = lambda day: dt.datetime(2026, 1, day)
    rows = [("A", 1, 2), ("A", 2, 1), (" A", 3, 1), ("B", 4, 1), ("B", 4, 1), ("C", 5, None), ("C", 6, 1), ("D", 7, 3), (None, 8, 1), (" ", 9, 1)]
    df = catalog([{"parent_asin": a, "listing_id": i, "loaded_at": at(t) if t else None} for a, i, t in rows])
    kept = lambda x: sorted((r["parent_asin"], r["listing_id"]) for r in x.collect())
    assert kept(cat.ingest_in_place(df)) == kept(cat.ingest(df)) == [("A", 2), ("B", 4), ("C", 5), ("D", 7)]


@pytest.fixture
def many(catalog):
    words = ["red", "boots", "boot", "hats", "leather", "wool", "blue", "socks", "dress", "dresses", "glass"]
    pick = lambda i, k: " ".join(words[(i * (k + 3) + j * j * k) % len(words)] for j in range(i % 7))
    made = [{"listing_id": i, "parent_asin": f"P{i}", "title": pick(i, 1), "features": [pick(i, 2), pick(i + 1, 5)], "store": pick(i, 4)} for i in range(300)]
    return session.stage(cat.products(catalog(made)).repartition(5), "products")


def listed(df):
    columns = [c for c in df.columns if c != "score"]
    return {tuple(r[c] for c in columns): round(r["score"], 7) for r in df.collect()}


def test_lists_of_all_queries_are_those_of_the_joins(many):
    canonical = session.stage(stemming.canonical_stems(cat.surface_counts(many)), "stems")
    wanted = lexical.query_terms(many.where("doc_id % 10 = 0").select(F.concat("store", F.lit("-"), "doc_id").alias("query_id"), F.concat_ws(" ", "title", F.lit("unheard")).alias("text")), canonical)
    wanted = wanted.withColumn("weight", F.when(F.col("term") == "red", 0.0).when(F.col("field") == "title", 2.5).otherwise(F.col("weight")))
    index = lexical.postings(many, canonical)
    joined = lexical.bm25_scores(lexical.weighed(index, many), lexical.term_stats(index, many), wanted, 20)
    got = listed(search.bm25_lists(many, canonical, wanted, 20))
    assert got and got == listed(joined.select("query_id", "field", "doc_id", "score", "rank"))
    mixed = lexical.top(lexical.field_mixture(joined), ["query_id"], 7)
    assert listed(search.mixture_lists(many, canonical, wanted, 20, 7)) == listed(mixed)
    texts, spoken = many.select("doc_id", F.col("title").alias("text")), many.where("doc_id % 10 = 0").select(F.concat("store", F.lit("-"), "doc_id").alias("query_id"), F.concat_ws(" ", "title", F.lit("bots")).alias("text"))
    dense = ngrams.cosine_scores(ngrams.gram_postings(texts), texts, spoken, 15)
    got = listed(search.cosine_lists(texts, spoken, 15))
    assert got and got == listed(dense.select("query_id", "doc_id", "score", "rank"))
    fused = lexical.top(fusion.convex_combine(lexical.field_mixture(joined), dense), ["query_id"], 9)
    assert listed(search.fused_lists(many, canonical, wanted, texts, spoken, (20, 15), 9)) == listed(fused)


def test_stems_in_python_are_those_of_the_expression(spark):
    words = ["bodies", "dies", "dresses", "ses", "watches", "wishes", "boxes", "sizes", "shirts", "brass", "bus", "his", "as", "s", "İs", "éclairs", "grass", "asses", "buzzes", "ties"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("t"))
    assert {r["w"]: search.stem_of(r["w"]) for r in df.collect()} == {r["w"]: r["t"] for r in df.collect()}


def test_a_term_counts_up_to_the_largest_frequency(catalog):
    rows = cat.products(catalog([{"listing_id": 1, "parent_asin": "A", "title": "red " * 40000 + "hat"}, {"listing_id": 2, "parent_asin": "B", "title": "blue hat"}, {"listing_id": 3, "parent_asin": "C", "title": "sock"}, {"listing_id": 4, "parent_asin": "D", "title": "tie"}]))
    canonical = stemming.canonical_stems(cat.surface_counts(rows))
    wanted = lexical.query_terms(rows.sparkSession.createDataFrame([(1, "red"), (2, "")], "query_id long, text string"), canonical)
    index = lexical.postings(rows, canonical)
    joined = lexical.bm25_scores(lexical.weighed(index, rows), lexical.term_stats(index, rows), wanted, 5)
    assert listed(search.bm25_lists(rows, canonical, wanted, 5)) == listed(joined.select("query_id", "field", "doc_id", "score", "rank"))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test data not here")
def test_tables_that_grow_are_not_broadcast_to_candidates(spark):
    plan = __spark_entry__.queries()["constraint_outcomes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    products = [line for line in plan.split("\n") if "Join [candidate_asin" in line or "Join [session_id" in line]
    assert products and all("SortMergeJoin" in line for line in products), products


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test data not here")
@pytest.mark.parametrize("name", ["bm25_topk", "field_mixture", "ngram_cosine_topk", "convex_fusion", "weak_baseline"])
def test_hits_are_never_joined_or_shuffled(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the queries are dealt
