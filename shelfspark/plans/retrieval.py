"""Queries of text, catalog, index and retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigrams, char_ngrams, stem, surface_tokens, tokens
from ..operators import catalog as cat
from ..operators import baseline, fusion, lexical, ngrams, search, stemming
from ..session import stage
from ..sources import table
from . import sql


def _products(s, d, kept: list[str] | None = None) -> DataFrame:
    """The product rows; the columns to keep, as a table, where a query reads them more than once."""
    return stage(cat.products(table(s, d, "catalog"), in_place=True).select(*kept), "products") if kept else cat.products(table(s, d, "catalog"))


TEXTS = ["doc_id", *lexical.TEXT.values()]


def _canonical(rows) -> DataFrame:
    return stemming.canonical_stems(cat.surface_counts(rows))


def title_queries(rows: DataFrame) -> DataFrame:
    """The stated query set: titles of the listings whose id is divisible by 50."""
    return rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


def _asked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The canonical stems, and the terms of the query set."""
    canonical = stage(_canonical(rows), "stems")
    return canonical, lexical.query_terms(title_queries(rows), canonical)


def token_counts(s, d):
    return table(s, d, "documents").select(F.explode(surface_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def stem_rules(s, d):
    return token_counts(s, d).select("token", stem(F.col("token")).alias("term"))


def singular_candidates(s, d):
    counts = cat.surface_counts(_products(s, d))
    return counts.select("token", F.explode(stemming.singular_candidates(F.col("token"))).alias("c")).select("token", F.col("c.pos").alias("pos"), "c.form")


def canonical_stems(s, d):
    return _canonical(_products(s, d))


def vocabulary_splits(s, d):
    counts = cat.surface_counts(_products(s, d))
    return stemming.vocabulary_splits(counts, stemming.canonical_stems(counts))


def bigram_counts(s, d):
    rows = _products(s, d).select(F.explode(bigrams(tokens("title"))).alias("bigram"))
    return rows.groupBy(F.replace("bigram", F.lit("\u0000"), F.lit(" ")).alias("bigram")).agg(F.count("*").alias("n"))


def char_ngram_counts(s, d):
    return _products(s, d).select(F.explode(char_ngrams("title")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def product_view(s, d):
    columns = ["doc_id", "parent_asin", "title", "gender", "gender_fallback", "brand_key", "average_rating", "rating_number", "has_description"]
    return _products(s, d).select(*columns, F.array_join("category_path", " > ").alias("category_path"), F.col("n_features").cast("long").alias("n_features"))


def last_loaded(s, d):
    return cat.ingest(table(s, d, "catalog"), keep="last").select("parent_asin", "listing_id", F.unix_micros("loaded_at").alias("loaded_us"))


def catalog_priors(s, d):
    return cat.priors(_products(s, d)).select("doc_id", F.round("popularity", 6).alias("popularity"), F.round("quality", 6).alias("quality"))


def postings_stats(s, d):
    rows = _products(s, d, TEXTS)
    index = lexical.postings(rows, _canonical(rows))
    docs = lexical.doc_lengths(index).groupBy("field").agg(F.count("*").alias("docs"), F.max("dl").alias("longest"))
    terms = index.groupBy("field").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    stats = lexical.field_stats(index, rows).select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))
    return docs.join(terms, "field").join(stats, "field")


def term_idf(s, d):
    rows = _products(s, d, TEXTS)
    stats = lexical.term_stats(lexical.postings(rows, _canonical(rows)), rows)
    return stats.select("field", "term", "df", F.round("idf", 6).alias("idf"))


def term_commonness(s, d):
    rows = _products(s, d, TEXTS)
    return lexical.commonness(lexical.term_stats(lexical.postings(rows, _canonical(rows)), rows)).select("term", F.round("commonness", 6).alias("commonness"))


def bm25_topk(s, d):
    rows = _products(s, d, TEXTS)
    return search.bm25_lists(rows, *_asked(rows), 10).select("query_id", "field", "doc_id", F.round("score", 6).alias("score"), "rank")


def _mixture(rows: DataFrame) -> DataFrame:
    return search.mixture_lists(rows, *_asked(rows), 200, 20)


def field_mixture(s, d):
    return _mixture(_products(s, d, TEXTS)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _texts(rows):
    return rows.select("doc_id", F.col("title").alias("text"))


def ngram_norms(s, d):
    texts = _texts(_products(s, d))
    index = ngrams.gram_postings(texts)
    return ngrams.doc_norms(index, ngrams.gram_stats(index, texts)).select("doc_id", F.round("norm", 4).alias("norm"))


def ngram_cosine_topk(s, d):
    rows = _products(s, d, ["doc_id", "title"])
    return search.cosine_lists(_texts(rows), title_queries(rows), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vector_cosine_topk(s, d):
    v = table(s, d, "embeddings")
    return ngrams.vector_cosine(v, v.where("vec_id % 50 = 0")).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def convex_fusion(s, d):
    rows = _products(s, d, TEXTS)
    fused = search.fused_lists(rows, *_asked(rows), _texts(rows), title_queries(rows), (200, 150), 20)
    return fused.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _phrases(s, d) -> DataFrame:
    """(query_id, phrases): the distinct feature phrases of each query listing, in lower case, blank ones left out."""
    rows = cat.ingest_in_place(table(s, d, "catalog")).where("listing_id % 50 = 0")
    kept = F.filter(F.coalesce("features", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return rows.select(F.col("listing_id").alias("query_id"), F.array_distinct(F.transform(kept, F.lower)).alias("phrases"))


def _span_lists(s, d):
    """What a customer of each query listing would state: its two shortest phrases, equally long ones in alphabetical order."""
    short = F.transform(F.array_sort(F.transform("phrases", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda y: y["x"])
    return _phrases(s, d).select("query_id", F.slice(short, 1, 2).alias("spans"))


def span_survivors(s, d):
    return fusion.span_survivors(_products(s, d), _span_lists(s, d))


def span_injection(s, d):
    rows = _products(s, d, [*TEXTS, "search_blob"])
    spans = stage(_span_lists(s, d), "spans")
    candidates = stage(_mixture(rows).select("query_id", "doc_id"), "candidates")
    return fusion.inject(candidates, stage(fusion.span_survivors(rows, spans), "survivors"), spans)


def weak_baseline(s, d):
    """The baseline on the titles of the query listings."""
    rows = cat.ingest_in_place(table(s, d, "catalog"))
    queries = rows.where("listing_id % 50 = 0").select(F.col("listing_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("text"))
    return baseline.search(rows, queries).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def span_selectivity(s, d):
    """How many listings hold each distinct feature phrase of the query listings, and how many bits it is worth."""
    rows = _products(s, d, ["doc_id", "search_blob"])
    spans = _phrases(s, d).select(F.explode("phrases").alias("span")).distinct().select(F.col("span").alias("query_id"), F.array("span").alias("spans"))
    counts = fusion.span_survivors(rows, spans).groupBy(F.col("query_id").alias("span")).agg(F.count("*").alias("survivors"))
    n = rows.agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(n)).select("span", "survivors", F.round(F.log2(F.col("n") / F.col("survivors")), 6).alias("bits"))  # one row


QUERIES = {f.__name__: f for f in (
    token_counts, stem_rules, singular_candidates, canonical_stems, vocabulary_splits, bigram_counts, char_ngram_counts, product_view, last_loaded, catalog_priors,
    postings_stats, term_idf, term_commonness, bm25_topk, field_mixture, ngram_norms, ngram_cosine_topk, vector_cosine_topk, convex_fusion, span_survivors, span_injection, weak_baseline, span_selectivity,
)}

_TOKENS = f"tok AS (SELECT token, count(*) AS n FROM (SELECT unnest({sql.surface('text')}) AS token FROM documents) GROUP BY token)"
_STEMMED = f"list_transform({sql.surface('title')}, lambda t: {sql.stem('t')})"
_SPANS = (
    "phrase AS (SELECT listing_id AS query_id, list_distinct(list_transform(list_filter(coalesce(features, []), lambda x: trim(x, ' ') <> ''), lambda x: lower(x))) AS phrases FROM listing WHERE listing_id % 50 = 0),\n"
    "spans AS (SELECT query_id, list_transform(list_sort(list_transform(phrases, lambda x: {'n': length(x), 'x': x}))[1:2], lambda y: y.x) AS spans FROM phrase),\n"
    "survivor AS (SELECT query_id, doc_id FROM spans, product WHERE len(spans) > 0 AND len(list_filter(spans, lambda s: NOT contains(search_blob, s))) = 0)"
)

_PLAIN = lambda x: f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({sql.listed(baseline.STOPWORDS)}))"
_BASELINE = sql.LISTING + f""",
cols AS (SELECT listing_id AS doc_id, 'title' AS col, title AS x FROM listing UNION ALL SELECT listing_id, 'categories', array_to_string(categories, ' ') FROM listing UNION ALL SELECT listing_id, 'features', array_to_string(features, ' ') FROM listing
  UNION ALL SELECT listing_id, 'details', array_to_string(list_transform(list_sort(map_keys(details)), lambda k: concat_ws(' ', k, details[k])), ' ') FROM listing UNION ALL SELECT listing_id, 'store', store FROM listing
  UNION ALL SELECT listing_id, 'description', array_to_string(description, ' ') FROM listing),
word AS (SELECT doc_id, col, unnest({_PLAIN('x')}) AS term FROM cols),
ix AS (SELECT doc_id, term, sum(CASE col {' '.join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in baseline.COLUMNS.items())} END) AS tf, count(*) AS n FROM word GROUP BY ALL),
dl AS (SELECT doc_id, sum(n) AS dl FROM ix GROUP BY doc_id), av AS (SELECT (SELECT count(*) FROM listing) AS docs, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM listing) AS avgdl),
asked AS (SELECT query_id, unnest(ordered[1:40]) AS term FROM (SELECT query_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS ordered FROM (SELECT listing_id AS query_id, {_PLAIN('title')} AS t FROM listing WHERE listing_id % 50 = 0))),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
hit AS (SELECT query_id, ix.doc_id, greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS gain FROM ix JOIN asked USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = ix.doc_id, av),
res AS (SELECT query_id, doc_id, round(sum(gain), 9) AS score FROM hit GROUP BY ALL)"""

ORACLE = {
    "token_counts": f"WITH {_TOKENS} SELECT token, n FROM tok",
    "stem_rules": f"WITH {_TOKENS} SELECT token, {sql.stem('token')} AS term FROM tok",
    "singular_candidates": f"WITH {sql.PRODUCT}, {sql.CANONICAL} SELECT token, pos::INTEGER AS pos, form FROM cand",
    "canonical_stems": f"WITH {sql.PRODUCT}, {sql.CANONICAL} SELECT token, canonical FROM canonical",
    "vocabulary_splits": f"""WITH {sql.PRODUCT}, {sql.CANONICAL},
t AS (SELECT k.token, n, coalesce(c.canonical, {sql.stem('k.token')}) AS term FROM counts k LEFT JOIN canonical c ON c.token = k.token WHERE n >= 5)
SELECT DISTINCT cand.form AS singular, cand.token AS plural, least(a.n, b.n) AS stake FROM cand JOIN t a ON a.token = cand.token JOIN t b ON b.token = cand.form WHERE a.term <> b.term""",
    "bigram_counts": f"WITH {sql.PRODUCT}, w AS (SELECT {_STEMMED} AS t FROM product) SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram FROM w) GROUP BY bigram",
    "char_ngram_counts": f"WITH {sql.PRODUCT} SELECT gram, count(*) AS n FROM (SELECT unnest({sql.ngrams('title')}) AS gram FROM product) GROUP BY gram",
    "product_view": f"WITH {sql.PRODUCT} SELECT doc_id, parent_asin, title, gender, gender_fallback, brand_key, average_rating, rating_number, has_description, array_to_string(category_path, ' > ') AS category_path, n_features::BIGINT AS n_features FROM product",
    "last_loaded": "SELECT trim(parent_asin) AS parent_asin, listing_id, epoch_us(loaded_at) AS loaded_us FROM catalog WHERE parent_asin IS NOT NULL AND trim(parent_asin) <> '' QUALIFY row_number() OVER (PARTITION BY trim(parent_asin) ORDER BY loaded_at DESC NULLS LAST, listing_id DESC) = 1",
    "catalog_priors": f"""WITH {sql.PRODUCT}, st AS (SELECT min(ln(1 + rating_number)) AS lo, max(ln(1 + rating_number)) AS hi, coalesce(avg(average_rating) FILTER (rating_number > 0), 4.0) AS m FROM product)
SELECT doc_id, round((ln(1 + rating_number) - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 6) AS popularity,
round(least(1.0, greatest(0.0, ((average_rating * rating_number + m * 50) / (rating_number + 50) - 1) / 4)), 6) AS quality FROM product, st""",
    "postings_stats": f"""WITH {sql.PRODUCT}, {sql.INDEX} SELECT field, count(*) AS docs, max(dl) AS longest, any_value(p.postings) AS postings, any_value(p.tokens) AS tokens, any_value(n_docs) AS n_docs, round(any_value(avgdl), 6) AS avgdl
FROM doc_stats JOIN (SELECT field, count(*) AS postings, sum(tf)::BIGINT AS tokens FROM postings GROUP BY field) p USING (field) JOIN field_stats USING (field) GROUP BY field""",
    "term_idf": f"WITH {sql.PRODUCT}, {sql.INDEX} SELECT field, term, df, round(idf, 6) AS idf FROM term_stats",
    "term_commonness": f"WITH {sql.PRODUCT}, {sql.INDEX} SELECT term, round(max(df) / max(n_docs), 6) AS commonness FROM term_stats WHERE field IN ('title', 'features', 'categories') GROUP BY term",
    "bm25_topk": f"WITH {sql.PRODUCT}, {sql.search(10)} SELECT query_id, field, doc_id, round(score, 6) AS score, rank FROM per_field",
    "field_mixture": f"WITH {sql.PRODUCT}, {sql.search(200)} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY mixture.score DESC, doc_id)::INTEGER AS rank FROM mixture QUALIFY rank <= 20",
    "ngram_norms": f"WITH {sql.PRODUCT}, {sql.GRAMS} SELECT doc_id, round(norm, 4) AS norm FROM doc_norms",
    "ngram_cosine_topk": f"WITH {sql.PRODUCT}, {sql.cosine(10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dense",
    "vector_cosine_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id)::INTEGER AS rank FROM v, v q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id QUALIFY rank <= 10""",
    "convex_fusion": f"WITH {sql.PRODUCT}, {sql.search(200)}, {sql.cosine(150)}, {sql.FUSED} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, doc_id)::INTEGER AS rank FROM fused QUALIFY rank <= 20",
    "weak_baseline": f"WITH {_BASELINE} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY res.score DESC, doc_id)::INTEGER AS rank FROM res QUALIFY rank <= 10",
    "span_selectivity": f"WITH {sql.PRODUCT}, {_SPANS}, one AS (SELECT DISTINCT unnest(phrases) AS span FROM phrase) SELECT span, count(*) AS survivors, round(log2((SELECT count(*) FROM product) / count(*)), 6) AS bits FROM one JOIN product ON contains(search_blob, span) GROUP BY span",
    "span_survivors": f"WITH {sql.PRODUCT}, {_SPANS} SELECT query_id, doc_id FROM survivor",
    "span_injection": f"""WITH {sql.PRODUCT}, {sql.search(200)}, {_SPANS},
pool AS (SELECT query_id, doc_id FROM mixture QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20)
SELECT query_id, doc_id, false AS injected FROM pool UNION ALL
SELECT s.query_id, s.doc_id, true FROM survivor s JOIN spans p USING (query_id) WHERE len(list_distinct(p.spans)) >= 2
AND (SELECT count(*) FROM survivor x WHERE x.query_id = s.query_id) <= 200 AND NOT EXISTS (SELECT 1 FROM pool WHERE pool.query_id = s.query_id AND pool.doc_id = s.doc_id)""",
}
