"""Queries of dialogue, ranking and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import (
    BOILERPLATE, BROWSING_MARKERS, BUYING_MARKERS, CARD_COLORS, CARD_MATERIALS, CARD_NOISE, COLORS, CONSTRAINT_WORDS, FAKE_QUALIFIERS, GENUINE, INTENT_WEIGHTS, MATERIALS, NOT_BRANDS, OVERRIDE_MARKERS, SCAFFOLD, SIZES, SPOKEN_AUDIENCE, TAG_WORDS,
    USE_CASES, WEIGHTS,
)
from ..functions.text import tokens
from ..operators import catalog as cat
from ..operators import dialogue, evaluate, learn, ranking
from ..session import stage
from ..sources import table
from ..streaming import conversations
from . import sql

LIST = ["session_id", "turn"]


def _products(s, d) -> DataFrame:
    return cat.products(table(s, d, "catalog"))


def _parsed(s, d) -> DataFrame:
    return dialogue.parse(dialogue.turns(table(s, d, "customer_turns")))


def parse_turns(s, d):
    return _parsed(s, d).select(*LIST, "is_override", "refused", "is_nudge", "category_phrase", F.array_join("spans", " | ").alias("spans"))


def intent_markers(s, d):
    return dialogue.turns(table(s, d, "customer_turns")).select(*LIST, dialogue.marker_score(F.col("text")).alias("marker_score"))


def regex_slots(s, d):
    rows = dialogue.slots(dialogue.turns(table(s, d, "customer_turns")))
    return rows.select(*LIST, "gender", *[F.array_join(c, ",").alias(c) for c in ("materials", "colors", "sizes", "use_cases")])


def brand_mentions(s, d):
    """Brands named in the titles of the query listings."""
    rows = _products(s, d)
    titles = rows.where("doc_id % 50 = 0").select("doc_id", F.col("title").alias("text"))
    return dialogue.brand_mentions(titles, dialogue.brand_vocabulary(rows), ["doc_id"])


def category_mentions(s, d):
    return dialogue.category_mentions(dialogue.turns(table(s, d, "customer_turns")), _products(s, d), LIST)


def session_spans(s, d):
    said = dialogue.session_texts(_parsed(s, d))
    return said.select(*LIST, F.array_join("spans", " | ").alias("spans"), "category_phrase")


def wanted(s, d, rows: DataFrame) -> DataFrame:
    """Per session and turn: what has been said so far, as query columns and wanted_* constraints."""
    said = stage(dialogue.session_texts(_parsed(s, d)), "said")
    brands = dialogue.brand_mentions(said, dialogue.brand_vocabulary(rows), LIST).groupBy(*LIST).agg(F.array_sort(F.collect_set("brand_key")).alias("wanted_brands"))
    levels = dialogue.category_mentions(said, rows, LIST).groupBy(*LIST).agg(F.array_sort(F.collect_set("level")).alias("wanted_categories"))
    found = dialogue.slots(said).withColumnsRenamed({"gender": "wanted_gender", "materials": "wanted_materials", "colors": "wanted_colors"})
    none = F.array().cast("array<string>")
    joined = found.join(brands.hint("merge"), LIST, "left").join(levels.hint("merge"), LIST, "left")
    return dialogue.query_columns(joined.withColumns({c: F.coalesce(c, none) for c in ("wanted_brands", "wanted_categories")}))


def _narrow(s, d) -> DataFrame:
    """The columns of all products that constraints and priors read, as a table."""
    rows = cat.products(table(s, d, "catalog"), in_place=True)
    return stage(rows.select("doc_id", "parent_asin", "store", "brand_key", "category_path", "rating_number", "average_rating"), "narrow")


def recorded_pairs(s, d, rows: DataFrame) -> DataFrame:
    """The distinct recorded candidates and what their session wanted, without their products; rows: see _narrow."""
    recorded = evaluate.trace(table(s, d, "candidates")).select(*LIST, "intent", "candidate_asin", F.col("fused").alias("raw_fused"))
    return recorded.join(wanted(s, d, rows).hint("merge"), LIST)


def with_products(s, d, pairs: DataFrame) -> DataFrame:
    """Pairs with the whole row of their product, last of all: what is shuffled before is narrow, and texts go to it once.

    Tables that grow are never broadcast, which a planner that reads their compressed size may do at the driver's cost.
    """
    product = cat.products(table(s, d, "catalog"), in_place=True).withColumnRenamed("parent_asin", "candidate_asin").drop("search_blob", *(c for c in ("doc_id",) if c in pairs.columns))
    joined = pairs.join(product.hint("merge"), "candidate_asin")
    return joined.withColumn("search_blob", F.lower(F.concat_ws(" ", "title", "features_text", "categories_text", "description_text")))


def candidate_pairs(s, d) -> DataFrame:
    """The distinct recorded candidates with their product and what their session wanted."""
    return with_products(s, d, recorded_pairs(s, d, _narrow(s, d)))


def constraint_outcomes(s, d):
    return ranking.outcomes(candidate_pairs(s, d)).select(*LIST, "candidate_asin", *[f"{x}_outcome" for x in ranking.DIMENSIONS])


COMPUTED = [
    "phrase_title", "phrase_features", "phrase_categories", "span_coverage", "span_all", "coverage", "popularity_low_coverage", "popularity", "quality", "has_description", "n_features_norm",
    "gender_satisfied", "gender_violated", "brand_satisfied", "brand_violated", "category_satisfied", "category_violated", "material_satisfied", "color_satisfied",
    "gender_unknown", "brand_unknown", "category_unknown", "material_unknown", "color_unknown", "profile_affinity", "category_focus",
]


def featured(s, d) -> DataFrame:
    """Feature columns of every recorded candidate; fused is the recorded score over its list's largest."""
    rows = _narrow(s, d)
    pairs = stage(recorded_pairs(s, d, rows), "pairs")
    known = cat.priors(rows).join(rows.select("doc_id", F.col("parent_asin").alias("candidate_asin")).hint("merge"), "doc_id")
    # a candidate that is in no catalog does not count for its list's largest score
    pairs = pairs.join(known.hint("merge"), "candidate_asin")
    best = pairs.groupBy(*LIST).agg(F.max("raw_fused").alias("best"))
    profiles = evaluate.samples(table(s, d, "public_set")).select(F.col("sample_id").alias("session_id"), ranking.tag_words(F.col("user_profile.preference_tags")).alias("profile_words"))
    joined = pairs.join(best.hint("merge"), LIST).withColumn("fused", F.when(F.col("best") > 0, F.col("raw_fused") / F.col("best")).otherwise(0.0))
    joined = joined.join(profiles.hint("merge"), "session_id", "left").withColumn("profile_words", F.coalesce("profile_words", F.array().cast("array<string>")))
    return ranking.features(ranking.outcomes(with_products(s, d, joined)))


def feature_vector(s, d):
    return featured(s, d).select(*LIST, "candidate_asin", F.round("fused", 6).alias("fused"), *[F.round(c, 6).alias(c) for c in COMPUTED])


def linear_rank(s, d):
    scored = featured(s, d).withColumn("score", ranking.linear_score(F.col("intent"), ["fused", *COMPUTED]))
    return ranking.ranked(scored, LIST, "candidate_asin").select(*LIST, "candidate_asin", F.round("score", 6).alias("score"), "rank")


def mmr_rerank(s, d):
    titles = _products(s, d).select(F.col("parent_asin").alias("candidate_asin"), F.array_distinct(tokens("title")).alias("terms"))
    return ranking.mmr(_ranks(s, d).select(*LIST, "candidate_asin", "score", "rank").join(titles, "candidate_asin"), LIST, "candidate_asin")


def profile_words(s, d):
    rows = evaluate.samples(table(s, d, "public_set"))
    count = F.try_element_at(F.regexp_extract_all(F.coalesce("user_profile.purchase_frequency", F.lit("")), F.lit(r"(\d+)")), F.lit(-1))
    return rows.select("sample_id", F.array_join(F.array_sort(ranking.tag_words(F.col("user_profile.preference_tags"))), ",").alias("words"), F.coalesce(count.cast("int"), F.lit(0)).alias("purchase_count"))


def _ranks(s, d) -> DataFrame:
    return evaluate.replay_ranks(evaluate.trace(table(s, d, "candidates")))


def _labels(s, d) -> DataFrame:
    return evaluate.samples(table(s, d, "public_set"))


def _targets(s, d) -> DataFrame:
    """Labels whose target is the recorded candidate with the largest bm25: the test tables' own targets are in no list."""
    best = evaluate.trace(table(s, d, "candidates")).groupBy("session_id").agg(F.max_by("candidate_asin", F.struct("bm25", "candidate_asin")).alias("best"))
    rows = _labels(s, d).select("sample_id", "scenario_type", "behavior")
    return rows.join(best, rows.sample_id == best.session_id, "left").select("sample_id", "scenario_type", "behavior", F.struct(F.col("best").alias("parent_asin")).alias("ground_truth"))


def trace_replay(s, d):
    return _ranks(s, d).select(*LIST, "candidate_asin", F.round("score", 6).alias("score"), "rank")


def replay_sessions(s, d):
    return evaluate.replay_sessions(_ranks(s, d), _targets(s, d)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


def session_metrics(s, d):
    return evaluate.metrics(evaluate.replay_sessions(_ranks(s, d), _targets(s, d)))


def rank_histogram(s, d):
    target = _targets(s, d).select(F.col("sample_id").alias("session_id"), F.col("ground_truth.parent_asin").alias("candidate_asin"))
    return _ranks(s, d).join(target, ["session_id", "candidate_asin"]).groupBy("rank").agg(F.count("*").alias("n"))


def pool_recall(s, d):
    target = _labels(s, d).select(F.col("sample_id").alias("session_id"), F.col("ground_truth.parent_asin").alias("target"))
    pool = evaluate.trace(table(s, d, "candidates")).select("session_id", "candidate_asin")
    return pool.join(target, "session_id").groupBy("session_id").agg(F.max(F.col("candidate_asin") == F.coalesce("target", F.lit(""))).alias("in_pool"), F.count("*").alias("rows"))


def losing_pairs(s, d):
    return evaluate.gaps(_ranks(s, d), _targets(s, d)).select(*LIST, "winner", "feature", F.round("delta", 6).alias("delta"), F.round("contribution", 6).alias("contribution"))


def gap_summary(s, d):
    return evaluate.gap_summary(evaluate.gaps(_ranks(s, d), _targets(s, d)))


def list_commitment(s, d):
    return evaluate.commitment(_ranks(s, d), LIST)


def pool_entropy(s, d):
    brands = _products(s, d).select(F.col("parent_asin").alias("candidate_asin"), F.coalesce(F.nullif("brand_key", F.lit("")), F.lit("__missing__")).alias("part"))
    pool = evaluate.trace(table(s, d, "candidates")).select(*LIST, "candidate_asin").distinct()
    return evaluate.entropy(pool.join(brands, "candidate_asin").groupBy(*LIST, "part").agg(F.count("*").alias("n")), LIST)


def valid_recommendations(s, d):
    """Each recorded list in score order, with an unknown id and a repeat put in: its first ten valid ids."""
    rows = _ranks(s, d).groupBy(*LIST).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_asin"))), lambda x: x["candidate_asin"]).alias("a"))
    lists = rows.select(*LIST, F.concat(F.array(F.lit("unknown")), F.slice("a", 1, 1), F.col("a")).alias("items"))
    return evaluate.valid_lists(lists, table(s, d, "catalog"))


def intent_cards(s, d):
    rows = cat.ingest(table(s, d, "catalog"))
    card = evaluate.intent_cards(rows)
    return card.select("listing_id", "target_category", F.array_join("hard_constraints", " | ").alias("hard"), F.array_join("soft_preferences", " | ").alias("soft"))


def constraint_classes(s, d):
    card = evaluate.intent_cards(cat.ingest(table(s, d, "catalog")))
    value = card.select(F.explode(F.concat("hard_constraints", "soft_preferences")).alias("value"))
    return value.groupBy(evaluate.constraint_class(F.col("value")).alias("attribute")).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def opening_messages(s, d):
    category = cat.ingest(table(s, d, "catalog")).select("parent_asin", evaluate.coarse_category(F.coalesce("categories", F.array().cast("array<string>"))).alias("category"))
    rows = _labels(s, d).join(category, F.col("ground_truth.parent_asin") == F.col("parent_asin"))
    hard = F.try_element_at(F.col("intent_card.hard_constraints"), F.lit(1))
    start = F.concat(F.lit("I'm looking for "), F.col("category"))
    text = F.when((F.col("scenario_type") == "buying") & hard.isNotNull(), F.concat(start, F.lit(". A key requirement is: "), hard, F.lit(".")))
    text = text.when((F.col("scenario_type") == "intent_override") & F.col("behavior.override.old_value").isNotNull(), F.concat(start, F.lit(". "), F.col("behavior.override.old_value")))
    return rows.select("sample_id", text.otherwise(F.concat(start, F.lit(", but I'm still exploring."))).alias("message"))


def stratified_halves(s, d):
    """Half of each scenario's samples, by hash order of the id."""
    rows = _labels(s, d).select("sample_id", "scenario_type", F.md5("sample_id").alias("h"))
    w = Window.partitionBy("scenario_type")
    return rows.withColumn("n", F.row_number().over(w.orderBy("h", "sample_id"))).withColumn("m", F.count("*").over(w)).select("sample_id", "scenario_type", (2 * F.col("n") <= F.col("m")).alias("tuned"))


def stream_sessions(s, d):
    """Spans and last turn of every session, by the stream of messages run to its end."""
    path = f"{d}/customer_turns.parquet"
    messages = s.readStream.schema(s.read.parquet(path).schema).parquet(path + "*")
    rows = conversations.run_to_table(messages)
    return rows.groupBy("session_id").agg(F.max("last_turn").alias("last_turn"), F.max("n_spans").alias("n_spans"))


def pairwise_fit(s, d):
    """Violated pairs before each epoch of the pairwise learner on the recorded lists."""
    vectors = stage(learn.difference_vectors(_ranks(s, d), _targets(s, d)), "differences")
    _, history = learn.fit_pairwise(vectors, list(evaluate.TRACE.values()), 10)
    return s.createDataFrame(list(enumerate(history)), "epoch int, violated long")


def positional_pairs(s, d):
    """Samples and recorded sessions joined by their place in the order of ids, as replay files are."""
    labels = _labels(s, d).select("sample_id")
    other = _labels(s, d).select(F.reverse("sample_id").alias("reversed"))
    return learn.positional_join(labels, other, ["sample_id"], ["reversed"]).select("position", "sample_id", "reversed")


QUERIES = {f.__name__: f for f in (
    parse_turns, intent_markers, regex_slots, brand_mentions, category_mentions, session_spans, constraint_outcomes, feature_vector, linear_rank, mmr_rerank, profile_words, trace_replay,
    replay_sessions, session_metrics, rank_histogram, pool_recall, losing_pairs, gap_summary, list_commitment, pool_entropy, valid_recommendations, intent_cards, constraint_classes,
    opening_messages, stratified_halves, stream_sessions, pairwise_fit, positional_pairs,
)}

_TURNS = "turns AS (SELECT session_id, turn, trim(coalesce(user_message, '')) AS text FROM customer_turns WHERE session_id IS NOT NULL AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY loaded_at DESC NULLS LAST, user_message NULLS FIRST) = 1)"
_SCAFFOLD = "(?i)(" + "|".join(SCAFFOLD).replace("'", "''") + ")"
_OVERRIDE = " OR ".join(f"contains(lower(text), '{m}')" for m in OVERRIDE_MARKERS)


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_PARSED = _TURNS + rf""",
t1 AS (SELECT *, regexp_extract(text, '(?i)looking for\s+(.+?)(?:[.,]|$)', 0) AS found FROM turns),
t2 AS (SELECT *, CASE WHEN found <> '' THEN substring(text, (instr(text, found) + length(found))::BIGINT) ELSE text END AS body FROM t1),
t3 AS (SELECT *, regexp_extract(body, '(?i)(?:requirement is|matters is|need is|want is|preference:)\s*:?\s*(.+)$', 1) AS lead,
  regexp_replace(regexp_replace(body, '{_SCAFFOLD}', ' ', 'g'), '^[ .,:;]+|[ .,:;]+$', '', 'g') AS plain FROM t2),
t4 AS (SELECT *, CASE WHEN lead <> '' THEN string_split(lead, ';') WHEN plain <> '' THEN [plain] ELSE [] END AS pieces FROM t3),
parsed AS (SELECT session_id, turn, text, ({_OVERRIDE}) AS is_override, nullif(lower(regexp_extract(text, '(?i)don''?t have (?:an? )?(?:additional )?preference for (\w+)', 1)), '') AS refused,
  contains(lower(text), 'not quite right') AS is_nudge, {_squeeze(f"regexp_replace(regexp_extract(text, '(?i)looking for\\s+(.+?)(?:[.,]|$)', 1), '{_SCAFFOLD}', ' ', 'g')")} AS category_phrase,
  list_filter(list_transform(pieces, lambda p: {_squeeze(f"regexp_replace(regexp_replace(p, '{_SCAFFOLD}', ' ', 'g'), '^[\\s.,:;]+|[\\s.,:;]+$', '', 'g')")}), lambda p: length(p) > 1) AS spans0 FROM t4),
said AS (SELECT *, CASE WHEN refused IS NOT NULL OR is_nudge THEN [] ELSE spans0 END AS spans FROM parsed)"""


def _hits(words) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in words)


def _slot(words) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\\b({'|'.join(words)})\\b', 1))), ',')"


_NAMED = f"list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: {sql.lookup('w', SPOKEN_AUDIENCE)}), lambda g: g IS NOT NULL)"
_GENDER = (
    "coalesce(list_filter(upto, lambda g: g IN ('boys', 'girls'))[1], upto[1])"
)
_UPTO = "CASE WHEN len(list_filter(named, lambda g: g NOT IN ('kids', 'boys', 'girls'))) > 0 THEN named[1:list_position(named, list_filter(named, lambda g: g NOT IN ('kids', 'boys', 'girls'))[1])] ELSE named END"

_VOCAB = f"""vocab AS (SELECT array_to_string(w, ' ') AS surface, arg_min(brand_key, doc_id) AS brand_key FROM
  (SELECT doc_id, brand_key, regexp_extract_all(lower(trim(store)), '[a-z0-9]+') AS w FROM product WHERE trim(store) <> '' AND brand_key <> '')
  WHERE len(w) > 1 OR (len(w) = 1 AND length(w[1]) >= 4 AND w[1] NOT IN ({sql.listed(NOT_BRANDS)})) GROUP BY 1)"""
_STEMS = lambda x: f"list_transform({sql.surface(x)}, lambda t: {sql.stem('t')})"

_LABELS = "samples AS (SELECT * FROM public_set WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY loaded_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1)"
_TRACE = "trace AS (SELECT DISTINCT * FROM candidates WHERE session_id IS NOT NULL AND turn IS NOT NULL AND candidate_asin IS NOT NULL)"


def _weight(i: int, name: str, w: float) -> str:
    own = "".join(f" WHEN intent = '{k}' THEN {t[name]}::DOUBLE" for k, t in INTENT_WEIGHTS.items() if name in t)
    value = f"CASE{own} ELSE {w}::DOUBLE END" if own else f"{w}::DOUBLE"
    return value


_SUM = " + ".join(f"({_weight(i, n, w)}) * coalesce(features[{i + 1}], 0)" for i, (n, w) in enumerate(evaluate.TRACE.items()))
_RANKS = _TRACE + f""",
scores AS (SELECT session_id, turn, intent, candidate_asin, features, round({_SUM}, 9) AS score FROM trace),
ranks AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, candidate_asin)::INTEGER AS rank FROM scores)"""
_TARGETS = _RANKS + f""",
{_LABELS},
best AS (SELECT session_id, candidate_asin AS target FROM trace QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY bm25 DESC, candidate_asin DESC) = 1),
labels AS (SELECT sample_id, scenario_type, target, coalesce(behavior.override.turn, 0) AS from_turn FROM samples LEFT JOIN best ON session_id = sample_id)"""
_SESSIONS = _TARGETS + """,
hits AS (SELECT sample_id, r.turn, rank FROM ranks r JOIN labels ON r.session_id = sample_id AND candidate_asin = target AND rank <= 10 AND r.turn >= from_turn),
sessions AS (SELECT sample_id, scenario_type, h.rank IS NOT NULL AS hit, h.turn AS first_hit_turn, h.rank AS best_rank, coalesce(1.0 / h.rank, 0.0)::DOUBLE AS reciprocal_rank FROM labels
  LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY turn) = 1) h USING (sample_id))"""
_GAPS = _SESSIONS + f""",
names AS (SELECT unnest(range(1, {len(evaluate.TRACE) + 1})) AS i, unnest([{sql.listed(evaluate.TRACE)}]) AS feature, unnest([{', '.join(f'{w}::DOUBLE' for w in evaluate.TRACE.values())}]) AS w),
own AS (SELECT r.session_id, r.turn, rank AS target_rank, features AS tf FROM ranks r JOIN sessions s ON r.session_id = s.sample_id AND r.turn = s.first_hit_turn JOIN labels l ON l.sample_id = s.sample_id AND candidate_asin = l.target WHERE s.best_rank BETWEEN 2 AND 10),
gaps AS (SELECT r.session_id, r.turn, candidate_asin AS winner, feature, features[i] - tf[i] AS delta, (features[i] - tf[i]) *
  CASE {' '.join(f"WHEN intent = '{k}' AND feature = '{f}' THEN {v}::DOUBLE" for k, t in INTENT_WEIGHTS.items() for f, v in t.items())} ELSE w END AS contribution
  FROM ranks r JOIN own o ON r.session_id = o.session_id AND r.turn = o.turn AND r.rank <= 3 AND r.rank < o.target_rank, names)"""


def _clean(x: str) -> str:
    return f"rtrim(left(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^[ \\-;,.]+|[ \\-;,.]+$', '', 'g'), 180))"


def _found(words) -> str:
    return f"nullif(regexp_extract(corpus, '\\b({'|'.join(words)})\\b', 1), '')"


_CARDS = sql.LISTING + f""",
c0 AS (SELECT listing_id, title, list_filter(list_concat(coalesce(features, []), det), lambda x: x IS NOT NULL AND x <> '') AS given,
  lower(concat_ws(' ', title, array_to_string(features, ' '), array_to_string(description, ' '), array_to_string(categories, ' '), store, array_to_string(det, ' '))) AS corpus
  FROM (SELECT *, coalesce(list_transform(list_sort(map_keys(details)), lambda k: CASE WHEN details[k] <> '' THEN k || ': ' || details[k] END), []) AS det FROM listing)),
c1 AS (SELECT *, {_found(CARD_MATERIALS)} AS material, 'color: ' || {_found(CARD_COLORS)} AS color FROM c0),
c2 AS (SELECT *, list_distinct_ordered FROM (SELECT *, list_filter(list_transform(CASE WHEN material IS NULL AND color IS NOT NULL THEN list_concat(given[1:1], [color], given[2:]) ELSE list_concat(list_filter([material, color], lambda x: x IS NOT NULL), given) END,
  lambda x: {_clean('x')}), lambda x: x <> '') AS all_values FROM c1), LATERAL (SELECT list_filter(all_values, lambda x, i: list_position(all_values, x) = i) AS list_distinct_ordered)),
c3 AS (SELECT listing_id, {_clean("coalesce(nullif(title, ''), 'product')")} AS target_category, CASE WHEN len(list_distinct_ordered) > 0 THEN list_distinct_ordered ELSE [{_clean("coalesce(nullif(title, ''), 'product')")}] END AS c FROM c2),
cards AS (SELECT listing_id, target_category, c[1:2] AS hard, CASE WHEN len(c[3:4]) > 0 THEN c[3:4] ELSE c[1:1] END AS soft FROM c3)"""
_CLASS = "CASE WHEN contains(lower(v), 'budget') OR regexp_matches(lower(v), '(?:\\$|<=|under)\\s*\\d') THEN 'budget' " + " ".join(f"WHEN regexp_matches(lower(v), '{'|'.join(w)}') THEN '{n}'" for n, w in CONSTRAINT_WORDS) + " ELSE 'feature' END"
_COARSE = f"list_filter(list_transform(flatten(list_transform(list_filter(coalesce(categories, []), lambda x: x IS NOT NULL), lambda x: string_split(x, ','))), lambda p: trim(p)), lambda p: p <> '' AND lower(p) NOT IN ({sql.listed(CARD_NOISE)}))"
_TAGS = "CASE lower(trim(t)) " + " ".join(f"WHEN '{k}' THEN [{sql.listed(v)}]" for k, v in TAG_WORDS.items()) + " ELSE [lower(trim(t))] END"

_LIVE = lambda x: f"list_filter(list_transform({sql.surface(x)}, lambda t: {sql.stem('t')}), lambda t: t NOT IN ({sql.listed(BOILERPLATE)}))"
_PAIRS = lambda x: f"list_transform(range(1, len({x})), lambda i: {x}[i] || chr(1) || {x}[i + 1])"
_OVERLAP = lambda q, d: f"CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {d})) / len({q}) ELSE 0.0 END"

_WANTED = _PARSED + f""", {_VOCAB},
u AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn, i) AS k, x FROM
  (SELECT session_id, turn, unnest(range(1, len(spans) + 1)) AS i, unnest(spans) AS x FROM said)),
v AS (SELECT session_id, turn, k, CASE WHEN regexp_matches(y, '^color: ?.+') THEN trim(regexp_replace(y, '^color:', '')) ELSE y END AS y FROM (SELECT *, lower({_squeeze('x')}) AS y FROM u)),
w AS (SELECT session_id, y, min(k) AS k, min(turn) AS turn FROM v WHERE length(y) > 3 GROUP BY ALL),
c AS (SELECT session_id, turn, category_phrase FROM said WHERE category_phrase <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1),
q0 AS (SELECT s.session_id, s.turn, coalesce((SELECT list(y ORDER BY k) FROM w WHERE w.session_id = s.session_id AND w.turn <= s.turn), []) AS spans,
  (SELECT category_phrase FROM c WHERE c.session_id = s.session_id AND c.turn <= s.turn) AS phrase,
  (SELECT string_agg(x, ' . ' ORDER BY k) FROM u WHERE u.session_id = s.session_id AND u.turn <= s.turn) AS words FROM said s),
q1 AS (SELECT session_id, turn, spans, coalesce(phrase, '') AS phrase, concat_ws(' . ', words, phrase) AS text FROM q0),
q2 AS (SELECT *, {_NAMED} AS named FROM q1), q3 AS (SELECT *, {_UPTO} AS upto FROM q2),
sg AS (SELECT DISTINCT session_id, turn, array_to_string(g[i:i + n - 1], ' ') AS surface FROM (SELECT session_id, turn, g, n, unnest(range(1, len(g) - n + 2)) AS i FROM
  (SELECT session_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS g FROM q1), (SELECT unnest([1, 2, 3, 4]) AS n))),
brands AS (SELECT session_id, turn, list(DISTINCT brand_key) AS brands FROM sg JOIN vocab USING (surface) GROUP BY ALL),
levels AS (SELECT level, list_distinct({_STEMS('level')}) AS terms FROM (SELECT DISTINCT lower(unnest(category_path)) AS level FROM product) WHERE length(level) > 3),
cats AS (SELECT session_id, turn, list(level) AS cats FROM (SELECT session_id, turn, {_STEMS('text')} AS st FROM q1), levels WHERE len(terms) > 0 AND list_has_all(st, terms) GROUP BY ALL),
wanted AS (SELECT q3.*, {_GENDER} AS wg, coalesce(brands, []) AS wb, coalesce(cats, []) AS wc, list_distinct(regexp_extract_all(lower(text), '\\b({'|'.join(MATERIALS)})\\b', 1)) AS wm,
  list_distinct(regexp_extract_all(lower(text), '\\b({'|'.join(COLORS)})\\b', 1)) AS wk, list_distinct(list_concat(flatten(list_transform(spans, lambda x: {_LIVE('x')})), {_LIVE('phrase')})) AS qt,
  list_distinct({_LIVE('phrase')}) AS ct, list_transform(list_append(spans, phrase), lambda x: {_LIVE('x')}) AS parts FROM q3 LEFT JOIN brands USING (session_id, turn) LEFT JOIN cats USING (session_id, turn)),
{_TRACE},
pairs AS (SELECT t.session_id, t.turn, t.intent, t.candidate_asin, t.fused AS raw, p.*, w.* EXCLUDE (session_id, turn, text), lower(p.title || ' ' || features_text || ' ' || description_text) AS body, coalesce(gender, gender_fallback) AS g
  FROM (SELECT DISTINCT session_id, turn, intent, candidate_asin, fused FROM trace) t JOIN product p ON p.parent_asin = t.candidate_asin JOIN wanted w ON w.session_id = t.session_id AND w.turn = t.turn),
outcomes AS (SELECT *, CASE WHEN wg IS NULL OR g IS NULL THEN 'unknown' WHEN g = wg THEN 'satisfied' WHEN g = 'unisex' AND wg IN ('women', 'men') THEN 'satisfied' WHEN wg = 'unisex' AND g IN ('women', 'men') THEN 'unknown'
    WHEN wg = 'kids' AND g IN ('boys', 'girls') THEN 'satisfied' WHEN g = 'kids' AND wg IN ('boys', 'girls') THEN 'unknown' WHEN wg = 'kids' AND g = 'unisex' THEN 'unknown' ELSE 'violated' END AS gender_outcome,
  CASE WHEN len(wb) = 0 OR brand_key = '' THEN 'unknown' WHEN list_contains(wb, brand_key) THEN 'satisfied' ELSE 'violated' END AS brand_outcome,
  CASE WHEN len(wc) = 0 OR len(category_path) = 0 THEN 'unknown' WHEN list_has_any(list_transform(category_path, lambda x: lower(x)), wc) THEN 'satisfied' ELSE 'violated' END AS category_outcome,
  CASE WHEN len(list_filter(wm, lambda x: CASE WHEN x IN ('leather', 'suede') THEN (len(regexp_extract_all(body, '\\b' || x || '\\b')) > len(regexp_extract_all(body, '\\b({'|'.join(FAKE_QUALIFIERS)})[\\s-]+' || x || '\\b')))
    OR (x = 'leather' AND regexp_matches(body, '{'|'.join(GENUINE['leather'])}')) ELSE contains(body, x) END)) > 0 THEN 'satisfied' ELSE 'unknown' END AS material_outcome,
  CASE WHEN len(list_filter(wk, lambda x: contains(body, x))) > 0 THEN 'satisfied' ELSE 'unknown' END AS color_outcome FROM pairs)"""


def _flag(dimension: str, outcome: str) -> str:
    return f"({dimension}_outcome = '{outcome}')::INTEGER::DOUBLE AS {dimension}_{outcome}"


_FEATURED = _WANTED + f""",
{_LABELS},
tagged AS (SELECT sample_id, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE [NULL] END) AS t FROM (SELECT sample_id, list_filter(user_profile.preference_tags, lambda x: x IS NOT NULL AND trim(x) <> '') AS tags FROM samples)),
profile AS (SELECT sample_id, coalesce(list_distinct(flatten(list({_TAGS}) FILTER (t IS NOT NULL))), []) AS pw FROM tagged GROUP BY sample_id),
st AS (SELECT min(ln(1 + rating_number)) AS lo, max(ln(1 + rating_number)) AS hi, coalesce(avg(average_rating) FILTER (rating_number > 0), 4.0) AS m FROM product),
f0 AS (SELECT o.*, coalesce(pw, []) AS pw, max(raw) OVER (PARTITION BY session_id, turn) AS best, {_STEMS('title')} AS tt, {_STEMS('features_text')} AS tf, {_STEMS('categories_text')} AS tc,
  list_distinct(flatten(list_transform(parts, lambda z: {_PAIRS('z')}))) AS qb, (ln(1 + rating_number) - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS popularity,
  least(1.0, greatest(0.0, ((average_rating * rating_number + m * 50) / (rating_number + 50) - 1) / 4)) AS quality, len(list_filter(spans, lambda x: contains(search_blob, x))) AS hit,
  lower(title || ' ' || features_text) AS hay FROM outcomes o LEFT JOIN profile ON sample_id = session_id, st),
f1 AS (SELECT *, {_OVERLAP('qt', 'list_concat(list_concat(tt, tf), tc)')} AS coverage FROM f0),
featured AS (SELECT session_id, turn, intent, candidate_asin, CASE WHEN best > 0 THEN raw / best ELSE 0.0 END AS fused, {_OVERLAP('qb', _PAIRS('tt'))} AS phrase_title, {_OVERLAP('qb', _PAIRS('tf'))} AS phrase_features,
  {_OVERLAP('qb', _PAIRS('tc'))} AS phrase_categories, CASE WHEN len(spans) > 0 THEN hit / len(spans) ELSE 0.0 END AS span_coverage, (len(spans) > 0 AND hit = len(spans))::INTEGER::DOUBLE AS span_all, coverage,
  popularity * (1 - coverage) AS popularity_low_coverage, popularity, quality, has_description::INTEGER::DOUBLE AS has_description, least(1.0, n_features / 12) AS n_features_norm,
  {', '.join(_flag(x, o) for x in ranking.DIMENSIONS for o in ('satisfied', 'violated', 'unknown') if f'{x}_{o}' in COMPUTED)},
  CASE WHEN len(pw) > 0 THEN least(1.0, len(list_filter(pw, lambda x: contains(hay, x))) / greatest(3.0, len(pw) * 0.5)) ELSE 0.0 END AS profile_affinity, {_OVERLAP('ct', 'list_concat(tt, tc)')} AS category_focus FROM f1)"""
_LINEAR = " + ".join(f"({_weight(0, n, WEIGHTS[n])}) * {n}" for n in ("fused", *COMPUTED))

ORACLE = {
    "parse_turns": f"WITH {_PARSED} SELECT session_id, turn, is_override, refused, is_nudge, category_phrase, array_to_string(spans, ' | ') AS spans FROM said",
    "intent_markers": f"WITH {_TURNS} SELECT session_id, turn, least(1.0, greatest(0.0, 0.5 + 0.25 * (({_hits(BUYING_MARKERS)}) - ({_hits(BROWSING_MARKERS)}))))::DOUBLE AS marker_score FROM turns",
    "regex_slots": f"WITH {_TURNS}, a AS (SELECT *, {_NAMED} AS named FROM turns), b AS (SELECT *, {_UPTO} AS upto FROM a) SELECT session_id, turn, {_GENDER} AS gender, {_slot(MATERIALS)} AS materials, {_slot(COLORS)} AS colors, {_slot(SIZES)} AS sizes, {_slot(USE_CASES)} AS use_cases FROM b",
    "brand_mentions": f"""WITH {sql.PRODUCT}, {_VOCAB}, w AS (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM product WHERE doc_id % 50 = 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS surface FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)))
SELECT DISTINCT doc_id, brand_key FROM g JOIN vocab USING (surface)""",
    "category_mentions": f"""WITH {sql.PRODUCT}, {_TURNS}, levels AS (SELECT level, list_distinct({_STEMS('level')}) AS terms FROM (SELECT DISTINCT lower(unnest(category_path)) AS level FROM product) WHERE length(level) > 3),
said AS (SELECT session_id, turn, {_STEMS('text')} AS terms FROM turns) SELECT session_id, turn, level FROM said, levels WHERE len(levels.terms) > 0 AND list_has_all(said.terms, levels.terms)""",
    "profile_words": f"""WITH {_LABELS}, e AS (SELECT sample_id, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE [NULL] END) AS t FROM (SELECT sample_id, list_filter(user_profile.preference_tags, lambda x: x IS NOT NULL AND trim(x) <> '') AS tags FROM samples)),
w AS (SELECT sample_id, list_distinct(flatten(list({_TAGS}) FILTER (t IS NOT NULL))) AS words FROM e GROUP BY sample_id)
SELECT sample_id, coalesce(array_to_string(list_sort(words), ','), '') AS words, coalesce(regexp_extract_all(coalesce(user_profile.purchase_frequency, ''), '(\\d+)')[-1]::INTEGER, 0) AS purchase_count FROM samples LEFT JOIN w USING (sample_id)""",
    "trace_replay": f"WITH {_RANKS} SELECT session_id, turn, candidate_asin, round(score, 6) AS score, rank FROM ranks",
    "replay_sessions": f"WITH {_SESSIONS} SELECT sample_id, scenario_type, hit, first_hit_turn, best_rank, round(reciprocal_rank, 6) AS reciprocal_rank FROM sessions",
    "session_metrics": f"""WITH {_SESSIONS}, m AS (SELECT CASE WHEN grouping(scenario_type) = 1 THEN 'all' ELSE scenario_type END AS scenario_type, count(*) AS sample_count, round(avg(hit::INTEGER), 6) AS hit_rate,
round(avg(reciprocal_rank), 6) AS mrr, round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc FROM sessions GROUP BY GROUPING SETS ((scenario_type), ()))
SELECT *, round(0.5 * hit_rate + 0.3 * mrr + 0.2 * least(1.0, greatest(0.0, (11 - mttc) / 10)), 6) AS score FROM m""",
    "rank_histogram": f"WITH {_TARGETS} SELECT rank, count(*) AS n FROM ranks r JOIN labels ON r.session_id = sample_id AND candidate_asin = target GROUP BY rank",
    "pool_recall": f"WITH {_TRACE}, {_LABELS} SELECT t.session_id, bool_or(candidate_asin = coalesce(ground_truth.parent_asin, '')) AS in_pool, count(*) AS rows FROM trace t JOIN samples ON t.session_id = sample_id GROUP BY t.session_id",
    "losing_pairs": f"WITH {_GAPS} SELECT session_id, turn, winner, feature, round(delta, 6) AS delta, round(contribution, 6) AS contribution FROM gaps",
    "gap_summary": f"""WITH {_GAPS}, tot AS (SELECT sum(contribution) AS total FROM gaps) SELECT feature, round(avg(contribution), 6) AS mean_gap, round(CASE WHEN total <> 0 THEN sum(contribution) / total ELSE 0 END, 6) AS share,
round(avg((contribution > 1e-12)::INTEGER), 6) AS against_rate, round(max(contribution), 6) AS max_single FROM gaps, tot GROUP BY feature, total""",
    "list_commitment": f"WITH {_RANKS} SELECT session_id, turn, round(CASE WHEN count(*) < 2 THEN 1.0 WHEN max(score) <= 0 THEN 0.0 ELSE least(1.0, stddev_pop(score) / abs(max(score))) END, 6) AS nqc FROM ranks WHERE rank <= 10 GROUP BY ALL",
    "pool_entropy": f"""WITH {sql.PRODUCT}, {_TRACE}, p AS (SELECT session_id, turn, coalesce(nullif(brand_key, ''), '__missing__') AS part, count(*) AS n FROM (SELECT DISTINCT session_id, turn, candidate_asin FROM trace) JOIN product ON parent_asin = candidate_asin GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id, turn) AS pr FROM p) SELECT session_id, turn, round(-sum(pr * log2(pr)), 6) AS entropy FROM q GROUP BY ALL""",
    "valid_recommendations": f"""WITH {_RANKS}, known AS (SELECT DISTINCT trim(parent_asin) AS parent_asin FROM catalog WHERE trim(parent_asin) <> ''), r AS (SELECT session_id, turn, candidate_asin AS parent_asin, rank FROM ranks WHERE candidate_asin IN (SELECT parent_asin FROM known))
SELECT session_id, turn, parent_asin, row_number() OVER (PARTITION BY session_id, turn ORDER BY rank)::INTEGER AS place FROM r QUALIFY place <= 10""",
    "intent_cards": f"WITH {_CARDS} SELECT listing_id, target_category, array_to_string(hard, ' | ') AS hard, array_to_string(soft, ' | ') AS soft FROM cards",
    "constraint_classes": f"WITH {_CARDS}, v AS (SELECT unnest(list_concat(hard, soft)) AS v FROM cards) SELECT {_CLASS} AS attribute, count(*) AS n, sum(length(v))::BIGINT AS chars FROM v GROUP BY 1",
    "opening_messages": f"""WITH {sql.LISTING}, {_LABELS}, cc AS (SELECT parent_asin, CASE WHEN len(k) > 0 THEN array_to_string(k[greatest(len(k) - 1, 1):], ' ') ELSE 'clothing item' END AS category FROM (SELECT parent_asin, {_COARSE} AS k FROM listing))
SELECT sample_id, CASE WHEN scenario_type = 'buying' AND intent_card.hard_constraints[1] IS NOT NULL THEN 'I''m looking for ' || category || '. A key requirement is: ' || intent_card.hard_constraints[1] || '.'
WHEN scenario_type = 'intent_override' AND behavior.override.old_value IS NOT NULL THEN 'I''m looking for ' || category || '. ' || behavior.override.old_value ELSE 'I''m looking for ' || category || ', but I''m still exploring.' END AS message
FROM samples JOIN cc ON ground_truth.parent_asin = parent_asin""",
    "constraint_outcomes": f"WITH {sql.PRODUCT}, {_WANTED} SELECT session_id, turn, candidate_asin, gender_outcome, brand_outcome, category_outcome, material_outcome, color_outcome FROM outcomes",
    "feature_vector": f"WITH {sql.PRODUCT}, {_FEATURED} SELECT session_id, turn, candidate_asin, round(fused, 6) AS fused, {', '.join(f'round({c}, 6) AS {c}' for c in COMPUTED)} FROM featured",
    "linear_rank": f"""WITH {sql.PRODUCT}, {_FEATURED}, l AS (SELECT session_id, turn, candidate_asin, round({_LINEAR}, 9) AS s FROM featured)
SELECT session_id, turn, candidate_asin, round(s, 6) AS score, row_number() OVER (PARTITION BY session_id, turn ORDER BY s DESC, candidate_asin)::INTEGER AS rank FROM l""",
    "session_spans": f"""WITH {_PARSED}, u AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn, i) AS k, x FROM
  (SELECT session_id, turn, unnest(range(1, len(spans) + 1)) AS i, lower({_squeeze('unnest(spans)')}) AS x FROM said)),
v AS (SELECT session_id, turn, k, CASE WHEN regexp_matches(x, '^color: ?.+') THEN trim(regexp_replace(x, '^color:', '')) ELSE x END AS x FROM u),
w AS (SELECT session_id, x, min(k) AS k, min(turn) AS turn FROM v WHERE length(x) > 3 GROUP BY ALL),
c AS (SELECT session_id, turn, category_phrase FROM said WHERE category_phrase <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1)
SELECT s.session_id, s.turn, coalesce((SELECT string_agg(x, ' | ' ORDER BY k) FROM w WHERE w.session_id = s.session_id AND w.turn <= s.turn), '') AS spans,
coalesce((SELECT category_phrase FROM c WHERE c.session_id = s.session_id AND c.turn <= s.turn), '') AS category_phrase FROM said s""",
    "stream_sessions": f"WITH {_PARSED}, x AS (SELECT session_id, turn, unnest(CASE WHEN len(spans) > 0 THEN spans ELSE [NULL] END) AS x FROM said) SELECT session_id, max(turn) AS last_turn, count(DISTINCT lower(x))::INTEGER AS n_spans FROM x GROUP BY session_id",
    "positional_pairs": f"WITH {_LABELS} SELECT position, sample_id, reversed FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS position FROM samples) JOIN (SELECT reverse(sample_id) AS reversed, row_number() OVER (ORDER BY reverse(sample_id)) - 1 AS position FROM samples) USING (position)",
    "stratified_halves": f"WITH {_LABELS} SELECT sample_id, scenario_type, 2 * row_number() OVER (PARTITION BY scenario_type ORDER BY md5(sample_id), sample_id) <= count(*) OVER (PARTITION BY scenario_type) AS tuned FROM samples",
}
