"""Queries of session state, of answers to whole batches of sessions, and of what recorded lists tell about them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import BLENDS, BOILERPLATE, BROWSING_MARKERS, BUYING_MARKERS, COLORS, DECAY, FIELDS, IDENTITY_SLOTS, INTENT_BOUNDS, INTENT_PARTS, MATERIALS, RECENCY, REPLACED_CUE, SIZES, SOFT_SLOTS, USE_CASES
from ..functions.text import tokens
from ..operators import catalog as cat
from ..operators import dialogue, evaluate, fusion, learn, lexical, ngrams, ranking, state, stemming
from ..session import stage
from ..sources import table
from . import ranking as base
from . import sql
from .retrieval import _canonical

LIST = state.SESSION
ATTRIBUTES = ["brand", "budget", "category", "color", "feature", "material", "other", "size", "style", "use_case"]


class Sessions:
    """The state of all sessions of the test tables, its parts kept as tables."""

    def __init__(self, s, d):
        self.products = stage(cat.products(table(s, d, "catalog")), "products")
        self.parsed = stage(base._parsed(s, d), "parsed")
        brands = dialogue.brand_vocabulary(self.products)
        stated = state.statements(self.parsed)
        own = self.parsed.select(F.col("category_phrase").alias("text"))
        values = state.slot_values(stated.select("text").unionByName(own), self.products, brands)
        self.events = stage(state.touched_slots(stated, values), "events")
        self.named = stage(state.phrases(self.parsed, self.events), "phrases")
        # the phrase of a changed kind joins several statements, so its values are its own
        more = state.slot_values(self.named.select(F.col("phrase").alias("text")).join(stated.select("text").unionByName(own).distinct(), "text", "left_anti"), self.products, brands)
        self.values, self.stated = stage(values.unionByName(more), "values"), stated
        self.spans = stage(state.span_states(stated, self.events, self.values, self.parsed), "spans")
        self.slots = stage(state.slot_states(stated, self.events, self.values, self.named), "slots")


def span_weights(s, d):
    return Sessions(s, d).spans


def session_slots(s, d):
    return Sessions(s, d).slots


def weighted_query_terms(s, d):
    x = Sessions(s, d)
    return state.weighted_terms(x.spans, x.named, stage(_canonical(x.products), "stems")).withColumn("weight", F.round("weight", 6))


def _profiles(s, d) -> DataFrame:
    rows = evaluate.samples(table(s, d, "public_set"))
    count = F.try_element_at(F.regexp_extract_all(F.coalesce("user_profile.purchase_frequency", F.lit("")), F.lit(r"(\d+)")), F.lit(-1))
    tags = F.size(F.filter(F.coalesce("user_profile.preference_tags", F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != "")))
    return rows.select(F.col("sample_id").alias("session_id"), F.coalesce(count.cast("int"), F.lit(0)).alias("purchase_count"), tags.alias("tags"))


def _routed(s, d, x: Sessions) -> DataFrame:
    return state.routed(x.spans, x.slots, x.parsed, _profiles(s, d))


def intent_route(s, d):
    return _routed(s, d, Sessions(s, d)).withColumn("confidence", F.round("confidence", 6))


def answered(s, d, top: int = 10, depth: int = 200) -> DataFrame:
    """(session_id, turn, intent, candidate_asin, score, rank): the ranked list of every turn of every session.

    State, query, fields, fuzzy route, fusion, injection, constraint outcomes, features, model of the intent and, for
    browsing sessions, diversity: one batch of joins for all turns.  Rules that ask or hold back are left out, so every
    turn is answered.
    """
    x = Sessions(s, d)
    key = F.concat_ws("\u0000", "session_id", "turn").alias("query_id")
    canonical = stage(_canonical(x.products), "stems")
    index = stage(lexical.postings(x.products, canonical), "postings")
    shares, stats = stage(lexical.weighed(index, x.products), "shares"), stage(lexical.term_stats(index, x.products), "terms")
    wanted = state.weighted_terms(x.spans, x.named, canonical).select(key, "field", "term", "weight")
    fields = stage(lexical.bm25_scores(shares, stats, wanted, 220), "fields")
    live = stage(state.live_columns(x.spans, x.named, x.slots).select("*", key), "live")
    titles = x.products.select("doc_id", F.col("title").alias("text"))
    dense = stage(ngrams.cosine_scores(stage(ngrams.gram_postings(titles), "grams"), titles, live.select("query_id", "text"), 150), "dense")
    pool = lexical.top(fusion.convex_combine(lexical.field_mixture(fields), dense), ["query_id"], depth)
    pool = stage(pool.select("query_id", "doc_id", "score"), "pool")
    spans = live.select("query_id", "spans")
    found = stage(fusion.inject(pool, fusion.span_survivors(x.products, spans), spans).select("query_id", "doc_id"), "found")

    def scaled(scores: DataFrame, name: str) -> DataFrame:
        inside = scores.select("query_id", "doc_id", "score").join(found, ["query_id", "doc_id"])
        return fusion.over_maximum(inside, ["query_id"]).withColumnRenamed("score", name)

    parts = [scaled(pool, "fused"), scaled(dense, "dense"), *[scaled(fields.where(F.col("field") == f), f"bm25_{f}") for f in FIELDS]]
    pairs = functools.reduce(lambda a, b: a.join(b, ["query_id", "doc_id"], "left"), parts, found)
    pairs = pairs.na.fill(0.0, ["fused", "dense", *(f"bm25_{f}" for f in FIELDS)])
    profiles = evaluate.samples(table(s, d, "public_set")).select(F.col("sample_id").alias("session_id"), ranking.tag_words(F.col("user_profile.preference_tags")).alias("profile_words"))
    asked = dialogue.query_columns(live).join(profiles, "session_id", "left").join(_routed(s, d, x).select(*LIST, "intent"), LIST).withColumn("profile_words", F.coalesce("profile_words", F.array().cast("array<string>")))
    rows = pairs.join(asked.drop("text"), "query_id").join(x.products.join(cat.priors(x.products), "doc_id"), "doc_id")
    scored = ranking.features(ranking.outcomes(rows)).withColumn("score", ranking.linear_score(F.col("intent")))
    columns = [*LIST, "intent", F.col("parent_asin").alias("candidate_asin"), "score"]
    ranked = ranking.ranked(scored.select(*columns, F.array_distinct(tokens("title")).alias("terms")), LIST, "candidate_asin")
    ranked = stage(ranked.where(F.col("rank") <= 3 * top), "ranked")
    mixed = ranking.mmr(ranked.where("intent = 'browsing'"), LIST, "candidate_asin", top).join(ranked.select(*LIST, "candidate_asin", "intent", "score"), [*LIST, "candidate_asin"])
    plain = ["session_id", "turn", "intent", "candidate_asin", "score", "rank"]
    return ranked.where("intent <> 'browsing'").select(*plain).unionByName(mixed.select(*plain)).where(F.col("rank") <= top)


def respond_lists(s, d):
    return answered(s, d).select(*LIST, "intent", "candidate_asin", F.round("score", 6).alias("score"), "rank")


def respond_metrics(s, d):
    """Hit rate, reciprocal rank and turns of the answered lists against the samples' own targets."""
    return evaluate.metrics(evaluate.replay_sessions(answered(s, d), base._labels(s, d)))


def last_lists(s, d):
    """The list each turn falls back on: the recorded one of the turn or the last before it, as its best item by bm25."""
    best = evaluate.trace(table(s, d, "candidates")).groupBy(*LIST).agg(F.max_by("candidate_asin", F.struct("bm25", "candidate_asin")).alias("best"))
    lists = best.select(*LIST, F.array("best").alias("items"))
    return state.remembered(lists, dialogue.turns(table(s, d, "customer_turns"))).select(*LIST, F.get("items", F.lit(0)).alias("candidate_asin"))


def uncommon_brands(s, d):
    """The brand names that stay if one-word names in more than 1 % of the listings' texts are taken for words."""
    rows = stage(cat.products(table(s, d, "catalog")), "products")
    common = lexical.commonness(lexical.term_stats(lexical.postings(rows, _canonical(rows)), rows))
    return dialogue.common_names(dialogue.brand_vocabulary(rows), common, 0.01)


def partition_entropy(s, d):
    """How evenly each attribute splits each recorded pool: kind, brand and audience; a missing value is a part of its own."""
    keys = {"category": F.try_element_at("category_path", F.lit(-1)), "brand": F.nullif("brand_key", F.lit("")), "size": F.coalesce("gender", "gender_fallback")}
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.coalesce(F.nullif(c, F.lit("")), F.lit("__missing__")).alias("part")) for n, c in keys.items()]))
    rows = cat.products(table(s, d, "catalog")).select(F.col("parent_asin").alias("candidate_asin"), parts.alias("x")).select("candidate_asin", "x.attribute", "x.part")
    pool = evaluate.trace(table(s, d, "candidates")).select(*LIST, "candidate_asin").distinct()
    return evaluate.entropy(pool.join(rows, "candidate_asin").groupBy(*LIST, "attribute", "part").agg(F.count("*").alias("n")), [*LIST, "attribute"])


def gap_slices(s, d):
    rows = evaluate.gaps(base._ranks(s, d), base._targets(s, d))
    of = base._labels(s, d)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.coalesce(c, F.lit("none")).alias("value")) for c in ("scenario_type", "difficulty_bucket")]))
    return evaluate.gap_slices(rows, of.select(F.col("sample_id").alias("session_id"), each.alias("x")).select("session_id", "x.slice", "x.value"))


def replay_agreement(s, d):
    """The replay of the recorded lists against one that knows the fused score only."""
    recorded = evaluate.trace(table(s, d, "candidates"))
    plain = evaluate.replay_ranks(recorded, lambda v, intent: F.round(F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)), 9))
    return evaluate.agreement(evaluate.replay_sessions(evaluate.replay_ranks(recorded), base._targets(s, d)), evaluate.replay_sessions(plain, base._targets(s, d)))


def inflection_splits(s, d):
    counts = cat.surface_counts(cat.products(table(s, d, "catalog")))
    return stemming.inflection_splits(counts, stemming.canonical_stems(counts))


def _cards(s, d) -> DataFrame:
    rows = cat.ingest(table(s, d, "catalog"))
    return evaluate.intent_cards(rows).join(rows.select("listing_id", "parent_asin"), "listing_id")


def attribute_yield(s, d):
    cards = _cards(s, d).select("parent_asin", F.concat("hard_constraints", "soft_preferences").alias("values"))
    own = base._labels(s, d).select("sample_id", "scenario_type", F.col("ground_truth.parent_asin").alias("parent_asin"))
    return evaluate.attribute_yield(own.join(cards, "parent_asin").select("sample_id", "scenario_type", "values"), ATTRIBUTES)


def hidden_fields(s, d):
    rows = evaluate.given_or_derived(base._labels(s, d), _cards(s, d).select("parent_asin", "hard_constraints", "soft_preferences"))
    return rows.select("sample_id", F.array_join("hard", " | ").alias("hard"), F.array_join("soft", " | ").alias("soft"), "old_value", "new_value", "message")


def override_turns(s, d):
    rows = base._labels(s, d).where("scenario_type = 'intent_override'")
    return rows.select("sample_id", evaluate.override_turn(F.concat_ws("\u0000", "sample_id", "scenario_type")).alias("turn"))


def _verdicts(s, d) -> DataFrame:
    """Verdicts of the pairs (target, item just above it) of the lists that decide each session."""
    ranks, targets, x = base._ranks(s, d), base._targets(s, d), Sessions(s, d)
    own = evaluate.deciding_lists(ranks, targets)
    winner = ranks.join(own, LIST).where("rank = target_rank - 1").select(*LIST, F.col("candidate_asin").alias("winner"))
    target = targets.select(F.col("sample_id").alias("session_id"), F.col("ground_truth.parent_asin").alias("target"))
    plain = lambda c: F.array_distinct(F.filter(F.transform(c, lambda v: dialogue._squeezed(F.lower(v))), lambda v: F.length(v) > 3))
    cards = _cards(s, d).select(F.col("parent_asin").alias("target"), plain(F.concat("hard_constraints", "soft_preferences")).alias("spans"))
    live = state.live_columns(x.spans, x.named, x.slots).select(*LIST, F.size("spans").alias("said"))
    blob = lambda who: x.products.select(F.col("parent_asin").alias(who), F.col("search_blob").alias(f"{who}_blob"))
    rows = winner.join(target, "session_id").join(cards, "target").join(live, LIST, "left").na.fill(0, ["said"]).join(blob("target"), "target").join(blob("winner"), "winner")
    return evaluate.verdicts(rows)


def pair_verdicts(s, d):
    return _verdicts(s, d).select("session_id", F.col("turn").alias("hit_turn"), "said", "card", "target_hits", "winner_hits", "verdict")


def verdict_counts(s, d):
    """Pairs of each verdict, and the median number of statements live at the hit and on the card."""
    return _verdicts(s, d).groupBy("verdict").agg(F.count("*").alias("pairs"), F.median("said").alias("median_said"), F.median("card").alias("median_card"))


def _differences(s, d) -> DataFrame:
    ranks = base._ranks(s, d)
    own = evaluate.deciding_lists(ranks, base._targets(s, d))
    rows = ranks.join(own, LIST).where("rank < target_rank").select(*LIST, F.col("candidate_asin").alias("winner"), "features", "target_features", F.zip_with("target_features", "features", lambda a, b: a - b).alias("d"))
    return learn.unit(learn.augmented(rows)).select(*LIST, "winner", "d")


def unit_pairs(s, d):
    """The non-zero entries of the augmented, normalised difference vectors of the losing pairs."""
    rows = _differences(s, d).select(*LIST, "winner", F.posexplode("d").alias("place", "value"))
    return rows.where("value <> 0").select(*LIST, "winner", "place", F.round("value", 6).alias("value"))


def separability(s, d):
    """Losing pairs, how many one weight vector satisfies by fit and by the greedy subset, and whether all are separable."""
    size = len(evaluate.TRACE) + len(learn.DIMENSIONS)
    vectors = stage(_differences(s, d), "differences")
    w, _ = learn.perceptron(vectors, size, 10)
    fit = learn.satisfied(vectors, learn.logistic_fit(vectors, size, 5))
    most, _ = learn.greedy_subset(vectors, size, 5, 3)
    return s.createDataFrame([(vectors.count(), fit, most, w is not None)], "pairs long, satisfied long, subset long, separable boolean")


QUERIES = {f.__name__: f for f in (
    span_weights, session_slots, weighted_query_terms, intent_route, respond_lists, respond_metrics, last_lists, uncommon_brands, partition_entropy, gap_slices, replay_agreement, inflection_splits, attribute_yield,
    hidden_fields, override_turns, pair_verdicts, verdict_counts, unit_pairs, separability,
)}

_CUE = f"(?i){REPLACED_CUE}"
_WORDS = lambda words: f"list_distinct(regexp_extract_all(lower(text), '\\b({'|'.join(words)})\\b', 1))"
_STATE = base._PARSED + f""",
{base._VOCAB},
st AS (SELECT session_id, turn AS stated_at, (pos - 1)::INTEGER AS pos, is_override AS changes, CASE WHEN is_override AND regexp_matches(x, '{_CUE}') THEN trim(regexp_replace(x, '(?is){REPLACED_CUE}.*$', ''), ' .,:;') ELSE x END AS text
  FROM (SELECT session_id, turn, is_override, unnest(range(1, len(spans) + 1)) AS pos, unnest(spans) AS x FROM said)),
joined AS (SELECT session_id, stated_at, string_agg(text, ' ' ORDER BY pos) AS text FROM st WHERE changes GROUP BY ALL),
texts AS (SELECT text FROM st UNION SELECT category_phrase FROM said UNION SELECT text FROM joined),
g2 AS (SELECT *, {base._NAMED} AS named FROM texts), g3 AS (SELECT text, {base._GENDER} AS gender FROM (SELECT *, {base._UPTO} AS upto FROM g2)),
tg AS (SELECT DISTINCT text, array_to_string(g[i:i + n - 1], ' ') AS surface FROM (SELECT text, g, n, unnest(range(1, len(g) - n + 2)) AS i FROM (SELECT text, regexp_extract_all(lower(text), '[a-z0-9]+') AS g FROM texts), (SELECT unnest([1, 2, 3, 4]) AS n))),
lv AS (SELECT level, list_distinct({base._STEMS('level')}) AS terms FROM (SELECT DISTINCT lower(unnest(category_path)) AS level FROM product) WHERE length(level) > 3),
sv AS (SELECT text, 'materials' AS slot, unnest({_WORDS(MATERIALS)}) AS value FROM texts UNION ALL SELECT text, 'colors', unnest({_WORDS(COLORS)}) FROM texts UNION ALL SELECT text, 'sizes', unnest({_WORDS(SIZES)}) FROM texts
  UNION ALL SELECT text, 'use_cases', unnest({_WORDS(USE_CASES)}) FROM texts UNION ALL SELECT text, 'gender', gender FROM g3 WHERE gender IS NOT NULL UNION ALL SELECT DISTINCT text, 'brands', brand_key FROM tg JOIN vocab USING (surface)
  UNION ALL SELECT text, 'categories', level FROM (SELECT text, {base._STEMS('text')} AS w FROM texts), lv WHERE len(terms) > 0 AND list_has_all(w, terms)),
tf AS (SELECT text, list(DISTINCT slot) AS fields FROM sv GROUP BY text),
ev AS (SELECT session_id, stated_at, CASE WHEN len(soft) > 0 THEN soft ELSE named END AS slots FROM (SELECT session_id, stated_at, named, list_filter(named, lambda s: s NOT IN ({sql.listed(IDENTITY_SLOTS)})) AS soft FROM
  (SELECT session_id, stated_at, coalesce(list_distinct(flatten(list(fields) FILTER (fields IS NOT NULL))), []) AS named FROM st LEFT JOIN tf USING (text) WHERE changes GROUP BY ALL))),
spans_at AS (SELECT t.session_id, t.turn, s.stated_at, s.pos, s.text, coalesce(tf.fields, []) AS fields FROM turns t JOIN st s ON s.session_id = t.session_id AND s.stated_at <= t.turn LEFT JOIN tf ON tf.text = s.text),
hit AS (SELECT s.session_id, s.turn, s.stated_at, s.pos, e.stated_at AS e_at, len(e.slots) = 0 AS everything FROM spans_at s JOIN ev e ON e.session_id = s.session_id AND e.stated_at > s.stated_at AND e.stated_at <= s.turn AND (len(e.slots) = 0 OR list_has_any(e.slots, s.fields))),
taken AS (SELECT session_id, turn, stated_at, pos, count(*) FILTER (everything) + CASE WHEN arg_min(everything, e_at) THEN 0 ELSE 1 END AS times FROM hit GROUP BY ALL),
spanstate AS (SELECT s.session_id, s.turn, s.stated_at, s.pos, s.text, round(power({DECAY}::DOUBLE, coalesce(times, 0)), 9) AS weight, times IS NOT NULL AS superseded FROM spans_at s LEFT JOIN taken USING (session_id, turn, stated_at, pos)),
phrase AS (SELECT t.session_id, t.turn, coalesce((SELECT arg_max(j.text, e.stated_at) FROM ev e JOIN joined j ON j.session_id = e.session_id AND j.stated_at = e.stated_at WHERE e.session_id = t.session_id AND e.stated_at <= t.turn AND list_contains(e.slots, 'categories')),
  (SELECT arg_min(c.category_phrase, c.turn) FROM said c WHERE c.session_id = t.session_id AND c.turn <= t.turn AND c.category_phrase <> ''), '') AS phrase FROM turns t),
statement AS (SELECT session_id, stated_at, pos, text FROM st UNION ALL SELECT session_id, turn, 1000000, phrase FROM phrase WHERE phrase <> ''),
clears AS (SELECT t.session_id, t.turn, slot, max(e.stated_at) AS since FROM turns t JOIN ev e ON e.session_id = t.session_id AND e.stated_at <= t.turn, (SELECT unnest([{sql.listed((*SOFT_SLOTS, *IDENTITY_SLOTS))}]) AS slot)
  WHERE list_contains(e.slots, slot) OR (len(e.slots) = 0 AND slot IN ({sql.listed(SOFT_SLOTS)})) GROUP BY ALL),
inforce AS (SELECT t.session_id, t.turn, v.slot, v.value, s.stated_at, s.pos FROM turns t JOIN statement s ON s.session_id = t.session_id AND s.stated_at <= t.turn JOIN sv v ON v.text = s.text
  LEFT JOIN clears c ON c.session_id = t.session_id AND c.turn = t.turn AND c.slot = v.slot WHERE c.since IS NULL OR s.stated_at >= c.since),
slotstate AS (SELECT DISTINCT session_id, turn, slot, value FROM inforce WHERE slot <> 'gender' UNION ALL SELECT session_id, turn, 'gender', arg_min(value, stated_at * 10000000 + pos) FROM inforce WHERE slot = 'gender' GROUP BY ALL)"""
_LIVE_SPANS = r"""list_distinct(list_filter(list_transform(list_filter(list_transform(coalesce(texts, []), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: length(x) > 3),
  lambda x: CASE WHEN starts_with(x, 'color:') THEN trim(regexp_replace(x, '^color:', '')) ELSE x END), lambda x: x <> ''))"""
_TERM = lambda col, source: f"(SELECT t.*, coalesce(c.canonical, {sql.stem('token')}) AS term FROM (SELECT *, unnest({sql.surface(col)}) AS token FROM {source}) t LEFT JOIN canonical c USING (token))"
_TERMS = f"""stated AS (SELECT session_id, turn, term, max(weight * (1 + {RECENCY}::DOUBLE * greatest(0, stated_at - 1))) AS stated FROM {_TERM('text', 'spanstate')} WHERE term NOT IN ({sql.listed(BOILERPLATE)}) GROUP BY ALL),
kinds AS (SELECT DISTINCT session_id, turn, term, 1.0::DOUBLE AS kind FROM {_TERM('phrase', 'phrase')} WHERE term NOT IN ({sql.listed(BOILERPLATE)})),
terms AS (SELECT session_id, turn, field, term, round(k * coalesce(kind, 0) + c * coalesce(stated, 0), 9) AS weight FROM stated FULL JOIN kinds USING (session_id, turn, term),
  (VALUES {', '.join(f"('{f}', {k}::DOUBLE, {c}::DOUBLE)" for f, (k, c) in BLENDS.items())}) b(field, k, c))"""
_MARKS = f"least(1.0, greatest(0.0, 0.5 + 0.25 * (({base._hits(BUYING_MARKERS)}) - ({base._hits(BROWSING_MARKERS)}))))"
_ROUTE = f"""{base._LABELS},
prof AS (SELECT sample_id AS session_id, coalesce(regexp_extract_all(coalesce(user_profile.purchase_frequency, ''), '(\\d+)')[-1]::INTEGER, 0) AS purchases, len(list_filter(coalesce(user_profile.preference_tags, []), lambda t: t IS NOT NULL AND trim(t) <> '')) AS tags FROM samples),
sig AS (SELECT t.session_id, t.turn, least(1.0, coalesce(live, 0) / 3) AS density, {_MARKS}::DOUBLE AS markers, least(1.0, coalesce(filled, 0) / 3) AS specificity, least(1.0, coalesce(purchases, 0) / 6 * 0.5 + coalesce(tags, 0) / 4 * 0.5) AS alignment
  FROM turns t LEFT JOIN (SELECT session_id, turn, count(*) AS live FROM spanstate WHERE NOT superseded GROUP BY ALL) USING (session_id, turn) LEFT JOIN (SELECT session_id, turn, count(DISTINCT slot) AS filled FROM slotstate GROUP BY ALL) USING (session_id, turn)
  LEFT JOIN prof USING (session_id)),
conf AS (SELECT *, round({' + '.join(f'{w}::DOUBLE * {n}' for n, w in INTENT_PARTS.items())}, 9) AS c FROM sig)"""
_FUSED_RUN = f"""f_scores AS (SELECT session_id, turn, candidate_asin, round(coalesce(features[1], 0), 9) AS score FROM trace),
f_ranks AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, candidate_asin) AS rank FROM f_scores),
f_hits AS (SELECT sample_id, r.turn, rank FROM f_ranks r JOIN labels ON r.session_id = sample_id AND candidate_asin = target AND rank <= 10 AND r.turn >= from_turn),
f_sessions AS (SELECT sample_id, h.rank AS best_rank FROM labels LEFT JOIN (SELECT * FROM f_hits QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY turn) = 1) h USING (sample_id))"""


def _variants(t: str) -> str:
    cut = lambda k, end="": f"left({t}, length({t}) - {k}) || '{end}'"
    rules = [("true", f"{t} || 's'"), ("true", f"{t} || 'es'"), (f"{t} LIKE '%y' AND length({t}) > 2", cut(1, "ies")), (f"{t} LIKE '%ie'", cut(2, "y")), (f"{t} LIKE '%f' AND length({t}) > 2", cut(1, "ves")), (f"{t} LIKE '%fe' AND length({t}) > 3", cut(2, "ves")),
             (f"{t} LIKE '%s' AND length({t}) > 3", cut(1)), (f"{t} LIKE '%es' AND length({t}) > 4", cut(2)), (f"{t} LIKE '%ies' AND length({t}) > 4", cut(3, "y")), (f"{t} LIKE '%ies' AND length({t}) > 4", cut(3, "ie")),
             (f"{t} LIKE '%ves' AND length({t}) > 4", cut(3, "f")), (f"{t} LIKE '%ves' AND length({t}) > 4", cut(3, "fe"))]
    odd = sql.lookup(t, {x: y for a, b in sql.IRREGULAR for x, y in ((a, b), (b, a))})
    return f"list_distinct(list_filter([{odd}, {', '.join(f'CASE WHEN {w} THEN {v} END' for w, v in rules)}], lambda x: x IS NOT NULL AND x <> {t}))"


_CARD_OF = base._CARDS + ", " + base._LABELS + ", card AS (SELECT l.parent_asin, hard, soft FROM cards JOIN listing l USING (listing_id))"
_KIND = base._CLASS.replace("lower(v)", "lower(x)")
_DIM = learn.DIMENSIONS
_AT = {n: i + 1 for i, n in enumerate(evaluate.TRACE)}
_UNKNOWN = lambda c, x: f"({c}[{_AT[x + '_satisfied']}] = 0 AND {c}[{_AT[x + '_violated']}] = 0)::INTEGER::DOUBLE"

ORACLE = {
    "span_weights": f"WITH {sql.PRODUCT}, {_STATE} SELECT session_id, turn, stated_at, pos, text, weight, superseded FROM spanstate",
    "session_slots": f"WITH {sql.PRODUCT}, {_STATE} SELECT session_id, turn, slot, value FROM slotstate",
    "weighted_query_terms": f"WITH {sql.PRODUCT}, {_STATE}, {sql.CANONICAL}, {_TERMS} SELECT session_id, turn, field, term, round(weight, 6) AS weight FROM terms QUALIFY row_number() OVER (PARTITION BY session_id, turn, field ORDER BY terms.weight DESC, term) <= 48",
    "intent_route": f"""WITH {sql.PRODUCT}, {_STATE}, {_ROUTE} SELECT session_id, turn, round(density, 6) AS density, round(markers, 6) AS markers, round(specificity, 6) AS specificity, round(alignment, 6) AS alignment, round(c, 6) AS confidence,
CASE WHEN c >= {INTENT_BOUNDS[1]}::DOUBLE THEN 'buying' WHEN c <= {INTENT_BOUNDS[0]}::DOUBLE THEN 'browsing' ELSE 'uncertain' END AS intent FROM conf""",
    "last_lists": f"""WITH {base._TURNS}, {base._TRACE}, b AS (SELECT session_id, turn, candidate_asin FROM trace QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY bm25 DESC, candidate_asin DESC) = 1)
SELECT t.session_id, t.turn, (SELECT arg_max(b.candidate_asin, b.turn) FROM b JOIN turns u ON u.session_id = b.session_id AND u.turn = b.turn WHERE b.session_id = t.session_id AND b.turn <= t.turn) AS candidate_asin FROM turns t""",
    "uncommon_brands": f"""WITH {sql.PRODUCT}, {sql.INDEX}, {base._VOCAB}, cm AS (SELECT term, max(df) / max(n_docs) AS c FROM term_stats WHERE field IN ('title', 'features', 'categories') GROUP BY term),
w AS (SELECT surface, unnest({base._STEMS('surface')}) AS term FROM vocab WHERE NOT contains(surface, ' ')) SELECT surface, brand_key FROM vocab WHERE surface NOT IN (SELECT surface FROM w JOIN cm USING (term) WHERE c > 0.01)""",
    "partition_entropy": f"""WITH {sql.PRODUCT}, {base._TRACE}, p AS (SELECT DISTINCT session_id, turn, candidate_asin FROM trace),
x AS (SELECT session_id, turn, attribute, CASE attribute WHEN 'category' THEN nullif(category_path[-1], '') WHEN 'brand' THEN nullif(brand_key, '') ELSE coalesce(gender, gender_fallback) END AS part FROM p JOIN product ON parent_asin = candidate_asin, (SELECT unnest(['category', 'brand', 'size']) AS attribute)),
n AS (SELECT session_id, turn, attribute, part, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id, turn, attribute) AS p FROM n)
SELECT session_id, turn, attribute, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY ALL""",
    "gap_slices": f"""WITH {base._GAPS}, sl AS (SELECT sample_id AS session_id, 'scenario_type' AS slice, coalesce(scenario_type, 'none') AS value FROM samples UNION ALL SELECT sample_id, 'difficulty_bucket', coalesce(difficulty_bucket, 'none') FROM samples),
m AS (SELECT slice, value, feature, round(avg(contribution), 6) AS mean_gap FROM gaps JOIN sl USING (session_id) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY slice, value ORDER BY mean_gap DESC, feature)::INTEGER AS place FROM m QUALIFY place <= 3""",
    "replay_agreement": f"WITH {base._SESSIONS}, {_FUSED_RUN} SELECT count(*) FILTER (s.best_rank IS NOT DISTINCT FROM f.best_rank) AS agree, count(*) FILTER (s.best_rank IS DISTINCT FROM f.best_rank) AS disagree FROM sessions s JOIN f_sessions f USING (sample_id)",
    "inflection_splits": f"""WITH {sql.PRODUCT}, {sql.CANONICAL}, t AS (SELECT k.token, n, coalesce(c.canonical, {sql.stem('k.token')}) AS term FROM counts k LEFT JOIN canonical c ON c.token = k.token WHERE n >= 5),
v AS (SELECT token, term, n, unnest({_variants('token')}) AS other FROM t)
SELECT DISTINCT least(v.token, other) AS "first", greatest(v.token, other) AS "second", CASE WHEN v.token < other THEN v.term ELSE o.term END AS first_term, CASE WHEN v.token < other THEN o.term ELSE v.term END AS second_term, least(v.n, o.n) AS stake FROM v JOIN t o ON o.token = other WHERE v.term <> o.term""",
    "attribute_yield": f"""WITH {_CARD_OF}, k AS (SELECT scenario_type, attribute, list_filter(list_concat(hard, soft), lambda x: attribute = 'other' OR ({_KIND}) = attribute)[1:2] AS told FROM samples JOIN card ON parent_asin = ground_truth.parent_asin, (SELECT unnest([{sql.listed(ATTRIBUTES)}]) AS attribute)),
b AS (SELECT attribute, scenario_type <> 'boundary' AND len(told) > 0 AND NOT regexp_matches(array_to_string(told, '; ') || '.', 'don''t have|do not have') AS tells, array_to_string(told, '; ') || '.' AS body FROM k),
n AS (SELECT attribute, CASE WHEN tells THEN len(list_filter(string_split(body, ';'), lambda p: trim(p) <> '')) ELSE 0 END AS spans, CASE WHEN tells THEN length(trim(body)) ELSE 0 END AS chars FROM b)
SELECT attribute, round(avg((spans > 0)::INTEGER), 4) AS yield_rate, round(avg(spans), 3) AS mean_spans, round(avg(chars), 1) AS mean_chars FROM n GROUP BY attribute""",
    "hidden_fields": f"""WITH {_CARD_OF}, x AS (SELECT s.*, intent_card IS NOT NULL AND behavior IS NOT NULL AS given, c.hard, c.soft FROM samples s LEFT JOIN card c ON c.parent_asin = ground_truth.parent_asin),
y AS (SELECT *, CASE WHEN scenario_type = 'intent_override' AND hard IS NOT NULL THEN coalesce(soft[-1], 'I prefer a different style.') END AS o, CASE WHEN scenario_type = 'intent_override' AND hard IS NOT NULL THEN coalesce(hard[1], 'Please prioritize the target requirements.') END AS w FROM x)
SELECT sample_id, array_to_string(CASE WHEN given THEN intent_card.hard_constraints ELSE hard END, ' | ') AS hard, array_to_string(CASE WHEN given THEN intent_card.soft_preferences ELSE soft END, ' | ') AS soft, CASE WHEN given THEN behavior.override.old_value ELSE o END AS old_value,
CASE WHEN given THEN behavior.override.new_value ELSE w END AS new_value, CASE WHEN given THEN behavior.override.message ELSE 'Actually, ignore my earlier preference. What I need is: ' || w || '.' END AS message FROM y""",
    "unit_pairs": f"""WITH {base._GAPS}, v AS (SELECT r.session_id, r.turn, candidate_asin AS winner, list_concat(list_transform(range(1, {len(evaluate.TRACE)} + 1), lambda i: tf[i] - features[i]), [{', '.join(f"{_UNKNOWN('tf', x)} - {_UNKNOWN('features', x)}" for x in _DIM)}]) AS d
  FROM ranks r JOIN own o ON r.session_id = o.session_id AND r.turn = o.turn AND r.rank < o.target_rank),
u AS (SELECT session_id, turn, winner, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS n FROM v), e AS (SELECT session_id, turn, winner, unnest(range({len(evaluate.TRACE) + len(_DIM)}))::INTEGER AS place, unnest(d) AS x, n FROM u)
SELECT session_id, turn, winner, place, round(x / n, 6) AS value FROM e WHERE x <> 0""",
}
_VERDICTS = f"""{sql.PRODUCT}, {_STATE}, {base._CARDS.split("c0 AS", 1)[1].join(["c0 AS", ""])}, {base._GAPS},
live AS (SELECT session_id, turn, len({_LIVE_SPANS}) AS said FROM (SELECT session_id, turn, list(text ORDER BY stated_at, pos) AS texts FROM spanstate WHERE NOT superseded GROUP BY ALL)),
pairs AS (SELECT o.session_id, o.turn, r.candidate_asin AS winner, l.target FROM own o JOIN ranks r ON r.session_id = o.session_id AND r.turn = o.turn AND r.rank = o.target_rank - 1 JOIN labels l ON l.sample_id = o.session_id),
vv AS (SELECT p.session_id, p.turn AS hit_turn, coalesce(said, 0) AS said, list_distinct(list_filter(list_transform(list_concat(k.hard, k.soft), lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))), lambda x: length(x) > 3)) AS sp, a.search_blob AS tb, b.search_blob AS wb
  FROM pairs p JOIN product a ON a.parent_asin = p.target JOIN product b ON b.parent_asin = p.winner JOIN cards k ON k.listing_id = a.doc_id LEFT JOIN live v ON v.session_id = p.session_id AND v.turn = p.turn),
hh AS (SELECT *, len(sp) AS card, len(list_filter(sp, lambda x: contains(tb, x))) AS target_hits, len(list_filter(sp, lambda x: contains(wb, x))) AS winner_hits FROM vv),
verdicts AS (SELECT session_id, hit_turn, said::INTEGER AS said, card::INTEGER AS card, target_hits::INTEGER AS target_hits, winner_hits::INTEGER AS winner_hits, CASE WHEN target_hits <= winner_hits THEN 'C' WHEN said < card THEN 'B' ELSE 'A' END AS verdict FROM hh)"""
ORACLE["pair_verdicts"] = f"WITH {_VERDICTS} SELECT * FROM verdicts"
ORACLE["verdict_counts"] = f"WITH {_VERDICTS} SELECT verdict, count(*) AS pairs, median(said)::DOUBLE AS median_said, median(card)::DOUBLE AS median_card FROM verdicts GROUP BY verdict"
