"""Ranking metrics, replay of recorded candidate lists, and what recorded lists lose by."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import CARD_COLORS, CARD_MATERIALS, CARD_NOISE, CONSTRAINT_WORDS, INTENT_WEIGHTS
from ..functions.text import clean_constraint

MISS = 11
#: The recorded vector's columns, in order, and their weights; fixed values.
TRACE = {
    "fused": 1.0, "bm25_title": 0.26, "bm25_features": 0.3, "bm25_categories": 0.11, "bm25_description": 0.0, "bm25_store": 0.0, "dense": 0.18, "phrase_title": 0.16,
    "phrase_features": 0.13, "phrase_categories": 0.5, "span_coverage": 0.0, "span_all": 0.4, "coverage": 0.6, "title_low_coverage": -0.2, "popularity_low_coverage": -0.4,
    "popularity": 0.88, "quality": 0.015, "has_price": 0.09, "has_description": 0.01, "n_features_norm": 0.07,
    "gender_satisfied": 0.055, "gender_violated": -0.23, "brand_satisfied": 0.18, "brand_violated": -0.06, "category_satisfied": 0.12, "category_violated": -0.07,
    "price_satisfied": 0.03, "price_violated": -0.055, "material_satisfied": 0.07, "material_violated": -0.02, "color_satisfied": 0.045, "color_violated": -0.015,
    "gender_unknown": -0.01, "brand_unknown": 0.0, "category_unknown": -0.005, "price_unknown": -0.005, "material_unknown": 0.0, "color_unknown": 0.0,
    "profile_affinity": 0.06, "category_focus": 0.0,
}


def samples(public_set: DataFrame) -> DataFrame:
    """One row per sample_id, the one loaded last."""
    w = Window.partitionBy("sample_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("created_at").desc_nulls_last())
    return public_set.where("sample_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def trace(candidates: DataFrame) -> DataFrame:
    """The distinct recorded rows."""
    return candidates.where("session_id is not null and turn is not null and candidate_asin is not null").distinct()


def trace_score(vector: Column, intent: Column, weights: dict[str, float] = TRACE, own_weights: dict[str, dict[str, float]] = INTENT_WEIGHTS) -> Column:
    """The score of a recorded vector under the linear model of its intent."""
    total = F.lit(0.0)
    for i, (name, w) in enumerate(weights.items()):
        weight = F.lit(w)
        for own, table in own_weights.items():
            if name in table:
                weight = F.when(intent == own, F.lit(table[name])).otherwise(weight)
        total = total + weight * F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0))
    return F.round(total, 9)


def replay_ranks(recorded: DataFrame, score: Callable[[Column, Column], Column] = trace_score) -> DataFrame:
    """(session_id, turn, intent, candidate_asin, features, score, rank) by score, then id.

    score: any expression of a recorded vector and its intent.
    """
    scored = recorded.select("session_id", "turn", "intent", "candidate_asin", "features", score(F.col("features"), F.col("intent")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "turn").orderBy(F.col("score").desc(), "candidate_asin")))


def agreement(replayed: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row (agree, disagree): sessions whose best_rank, null for none, is that of the recorded run; others count in neither."""
    live = recorded.select("sample_id", F.col("best_rank").alias("live_rank"))
    same = replayed.select("sample_id", "best_rank").join(live, "sample_id").select(F.col("best_rank").eqNullSafe(F.col("live_rank")).alias("same"))
    return same.agg(F.count_if("same").alias("agree"), F.count_if(~F.col("same")).alias("disagree"))


def replay_sessions(ranks: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """(sample_id, scenario_type, hit, first_hit_turn, best_rank, reciprocal_rank) of every labelled session.

    A hit counts from the turn on at which a change of mind, if the sample has one, has been said.
    """
    target = labels.select(F.col("sample_id").alias("session_id"), "scenario_type", F.col("ground_truth.parent_asin").alias("target"), F.coalesce(F.col("behavior.override.turn"), F.lit(0)).alias("from_turn"))
    hits = ranks.join(target, "session_id").where((F.col("candidate_asin") == F.col("target")) & (F.col("rank") <= top) & (F.col("turn") >= F.col("from_turn")))
    first = hits.groupBy("session_id").agg(F.min("turn").alias("first_hit_turn"), F.min_by("rank", "turn").alias("best_rank"))
    rows = target.join(first, "session_id", "left")
    return rows.select(
        F.col("session_id").alias("sample_id"), "scenario_type", F.col("best_rank").isNotNull().alias("hit"), "first_hit_turn", "best_rank",
        F.coalesce(1 / F.col("best_rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def metrics(sessions: DataFrame) -> DataFrame:
    """Hit rate, MRR and mean turns per scenario and overall ('all'), by one aggregation over grouping sets."""
    turns = F.coalesce("first_hit_turn", F.lit(MISS))
    rows = sessions.withColumns({"h": F.col("hit").cast("double"), "t": turns.cast("double")}).groupingSets([[F.col("scenario_type")], []], F.col("scenario_type")).agg(
        F.grouping("scenario_type").alias("g"), F.count("*").alias("sample_count"), F.round(F.avg("h"), 6).alias("hit_rate"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("t"), 6).alias("mttc")
    )
    efficiency = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (11 - F.col("mttc")) / 10))
    return rows.select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("scenario_type")).alias("scenario_type"), "sample_count", "hit_rate", "mrr", "mttc", F.round(0.5 * F.col("hit_rate") + 0.3 * F.col("mrr") + 0.2 * efficiency, 6).alias("score"))


def deciding_lists(ranks: DataFrame, labels: DataFrame, band: tuple[int, int] = (2, 10)) -> DataFrame:
    """(session_id, turn, target_rank, target_features): the target in the list of each session's first hit, if its rank is in the band."""
    hit = replay_sessions(ranks, labels).where(F.col("best_rank").between(*band)).select(F.col("sample_id").alias("session_id"), F.col("first_hit_turn").alias("turn"))
    target = labels.select(F.col("sample_id").alias("session_id"), F.col("ground_truth.parent_asin").alias("candidate_asin"))
    own = ranks.join(hit, ["session_id", "turn"]).join(target, ["session_id", "candidate_asin"])
    return own.select("session_id", "turn", F.col("rank").alias("target_rank"), F.col("features").alias("target_features"))


def gaps(ranks: DataFrame, labels: DataFrame, winners: int = 3, band: tuple[int, int] = (2, 10)) -> DataFrame:
    """(session_id, turn, winner, feature, delta, contribution) for the first items of each deciding list, above its target.

    An equi-join on session and turn with an inequality on rank; the rank bound keeps a list's part small.
    """
    own = deciding_lists(ranks, labels, band)
    above = ranks.where(F.col("rank") <= winners).join(own, ["session_id", "turn"]).where(F.col("rank") < F.col("target_rank"))
    names = F.array(*[F.lit(n) for n in TRACE])
    weights = F.array(*[F.when(F.col("intent") == "buying", F.lit(INTENT_WEIGHTS["buying"].get(n, w))).when(F.col("intent") == "uncertain", F.lit(INTENT_WEIGHTS["uncertain"].get(n, w))).otherwise(F.lit(w)) for n, w in TRACE.items()])
    parts = F.arrays_zip(names.alias("feature"), F.zip_with("features", "target_features", lambda a, b: a - b).alias("delta"), weights.alias("weight"))
    rows = above.select("session_id", "turn", F.col("candidate_asin").alias("winner"), F.explode(parts).alias("p"))
    return rows.select("session_id", "turn", "winner", F.col("p.feature").alias("feature"), F.col("p.delta").alias("delta"), (F.col("p.delta") * F.col("p.weight")).alias("contribution"))


def gap_slices(rows: DataFrame, slices: DataFrame, first: int = 3) -> DataFrame:
    """(slice, value, feature, mean_gap, place): the features with the largest mean gap in each slice.

    slices: (session_id, slice, value), any number of rows per session.
    """
    mean = rows.join(slices, "session_id").groupBy("slice", "value", "feature").agg(F.round(F.avg("contribution"), 6).alias("mean_gap"))
    by = Window.partitionBy("slice", "value").orderBy(F.col("mean_gap").desc(), "feature")
    return mean.withColumn("place", F.row_number().over(by)).where(F.col("place") <= first)


def gap_summary(rows: DataFrame) -> DataFrame:
    """Per feature: mean and largest contribution, how often it is against the target, and its share of all gaps."""
    total = rows.agg(F.sum("contribution").alias("total"))
    by = rows.groupBy("feature").agg(F.avg("contribution").alias("mean"), F.sum("contribution").alias("sum"), F.avg((F.col("contribution") > 1e-12).cast("double")).alias("against"), F.max("contribution").alias("most"))
    share = F.when(F.col("total") != 0, F.col("sum") / F.col("total")).otherwise(0.0)
    # the last digits of a sum depend on the order of its rows; they are not to decide halves
    settled = lambda x: F.round(F.round(x, 12), 6)
    return by.join(F.broadcast(total)).select("feature", settled("mean").alias("mean_gap"), settled(share).alias("share"), F.round("against", 6).alias("against_rate"), settled("most").alias("max_single"))


def valid_lists(lists: DataFrame, catalog: DataFrame, top: int = 10) -> DataFrame:
    """(session_id, turn, parent_asin, place): the first ten distinct known ids of each recommendation list, in order.

    lists: session_id, turn, items array<string>.
    """
    items = lists.select("session_id", "turn", F.posexplode("items").alias("pos", "item")).select("session_id", "turn", "pos", F.trim("item").alias("parent_asin")).where("parent_asin <> ''")
    known = catalog.select(F.trim("parent_asin").alias("parent_asin")).where("parent_asin <> ''").distinct()
    first = items.join(known, "parent_asin", "left_semi").groupBy("session_id", "turn", "parent_asin").agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("pos"))).where(F.col("place") <= top).select("session_id", "turn", "parent_asin", "place")


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys..., entropy) in bits of the counts of each group."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__total"))
    p = F.col(n) / F.col("__total")
    return counts.join(total, keys).groupBy(*keys).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))


def commitment(ranks: DataFrame, keys: list[str], first: int = 10) -> DataFrame:
    """(keys..., nqc): spread of the first scores of a list against its best; 1 for a single one, 0 if the best is not positive."""
    rows = ranks.where(F.col("rank") <= first).groupBy(*keys).agg(F.count("*").alias("n"), F.max("score").alias("best"), F.stddev_pop("score").alias("sd"))
    value = F.when(F.col("n") < 2, 1.0).when(F.col("best") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("sd") / F.abs("best")))
    return rows.select(*keys, F.round(value, 6).alias("nqc"))


def coarse_category(levels: Column) -> Column:
    parts = F.flatten(F.transform(F.filter(levels, lambda x: x.isNotNull()), lambda x: F.split(x, ",")))
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).isin(CARD_NOISE))
    last = F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(kept) > 0, F.array_join(last, " ")).otherwise(F.lit("clothing item"))


def constraint_class(value: Column) -> Column:
    """The attribute a constraint speaks of; the first rule that fits."""
    low = F.lower(value)
    out = F.when(F.contains(low, F.lit("budget")) | low.rlike(r"(?:\$|<=|under)\s*\d"), F.lit("budget"))
    for name, words in CONSTRAINT_WORDS:
        out = out.when(low.rlike("|".join(words)), F.lit(name))
    return out.otherwise(F.lit("feature"))


def intent_cards(listings: DataFrame) -> DataFrame:
    """(listing_id, target_category, hard_constraints, soft_preferences) from a listing's own text.

    Prices, a business rule of the reference, are left out.
    """
    details = F.transform(F.array_sort(F.map_entries("details")), lambda e: F.when(e["value"] != "", F.concat_ws(": ", e["key"], e["value"])))
    given = F.filter(F.concat(F.coalesce("features", F.array().cast("array<string>")), F.coalesce(details, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    corpus = F.lower(F.concat_ws(" ", "title", "features", "description", "categories", "store", F.array_join(F.coalesce(details, F.array().cast("array<string>")), " ")))
    found = lambda words: F.nullif(F.regexp_extract(corpus, r"\b(" + "|".join(words) + r")\b", 1), F.lit(""))
    material, color = found(CARD_MATERIALS), found(CARD_COLORS)
    head = F.filter(F.array(material, F.concat(F.lit("color: "), color)), lambda x: x.isNotNull())
    # the color goes to the second place, before or after the first feature
    rest = F.when(material.isNull() & color.isNotNull(), F.concat(F.slice(given, 1, 1), head, F.slice(given, F.lit(2), F.greatest(F.size(given), F.lit(1))))).otherwise(F.concat(head, given))
    clean = F.array_distinct(F.filter(F.transform(rest, lambda x: clean_constraint(x)), lambda x: x != ""))
    title = clean_constraint(F.coalesce(F.nullif("title", F.lit("")), F.lit("product")))
    card = listings.select("listing_id", title.alias("target_category"), F.when(F.size(clean) > 0, clean).otherwise(F.array(title)).alias("c"))
    soft = F.slice("c", 3, 2)
    return card.select("listing_id", "target_category", F.slice("c", 1, 2).alias("hard_constraints"), F.when(F.size(soft) > 0, soft).otherwise(F.slice("c", 1, 1)).alias("soft_preferences"))


def given_or_derived(samples: DataFrame, cards: DataFrame) -> DataFrame:
    """(sample_id, hard, soft, old_value, new_value, message): a sample's own card and change of mind, or those made from its target's listing.

    cards: (parent_asin, hard_constraints, soft_preferences); a sample with neither has nulls.  The turn of a made
    change of mind is override_turn's.
    """
    rows = samples.join(cards, F.col("ground_truth.parent_asin") == F.col("parent_asin"), "left")
    given = F.col("intent_card").isNotNull() & F.col("behavior").isNotNull()
    hard, soft = (F.when(given, F.col(f"intent_card.{c}")).otherwise(F.col(c)) for c in ("hard_constraints", "soft_preferences"))
    old = F.coalesce(F.try_element_at("soft_preferences", F.lit(-1)), F.lit("I prefer a different style."))
    new = F.coalesce(F.try_element_at("hard_constraints", F.lit(1)), F.lit("Please prioritize the target requirements."))
    message = F.concat(F.lit("Actually, ignore my earlier preference. What I need is: "), new, F.lit("."))
    changes = (F.col("scenario_type") == "intent_override") & F.col("hard_constraints").isNotNull()
    either = lambda name, made: F.when(given, F.col(f"behavior.override.{name}")).when(changes, made)
    return rows.select("sample_id", hard.alias("hard"), soft.alias("soft"), either("old_value", old).alias("old_value"), either("new_value", new).alias("new_value"), either("message", message).alias("message"))


@F.pandas_udf(T.IntegerType())
def override_turn(keys: pd.Series) -> pd.Series:
    """The turn, 3 or 4, of a made change of mind; keys: sample id, NUL, scenario.  The generator and its seed are fixed."""
    return keys.map(lambda key: None if key is None else random.Random(key).choice([3, 4])).astype("Int32")


def attribute_yield(cards: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, yield_rate, mean_spans, mean_chars): what asking for an attribute first brings.

    cards: (sample_id, scenario_type, values array) in the order of the card.  At most two values of the attribute are
    told; 'other' fits any; a sample of the boundary scenario tells nothing.
    """
    known = F.transform("values", lambda v: F.named_struct(F.lit("kind"), constraint_class(v), F.lit("value"), v))
    rows = cards.select("scenario_type", known.alias("known"), F.explode(F.array(*[F.lit(a) for a in attributes])).alias("attribute"))
    told = F.slice(F.transform(F.filter("known", lambda x: (F.col("attribute") == "other") | (x["kind"] == F.col("attribute"))), lambda x: x["value"]), 1, 2)
    body = F.concat(F.array_join("told", "; "), F.lit("."))
    rows = rows.withColumn("told", told).withColumn("body", body)
    tells = (F.col("scenario_type") != "boundary") & (F.size("told") > 0) & ~F.col("body").rlike("don't have|do not have")
    spans = F.when(tells, F.size(F.filter(F.split("body", ";"), lambda p: F.trim(p) != ""))).otherwise(0)
    rows = rows.select("attribute", spans.alias("spans"), F.when(tells, F.length(F.trim("body"))).otherwise(0).alias("chars"))
    return rows.groupBy("attribute").agg(F.round(F.avg((F.col("spans") > 0).cast("double")), 4).alias("yield_rate"), F.round(F.avg("spans"), 3).alias("mean_spans"), F.round(F.avg("chars"), 1).alias("mean_chars"))


def verdicts(pairs: DataFrame) -> DataFrame:
    """Adds card, target_hits, winner_hits and verdict to pairs of a target and the item just above it.

    pairs: spans (of the target's card), said (how many were live), target_blob, winner_blob.  C: the card can't tell
    them apart; B: not all of it was said; A: it was, and the ranking failed.
    """
    hits = lambda blob: F.size(F.filter("spans", lambda x: F.contains(F.col(blob), x)))
    rows = pairs.withColumns({"card": F.size("spans"), "target_hits": hits("target_blob"), "winner_hits": hits("winner_blob")})
    return rows.withColumn("verdict", F.when(F.col("target_hits") <= F.col("winner_hits"), "C").when(F.col("said") < F.col("card"), "B").otherwise("A"))
