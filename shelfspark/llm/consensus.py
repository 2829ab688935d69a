"""Problem 5: one ranking from several differently scaled scores.

Scores are replaced by their ranks within the list, so neither range nor outliers matter.  The correlation matrix of
the ranks, one aggregation over all lists, gives the first principal component; the sign of each loading is turned to
the declared direction of its score, and items are sorted by their projection.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lists longer than this are ranked in slices.
LONG_LIST = 100_000
SLICES = 64
#: Long lists that are told apart by name; with more, all lists go the way of long ones.
SPLIT_LISTS = 50


def rank_scores(items: DataFrame, keys: list[str], item: str, scores: dict[str, int]) -> DataFrame:
    """keys, item and r_<score> in (0, 1] for each score: the mean rank of equal values over the list's length.

    scores: name -> 1 if more is better, -1 if less is; null counts as 0.  Lists are ranked whole, all scores in one
    shuffle; those longer than LONG_LIST are ranked in slices instead.
    """
    sizes = items.groupBy(*keys).agg(F.count("*").alias("__length")).where(F.col("__length") > LONG_LIST)
    long = [F.struct(*keys).eqNullSafe(F.struct(*[F.lit(v).cast(items.schema[k].dataType).alias(k) for k, v in zip(keys, row[:-1])])) for row in sizes.limit(SPLIT_LISTS + 1).collect()]
    if not long:
        return _ranked_whole(items, keys, item, scores)
    if len(long) > SPLIT_LISTS:
        return _ranked_in_slices(items, keys, item, scores)
    is_long = functools.reduce(lambda a, b: a | b, long)
    return _ranked_whole(items.where(~is_long), keys, item, scores).unionByName(_ranked_in_slices(items.where(is_long), keys, item, scores))


def _ranked_whole(items: DataFrame, keys: list[str], item: str, scores: dict[str, int]) -> DataFrame:
    rows = items.select(*keys, item, *[(s * F.coalesce(F.col(n).cast("double"), F.lit(0.0))).alias(f"v_{n}") for n, s in scores.items()])
    rows = rows.withColumn("length", F.count("*").over(Window.partitionBy(*keys)))
    for n in scores:
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(f"v_{n}"))
        equal = F.count("*").over(Window.partitionBy(*keys, f"v_{n}"))
        rows = rows.withColumn(f"r_{n}", (rank + (equal - 1) / 2) / F.col("length"))
    return rows.select(*keys, item, *[f"r_{n}" for n in scores])


def _ranked_in_slices(items: DataFrame, keys: list[str], item: str, scores: dict[str, int]) -> DataFrame:
    """rank_scores for long lists: cut at quantiles of the score, each slice ranked in its own task, the counts of the lower slices added."""
    values = F.array(*[F.struct(F.lit(n).alias("score"), (s * F.coalesce(F.col(n).cast("double"), F.lit(0.0))).alias("value")) for n, s in scores.items()])
    long = items.select(*keys, item, F.explode(values).alias("x")).select(*keys, item, "x.score", "x.value")
    size = long.groupBy(*keys, "score").agg(F.count("*").alias("length"), F.percentile_approx("value", [k / SLICES for k in range(1, SLICES)], 1000).alias("cuts"))
    size = size.withColumn("cuts", F.when(F.col("length") > LONG_LIST, F.col("cuts")))
    known = long.join(size, [*keys, "score"])
    slice_of = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    known = known.withColumn("slice", slice_of).drop("cuts")
    by = [*keys, "score"]
    slices = known.groupBy(*by, "slice").agg(F.count("*").alias("n"))
    below = slices.withColumn("below", F.sum("n").over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    # equal values share a slice; counting distinct values first keeps a hot value out of the window
    value_counts = known.groupBy(*by, "slice", "value").agg(F.count("*").alias("n"), F.first("length").alias("length")).join(below, [*by, "slice"])
    upto = F.sum("n").over(Window.partitionBy(*by, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = value_counts.select(*by, "value", ((F.col("below") + upto - (F.col("n") - 1) / 2) / F.col("length")).alias("rank"))
    wide = long.join(ranked, [*by, "value"]).groupBy(*keys, item)
    return wide.agg(*[F.max(F.when(F.col("score") == n, F.col("rank"))).alias(f"r_{n}") for n in scores])


def first_component(ranks: DataFrame, scores: list[str]) -> dict[str, float]:
    """The loadings of the first principal component of the rank columns, each turned positive, of length 1.

    Ranks already follow the declared directions, so a positive loading is an oriented one.  A constant score has
    correlation 0 with the others; without rows every loading is equal.
    """
    pairs = [(a, b) for i, a in enumerate(scores) for b in scores[i + 1 :]]
    row = ranks.agg(*[F.corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else None
    m = np.eye(len(scores))
    for a, b in pairs:
        c = row[f"{a}|{b}"]
        i, j = scores.index(a), scores.index(b)
        m[i, j] = m[j, i] = 0.0 if c is None or np.isnan(c) else c
    if np.allclose(m, np.eye(len(scores))):
        loading = np.full(len(scores), len(scores) ** -0.5)
    else:
        loading = np.abs(np.linalg.eigh(m)[1][:, -1])
    return dict(zip(scores, loading.tolist()))


def consensus_ranking(items: DataFrame, keys: list[str], item: str, scores: dict[str, int], weights: str = "component") -> DataFrame:
    """keys, item, r_<score>..., projection, place: the items of each list from best (place 1) to last.

    weights='component' projects on the oriented first component, 'equal' on the same oriented axes with loadings of
    equal size, for callers who declare all scores equally important.  Ties go by item.  Repeated rows of a list count
    once; rows with a null item are left out.
    """
    ranks = rank_scores(items.where(F.col(item).isNotNull()).select(*keys, item, *scores).distinct(), keys, item, scores)
    names = list(scores)
    loading = first_component(ranks, names) if weights == "component" else dict.fromkeys(names, len(names) ** -0.5)
    projection = F.round(sum((F.lit(w) * (F.col(f"r_{n}") - 0.5) for n, w in loading.items()), F.lit(0.0)), 9).alias("projection")
    return ranks.select("*", projection)


def placed(ranking: DataFrame, keys: list[str], item: str) -> DataFrame:
    return ranking.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("projection").desc(), F.col(item))))


SCORES = {"rating_number": 1, "average_rating": 1, "bm25": 1, "fused": 1}
LIST = ["session_id", "turn"]


def scored_candidates(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each list's distinct rows with the ratings of the catalog; a candidate without a listing has null ratings.

    Of listings with the same parent_asin the one loaded last counts.
    """
    when = F.struct(F.col("loaded_at"), F.col("listing_id"))
    ratings = catalog.where("parent_asin is not null").groupBy("parent_asin").agg(F.max_by(F.struct("rating_number", "average_rating"), when).alias("r"))
    lists = candidates.select(*LIST, "candidate_asin", "bm25", "fused").distinct()
    joined = lists.join(ratings, lists.candidate_asin == ratings.parent_asin, "left")
    return joined.select(*LIST, "candidate_asin", "r.rating_number", "r.average_rating", "bm25", "fused")


def leaders(candidates: DataFrame, catalog: DataFrame, weights: str = "equal") -> DataFrame:
    """The first item of each list: (session_id, turn, candidate_asin)."""
    ranking = consensus_ranking(scored_candidates(candidates, catalog), LIST, "candidate_asin", SCORES, weights)
    best = F.min_by("candidate_asin", F.struct((-F.col("projection")).alias("p"), F.col("candidate_asin").alias("c")))
    return ranking.groupBy(*LIST).agg(best.alias("candidate_asin"))
