"""Small learners over recorded candidate lists: pairwise logistic weights, separability, positional join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import evaluate


def difference_vectors(ranks: DataFrame, labels: DataFrame, band: tuple[int, int] = (2, 10)) -> DataFrame:
    """(session_id, turn, winner, d): in each deciding list, the target's vector less that of each item above it."""
    own = evaluate.deciding_lists(ranks, labels, band)
    above = ranks.join(own, ["session_id", "turn"]).where(F.col("rank") < F.col("target_rank"))
    return above.select("session_id", "turn", F.col("candidate_asin").alias("winner"), F.zip_with("target_features", "features", lambda a, b: a - b).alias("d"))


DIMENSIONS = ("gender", "brand", "category", "price", "material", "color")


def augmented(vectors: DataFrame) -> DataFrame:
    """d with six entries more: for each constraint, how the target's 'unknown' (neither met nor violated) differs.

    vectors: target_features and features beside d.
    """
    names = list(evaluate.TRACE)

    def unknown(c: str, dimension: str):
        return ((F.get(c, F.lit(names.index(f"{dimension}_satisfied"))) == 0) & (F.get(c, F.lit(names.index(f"{dimension}_violated"))) == 0)).cast("double")

    extra = F.array(*[unknown("target_features", x) - unknown("features", x) for x in DIMENSIONS])
    return vectors.withColumn("d", F.concat("d", extra))


def unit(vectors: DataFrame) -> DataFrame:
    """d scaled to length 1, which changes no sign; zero vectors stay."""
    norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("__n", norm).withColumn("d", F.when(F.col("__n") > 0, F.transform("d", lambda x: x / F.col("__n"))).otherwise(F.col("d"))).drop("__n")


def _margin(w):
    weights = F.array(*[F.lit(float(x)) for x in w])
    return F.aggregate(F.zip_with("d", weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def satisfied(vectors: DataFrame, w) -> int:
    """How many vectors lie on the right side of w."""
    return vectors.where(_margin(w) > 0).count()


def perceptron(vectors: DataFrame, size: int, epochs: int = 100) -> tuple[np.ndarray | None, int]:
    """(w, epochs) with w.d > 0 for every vector, or (None, epochs) if none was found.

    Each epoch adds up the vectors that w fails, one distributed aggregation; success proves that they are separable,
    failure within the epochs does not prove the contrary.
    """
    w = np.zeros(size)
    for epoch in range(1, epochs + 1):
        bad = vectors.where(_margin(w) <= 0)
        row = bad.agg(F.count("*").alias("n"), *[F.sum(F.get("d", F.lit(i))).alias(f"d{i}") for i in range(size)]).first()
        if not row["n"]:
            return w, epoch
        w = w + np.array([row[f"d{i}"] or 0.0 for i in range(size)]) / row["n"]
    return None, epochs


def logistic_fit(vectors: DataFrame, size: int, steps: int = 50, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """w that lowers the mean log(1 + exp(-w.d)) with a square penalty; what it satisfies bounds the largest satisfiable set from below."""
    w, n = np.zeros(size), max(1, vectors.count())
    for _ in range(steps):
        g, _bad = _gradient(vectors, w)
        w = w + rate * (g / n - l2 * w)
    return w


def greedy_subset(vectors: DataFrame, size: int, epochs: int = 50, steps: int = 20) -> tuple[int, np.ndarray | None]:
    """(how many, w): vectors that one w satisfies: while they are not separable, those that the fit fails worst are left out.

    Of the failed ones, the worse half go in each round, so rounds are few; at least one goes.
    """
    while True:
        n = vectors.count()
        if not n:
            return 0, None
        w, _ = perceptron(vectors, size, epochs)
        if w is not None:
            return n, w
        w = logistic_fit(vectors, size, steps)
        marked = vectors.withColumn("__m", _margin(w))
        cut = marked.where("__m <= 0").agg(F.percentile_approx("__m", 0.5, 10_000)).first()[0]
        if cut is None:
            return n, w
        vectors = stage(marked.where(F.col("__m") > cut).drop("__m"), "subset")


def _gradient(vectors: DataFrame, w: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of sigmoid(-w.d) d and the number of violated pairs: one aggregation, a row per feature to the driver."""
    weights = F.array(*[F.lit(float(x)) for x in w])
    margin = F.aggregate(F.zip_with("d", weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    z = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), margin))
    rows = vectors.withColumn("m", margin).withColumn("g", 1 / (1 + F.exp(z)))
    sums = [F.sum(F.col("g") * F.get("d", F.lit(i))).alias(f"g{i}") for i in range(len(w))]
    row = rows.agg(F.count_if(F.col("m") <= 0).alias("bad"), *sums).first()
    return np.array([row[f"g{i}"] or 0.0 for i in range(len(w))]), row["bad"]


def fit_pairwise(vectors: DataFrame, start: list[float], epochs: int = 20, rate: float = 0.5, shrink: float = 0.08) -> tuple[list[float], list[int]]:
    """Weights by full-batch logistic descent, drawn towards the start, and the violated pairs before each epoch.

    Every epoch is one distributed aggregation; only the gradient comes to the driver.
    """
    n = max(1, vectors.count())
    w0 = np.array(start, dtype=float)
    w, history = w0.copy(), []
    for _ in range(epochs):
        g, bad = _gradient(vectors, w)
        history.append(bad)
        w = w + rate * (g / n - shrink * (w - w0))
    return w.tolist(), history


def positional_join(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Rows of both sides joined by their position; raises if the sides differ in length.

    Positions are found per range partition and shifted by the counts before, so no side is gathered in one task.
    """
    if left.count() != right.count():
        raise ValueError("both sides must have as many rows")
    return with_position(left, left_order).join(with_position(right, right_order), "position")


def with_position(df: DataFrame, order: list) -> DataFrame:
    """Adds position, 0-based, in the given order."""
    ranged = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")  # partition numbers must not change between uses
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = inside.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")  # a row per partition
    return inside.join(before, "__part").withColumn("position", F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")
