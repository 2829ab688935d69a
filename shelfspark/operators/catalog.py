"""The catalog as the engine sees it: one typed row per product, and statistics over all products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import CATEGORY_NOISE, DEPARTMENTS, TITLE_AUDIENCE
from ..functions.text import flat, mapped, surface_tokens
from ..session import stage

#: Repeated ids that are sent to all workers; with more, all rows are shuffled.
SENT = 200_000


def department(value: Column) -> Column:
    """The audience named by details.Department, or null."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), "[_-]", " "), r"\s+", " "))
    return F.coalesce(mapped(key, DEPARTMENTS), mapped(F.replace(key, F.lit(" "), F.lit("-")), DEPARTMENTS))


def audience_in(text: Column) -> Column:
    """The audience of the first word that names one, or null."""
    words = F.transform(F.split(F.replace(F.lower(text), F.lit("'"), F.lit(" ")), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    return F.try_element_at(F.filter(F.transform(words, lambda w: mapped(w, TITLE_AUDIENCE)), lambda g: g.isNotNull()), F.lit(1))


def category_path(levels: str | Column) -> Column:
    """Levels split at commas and trimmed; blank ones and those that say nothing left out."""
    parts = F.flatten(F.transform(F.filter(levels, lambda x: x.isNotNull()), lambda x: F.split(x, ",")))
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).isin(CATEGORY_NOISE))
    return F.coalesce(kept, F.array().cast("array<string>"))


def brand_key(store: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(store, F.lit(""))), r"[^\p{L}\p{N}]", "")


def ingest(catalog: DataFrame, keep: str = "first") -> DataFrame:
    """Rows with a parent_asin that is neither null nor blank; of repeated ids the first or the last loaded.

    Equal times go by listing_id.  A key holds copies of one product, so no group is large.
    """
    at = [F.col("loaded_at").asc_nulls_first(), F.col("listing_id")] if keep == "first" else [F.col("loaded_at").desc_nulls_last(), F.col("listing_id").desc()]
    rows = catalog.withColumn("parent_asin", F.trim("parent_asin")).where("parent_asin is not null and parent_asin <> ''")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("parent_asin").orderBy(*at))).where("__n = 1").drop("__n")


def ingest_in_place(catalog: DataFrame) -> DataFrame:
    """The same rows as ingest, first ones kept, without shuffling the wide rows if few ids repeat.

    A pass over id and time finds the ids that occur more than once.  While these are few they go to the workers, which
    drop the later rows on reading; only rows that tie are shuffled.  Runs a job.
    """
    rows = catalog.withColumn("parent_asin", F.trim("parent_asin")).where("parent_asin is not null and parent_asin <> ''")
    at = F.struct("loaded_at", "listing_id")
    times = rows.select("parent_asin", at.alias("__first")).groupBy("parent_asin", "__first").agg(F.count("*").alias("__many"))
    times = times.groupBy("parent_asin").agg(F.sum("__many").alias("__rows"), F.min_by("__many", "__first").alias("__many"), F.min("__first").alias("__first")).where("__rows > 1")
    repeated = stage(times.drop("__rows"), "repeated")
    found = repeated.agg(F.count("*"), F.max("__many")).first()
    if found[0] > SENT:
        return ingest(catalog)
    if not found[0]:
        return rows
    known = rows.join(F.broadcast(repeated), "parent_asin", "left").where(F.col("__first").isNull() | F.col("__first").eqNullSafe(at))
    alone = F.coalesce("__many", F.lit(1)) == 1
    names = rows.columns
    if found[1] == 1:
        return known.select(*names)
    return known.where(alone).select(*names).unionByName(ingest(known.where(~alone).select(*names)))


def products(catalog: DataFrame, in_place: bool = False) -> DataFrame:
    """The typed product rows; missing text is '', missing numbers are 0, a missing audience is null.

    in_place: see ingest_in_place.
    """
    base = (ingest_in_place if in_place else ingest)(catalog).select(
        F.col("listing_id").alias("doc_id"), "parent_asin", F.coalesce("title", F.lit("")).alias("title"), flat("features").alias("features_text"),
        flat("categories").alias("categories_text"), flat("description").alias("description_text"), F.coalesce("store", F.lit("")).alias("store"),
        category_path("categories").alias("category_path"), department(F.try_element_at("details", F.lit("Department"))).alias("gender"), brand_key("store").alias("brand_key"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"), F.coalesce("rating_number", F.lit(0)).alias("rating_number"),
        F.coalesce(F.array_size("features"), F.lit(0)).alias("n_features"), (F.coalesce(F.array_size("description"), F.lit(0)) > 0).alias("has_description"),
    )
    return base.withColumn("gender_fallback", F.coalesce(audience_in(F.col("title")), audience_in(F.array_join("category_path", " ")))).withColumn(
        "search_blob", F.lower(F.concat_ws(" ", "title", "features_text", "categories_text", "description_text"))
    )


def surface_counts(rows: DataFrame) -> DataFrame:
    """(token, n): unstemmed tokens of titles and categories."""
    return rows.select(F.explode(F.concat(surface_tokens("title"), surface_tokens("categories_text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def priors(rows: DataFrame, weight: float = 50.0) -> DataFrame:
    """(doc_id, popularity, quality): log counts scaled to [0, 1], and ratings shrunk to the mean of rated products."""
    log_n = F.log1p(F.col("rating_number").cast("double"))
    stats = rows.agg(F.min(log_n).alias("lo"), F.max(log_n).alias("hi"), F.coalesce(F.avg(F.when(F.col("rating_number") > 0, F.col("average_rating"))), F.lit(4.0)).alias("mean"))
    joined = rows.select("doc_id", "rating_number", "average_rating").join(F.broadcast(stats))  # one row
    span = F.when(F.col("hi") - F.col("lo") == 0, 1.0).otherwise(F.col("hi") - F.col("lo"))
    shrunk = (F.col("average_rating") * F.col("rating_number") + F.col("mean") * weight) / (F.col("rating_number") + weight)
    return joined.select("doc_id", ((log_n - F.col("lo")) / span).alias("popularity"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (shrunk - 1) / 4)).alias("quality"))
