"""The weak baseline: stateless BM25 over six weighted columns, without stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import plain_lists

# Words left out of queries and texts, and the columns with their weights; fixed values.
STOPWORDS = "a an and are as at be but by for from i in is it me my of on or please some that the this to want with would you looking".split()
COLUMNS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Letters and digits in lower case, of two characters or more, without stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def column_texts(listings: DataFrame) -> DataFrame:
    """doc_id and the words of each column of ingested listings; details as 'key value' in the order of keys."""
    details = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    text = {"title": F.col("title"), "categories": F.concat_ws(" ", "categories"), "features": F.concat_ws(" ", "features"), "details": details, "store": F.col("store"), "description": F.concat_ws(" ", "description")}
    return listings.select(F.col("listing_id").cast("long").alias("doc_id"), *[terms(text[c]).alias(c) for c in COLUMNS])


def search(listings: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, text): any of the first 40 distinct terms may match.

    A term's frequency is weighted by column; its rarity counts documents with the term in any column.
    """
    words = column_texts(listings)
    asked = queries.select("query_id", F.slice(F.array_distinct(terms(F.col("text"))), 1, 40).alias("terms"))
    return plain_lists(words, list(COLUMNS.values()), asked, depth, K1, B)
