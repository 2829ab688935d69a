"""Text and array functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import LOW_VALUE, STOPWORDS

#: Latin letters and digits, and the four characters that lower case into them.
TOKEN_CLASS = "[a-zA-Z0-9İıſK]+"
DROPPED = STOPWORDS + LOW_VALUE


def flat(values: str | Column) -> Column:
    """The elements of a list joined by spaces, null and empty ones left out; '' for null."""
    return F.coalesce(F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), " "), F.lit(""))


def surface_tokens(text: str | Column) -> Column:
    """Lower-case tokens of two characters or more that are no stop words, in order, repeats kept."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN_CLASS), F.lit(0)), F.lower)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: (F.length(t) > 1) & ~t.isin(DROPPED))


def stem(token: Column) -> Column:
    """The default plural rules; the first that matches wins."""
    n = F.length(token)
    cut = lambda k, end="": F.concat(F.substring(token, F.lit(1), n - k), F.lit(end))
    return (
        F.when((n > 4) & token.endswith("ies"), cut(3, "y"))
        .when((n > 4) & token.endswith("sses"), cut(2))
        .when((n > 4) & (token.endswith("ches") | token.endswith("shes") | token.endswith("xes") | token.endswith("zes")), cut(2))
        .when((n > 3) & token.endswith("s") & ~(token.endswith("ss") | token.endswith("us") | token.endswith("is")), cut(1))
        .otherwise(token)
    )


def tokens(text: str | Column) -> Column:
    return F.transform(surface_tokens(text), stem)


def bigrams(words: Column) -> Column:
    """Ordered adjacent pairs, separated by NUL."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.try_element_at(words, i), F.lit("\u0000"), F.try_element_at(words, i + 1)))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: str | Column, n: int = 4) -> Column:
    """Sliding n-grams of the letters and digits, one space around and between words."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    last = F.length(plain) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(plain, i, F.lit(n)))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def overlap(query: Column, document: Column) -> Column:
    """The share of distinct query entries that the document has; 0 for an empty query."""
    wanted = F.array_distinct(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, document)) / F.size(wanted)).otherwise(F.lit(0.0))


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The entry of a fixed map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def clean_constraint(value: Column, limit: int = 180) -> Column:
    """White space collapsed, punctuation trimmed, cut to the limit."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r"^[ \-;,.]+|[ \-;,.]+$", "")
    return F.rtrim(F.substring(plain, 1, limit))
