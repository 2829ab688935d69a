"""Customer messages as columns: what a turn says, and what a session has said so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import (
    BOILERPLATE, BROWSING_MARKERS, BUYING_MARKERS, CATEGORY_PATTERN, COLORS, LEAD_IN_PATTERN, MATERIALS, NOT_BRANDS, OVERRIDE_MARKERS, REFUSAL_PATTERN, SCAFFOLD, SIZES, SPOKEN_AUDIENCE,
    USE_CASES,
)
from ..functions.text import bigrams, mapped, tokens

SCAFFOLDING = "(?i)(" + "|".join(SCAFFOLD) + ")"
CATEGORY, LEAD_IN, REFUSAL = f"(?i){CATEGORY_PATTERN}", f"(?i){LEAD_IN_PATTERN}", f"(?i){REFUSAL_PATTERN}"


def turns(customer_turns: DataFrame) -> DataFrame:
    """One row per session and turn: of repeated ones the row loaded last; null keys left out.

    A session and turn repeat only as copies, so no group is large.
    """
    rows = customer_turns.where("session_id is not null and turn is not null").select("session_id", "turn", "user_message", "loaded_at")
    order = Window.partitionBy("session_id", "turn").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("user_message"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("session_id", "turn", F.trim(F.coalesce("user_message", F.lit(""))).alias("text"))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parse(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds is_override, refused, is_nudge, category_phrase and spans; an empty message has none of them."""
    raw = F.col(text)
    low = F.lower(raw)
    override = F.lit(False)
    for m in OVERRIDE_MARKERS:
        override = override | F.contains(low, F.lit(m))
    found = F.regexp_extract(raw, CATEGORY, 0)
    body = F.when(found != "", F.expr(f"substring({text}, instr({text}, __found) + length(__found))")).otherwise(raw)
    rest = F.col("__body")
    lead = F.regexp_extract(rest, LEAD_IN, 1)
    plain = F.regexp_replace(F.regexp_replace(rest, SCAFFOLDING, " "), r"^[ .,:;]+|[ .,:;]+$", "")
    pieces = F.when(lead != "", F.split(lead, ";")).when(plain != "", F.array(plain)).otherwise(F.array().cast("array<string>"))
    clean = F.transform(pieces, lambda p: _squeezed(F.regexp_replace(F.regexp_replace(p, SCAFFOLDING, " "), r"^[\s.,:;]+|[\s.,:;]+$", "")))
    spans = F.filter(clean, lambda p: F.length(p) > 1)
    out = rows.withColumn("__found", found).withColumn("__body", body)
    out = out.withColumn("is_override", override).withColumn("refused", F.nullif(F.lower(F.regexp_extract(raw, REFUSAL, 1)), F.lit("")))
    out = out.withColumn("is_nudge", F.contains(low, F.lit("not quite right"))).withColumn("category_phrase", _squeezed(F.regexp_replace(F.regexp_extract(raw, CATEGORY, 1), SCAFFOLDING, " ")))
    silent = F.col("refused").isNotNull() | F.col("is_nudge")
    return out.withColumn("spans", F.when(silent, F.array().cast("array<string>")).otherwise(spans)).drop("__found", "__body")


def words_of(text: Column, lexicon: list[str]) -> Column:
    """The lexicon words in a text, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(lexicon) + r")\b"), F.lit(1))))


def audience_of(text: Column) -> Column:
    """The audience a text names: boys or girls before anything else, up to and with the first adult word, else the first named."""
    named = F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: mapped(w, SPOKEN_AUDIENCE)), lambda g: g.isNotNull())
    adult = F.filter(F.transform(named, lambda g, i: F.when(~g.isin("kids", "boys", "girls"), i)), lambda i: i.isNotNull())
    upto = F.when(F.size(adult) > 0, F.slice(named, F.lit(1), F.try_element_at(adult, F.lit(1)) + 1)).otherwise(named)
    return F.coalesce(F.try_element_at(F.filter(upto, lambda g: g.isin("boys", "girls")), F.lit(1)), F.try_element_at(upto, F.lit(1)))


def slots(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds gender, materials, colors, sizes and use_cases of the text."""
    t = F.col(text)
    return rows.select("*", audience_of(t).alias("gender"), words_of(t, MATERIALS).alias("materials"), words_of(t, COLORS).alias("colors"), words_of(t, SIZES).alias("sizes"), words_of(t, USE_CASES).alias("use_cases"))


def brand_vocabulary(rows: DataFrame) -> DataFrame:
    """(surface, brand_key): each store's words; the product with the smallest doc_id names a surface."""
    words = F.regexp_extract_all(F.lower(F.trim("store")), F.lit("[a-z0-9]+"), F.lit(0))
    named = rows.where("trim(store) <> '' and brand_key <> ''").select("doc_id", "brand_key", words.alias("w")).where(F.size("w") > 0)
    kept = named.where((F.size("w") > 1) | ((F.length(F.element_at("w", 1)) >= 4) & ~F.element_at("w", 1).isin(NOT_BRANDS)))
    return kept.groupBy(F.array_join("w", " ").alias("surface")).agg(F.min_by("brand_key", "doc_id").alias("brand_key"))


def common_names(vocabulary: DataFrame, commonness: DataFrame, most: float) -> DataFrame:
    """The vocabulary without one-word names more common than `most` as ordinary words of listings.

    commonness: (term, commonness), see lexical.commonness; a name weighs as its most common term.
    """
    single = vocabulary.where(~F.contains("surface", F.lit(" "))).select("surface", F.explode(tokens("surface")).alias("term"))
    often = single.join(commonness, "term").where(F.col("commonness") > most).select("surface").distinct()
    return vocabulary.join(often, "surface", "left_anti")


def brand_mentions(texts: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """(key..., brand_key): brands whose name of at most four words occurs in the text."""
    w = F.col("w")
    n = F.size(w)

    def runs(k: int) -> Column:
        names = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(n >= k, names).otherwise(F.array().cast("array<string>"))

    grams = [runs(k) for k in (1, 2, 3, 4)]
    said = texts.select(*key, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).select(*key, F.explode(F.array_distinct(F.concat(*grams))).alias("surface"))
    return said.join(vocabulary, "surface").select(*key, "brand_key").distinct()


def category_mentions(texts: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., level): category levels all of whose terms occur in the text; levels of four letters or more.

    An equi-join on the term and a count replace the containment test of every level against every text.
    """
    levels = rows.select(F.explode("category_path").alias("level")).select(F.lower("level").alias("level")).distinct().where(F.length("level") > 3)
    parts = levels.select("level", F.array_distinct(tokens("level")).alias("terms")).where(F.size("terms") > 0)
    wanted = parts.select("level", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    said = texts.select(*key, F.explode(F.array_distinct(tokens("text"))).alias("term"))
    hits = said.join(wanted, "term").groupBy(*key, "level", "need").agg(F.count("*").alias("have"))
    return hits.where("have = need").select(*key, "level")


def live_spans(said: Column) -> Column:
    """Phrases as they are looked for in listings: lower case, distinct, 'color: ' taken off, more than three letters."""
    lowered = F.filter(F.transform(said, lambda x: F.lower(_squeezed(x))), lambda x: F.length(x) > 3)
    bare = F.transform(lowered, lambda x: F.when(x.rlike("^color:"), F.trim(F.regexp_replace(x, "^color:", ""))).otherwise(x))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def session_texts(parsed: DataFrame) -> DataFrame:
    """Per session and turn: all spans and category phrases up to the turn, lower case and in order."""
    so_far = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)  # a session has few turns
    said = F.flatten(F.collect_list("spans").over(so_far))
    phrase = F.first(F.nullif("category_phrase", F.lit("")), ignorenulls=True).over(so_far)
    lowered = F.transform(said, lambda x: F.lower(_squeezed(x)))
    live = F.array_distinct(F.filter(F.transform(lowered, lambda x: F.when(x.rlike("^color: ?.+"), F.trim(F.regexp_replace(x, "^color:", ""))).otherwise(x)), lambda x: F.length(x) > 3))
    return parsed.select("session_id", "turn", live.alias("spans"), F.coalesce(phrase, F.lit("")).alias("category_phrase"), F.concat_ws(" . ", said, phrase).alias("text"))


def query_columns(rows: DataFrame) -> DataFrame:
    """Adds query_terms, query_bigrams and category_terms, template words left out."""
    live = lambda c: F.filter(tokens(c), lambda t: ~t.isin(BOILERPLATE))
    pairs = F.concat(F.flatten(F.transform("spans", lambda x: bigrams(live(x)))), bigrams(live("category_phrase")))
    terms = F.concat(F.flatten(F.transform("spans", lambda x: live(x))), live("category_phrase"))
    return rows.select("*", F.array_distinct(terms).alias("query_terms"), F.array_distinct(pairs).alias("query_bigrams"), F.array_distinct(live("category_phrase")).alias("category_terms"))


def marker_score(text: Column) -> Column:
    """0.5 and a quarter for each buying marker less each browsing marker in the text, within [0, 1]."""
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.25 * (hits(BUYING_MARKERS) - hits(BROWSING_MARKERS))))
