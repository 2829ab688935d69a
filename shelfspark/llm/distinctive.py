"""Problem 2: how typical a term is of a record compared with the whole collection.

Graph-of-words weighting: within a record, every word is linked with the words at most `window - 1` places after it.
The weight of a term is the number of its distinct neighbours in place of its frequency, times its rarity in the
collection, ln((records + 1) / records that hold it).  Records' texts go through the workers once; a term's record
counts and its postings meet in one shuffle, on which common terms carry a count only.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest_of_wide
from ..session import stage
from .arrow import batch_of, words

#: Terms that a task holds before it hands their counts on.
_HELD = 150_000

_POSTING = pa.struct([("listing_id", pa.int64()), ("tf", pa.int64()), ("degree", pa.int64())])
_TERMS = pa.schema([("term", pa.string()), ("records", pa.int64()), ("postings", pa.list_(_POSTING)), ("too_common", pa.bool_())])
_SCORED = pa.schema([("listing_id", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("degree", pa.int64())])


def degrees(tokens: list[str], wanted, window: int) -> dict[str, int]:
    """The number of distinct neighbours, itself left out, of each wanted term."""
    near: dict[str, set] = {t: set() for t in wanted}
    reach = window - 1
    for i, t in enumerate(tokens):
        if t in near:
            near[t].update(tokens[max(0, i - reach) : i + reach + 1])
    return {t: len(s - {t}) for t, s in near.items()}


def _rare_postings(window: int, min_tf: int, max_records: int):
    """Per task: each term's record count, and its postings while it may still be rare enough."""

    def run(batches):
        held: dict[str, list] = {}

        def flush():
            rows = list(held.items())
            held.clear()
            return batch_of(_TERMS, term=[t for t, _ in rows], records=[v[0] for _, v in rows], postings=[v[1] if v[0] <= max_records else None for _, v in rows], too_common=[v[0] > max_records for _, v in rows])

        for batch in batches:
            for listing, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = words(text)
                counts = Counter(tokens)
                often = []
                for term, tf in counts.items():
                    entry = held.get(term)
                    if entry is None:
                        entry = held[term] = [0, []]
                    entry[0] += 1
                    if tf >= min_tf and entry[0] <= max_records:
                        often.append((term, tf, entry))
                if often:
                    degree = degrees(tokens, [o[0] for o in often], window)
                    for term, tf, entry in often:
                        entry[1].append((listing, tf, degree[term]))
            if len(held) > _HELD:
                yield flush()
        if held:
            yield flush()

    return run


def _counts(batches):
    """Per task: (term, records)."""
    schema = pa.schema([("term", pa.string()), ("records", pa.int64())])
    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            held.update(set(words(text)))
        if len(held) > _HELD:
            yield batch_of(schema, term=list(held), records=list(held.values()))
            held.clear()
    if held:
        yield batch_of(schema, term=list(held), records=list(held.values()))


def _some_postings(window: int, common, take_common: bool):
    """The terms of every record that are among the common ones, with their counts, or those that are not."""
    schema = pa.schema([*_SCORED, ("records", pa.int64())])

    def run(batches):
        known = common.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                ids, terms, tfs, degs = [], [], [], []
                for listing, text in zip(*(c.slice(lo, 500).to_pylist() for c in batch.columns)):
                    tokens = words(text)
                    tf = Counter(tokens)
                    own = [t for t in tf if (t in known) == take_common]
                    degree = degrees(tokens, own, window)
                    ids += [listing] * len(own)
                    terms += own
                    tfs += [tf[t] for t in own]
                    degs += [degree[t] for t in own]
                if ids:
                    yield batch_of(schema, listing_id=ids, term=terms, tf=tfs, degree=degs, records=[known[t] for t in terms] if take_common else [None] * len(ids))

    return run


def _texts(catalog: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "title", "features", "description").alias("text")
    return latest_of_wide(catalog, "listing_id", [text])


def _records(catalog: DataFrame) -> DataFrame:
    return catalog.where("listing_id is not null").agg(F.count_distinct("listing_id").alias("n"))


def _score() -> Column:
    return F.round(F.col("degree") * F.log((F.col("n") + 1) / F.col("records")), 6).alias("score")


def term_scores(catalog: DataFrame, window: int = 4) -> DataFrame:
    """(listing_id, term, tf, records, degree, score) of every term of every listing's title, features, description.

    Each distinct listing_id counts once.  Null or blank texts have no terms; a single word has degree 0 and score 0.
    Terms of more than a thousandth of the listings (and more than 1,000) are at most a thousand times as many as the
    mean listing has terms, whatever the collection's size: their counts go to the workers, and only rarer terms are
    shuffled and joined, so that no hot term gathers in one task.
    """
    texts = _texts(catalog)
    n = catalog.where("listing_id is not null").agg(F.count_distinct("listing_id")).first()[0]
    stats = stage(texts.mapInArrow(_counts, "term string, records long").groupBy("term").agg(F.sum("records").alias("records")), "terms")
    common = {t: c for t, c in stats.where(F.col("records") > max(1000, n / 1000)).collect()}
    sent = catalog.sparkSession.sparkContext.broadcast(common)
    ddl = "listing_id long, term string, tf long, degree long, records long"
    parts = [texts.mapInArrow(_some_postings(window, sent, True), ddl)]
    rare = stats.where(F.col("records") <= max(1000, n / 1000))
    parts.append(texts.mapInArrow(_some_postings(window, sent, False), ddl).drop("records").join(rare, "term"))
    columns = ["listing_id", "term", "tf", "records", "degree"]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns)).withColumn("n", F.lit(n)).select(*columns, _score())


def rare_repeated_terms(catalog: DataFrame, window: int = 4, min_tf: int = 3, max_records: int = 5) -> DataFrame:
    """term_scores of the terms that a listing holds at least min_tf times and at most max_records listings hold.

    The counts cover every term of every listing; only the postings of terms that a task has already seen in more
    records than max_records are dropped there, as they cannot qualify.
    """
    terms = _texts(catalog).mapInArrow(
        _rare_postings(window, min_tf, max_records), "term string, records long, postings array<struct<listing_id: long, tf: long, degree: long>>, too_common boolean"
    )
    return (
        terms.groupBy("term")
        .agg(F.sum("records").alias("records"), F.flatten(F.collect_list("postings")).alias("postings"), F.max("too_common").alias("too_common"))
        .where((F.col("records") <= max_records) & ~F.col("too_common") & (F.size("postings") > 0))
        .select("term", "records", F.explode("postings").alias("p"))
        .join(F.broadcast(_records(catalog)))
        .select(F.col("p.listing_id").alias("listing_id"), "term", F.col("p.tf").alias("tf"), "records", F.col("p.degree").alias("degree"), "n")
        .select("listing_id", "term", "tf", "records", "degree", _score())
    )
