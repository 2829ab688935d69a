"""Problem 1: how often every distinct term occurs, in how many records, and whether that makes it useful.

Vertical layout: every task turns its records into one compressed bitmap of record identifiers per term, with a
counter of occurrences beside it.  Bitmaps of the same term and chunk of 65,536 identifiers are merged by union, and
the number of records that hold a term is the cardinality of its bitmaps.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np

from ..operators.latest import latest_of_wide
from .arrow import batch_of, words

#: Sizes in bytes at which a sorted list of 16-bit positions gives way to a bit set of 65,536 bits.
_DENSE = 8192
#: Entries (term, chunk) that a task holds before it hands them on.
_HELD = 300_000

_POSTINGS = pa.schema([("field", pa.string()), ("term", pa.string()), ("chunk", pa.int64()), ("occurrences", pa.int64()), ("bitmap", pa.binary())])


def pack(positions: np.ndarray) -> bytes:
    """A bitmap of distinct 16-bit positions: a sorted list while that is shorter, else a bit set."""
    positions = np.unique(positions.astype(np.uint16))
    if 2 * len(positions) < _DENSE:
        return positions.tobytes()
    bits = np.zeros(65_536, dtype=np.uint8)
    bits[positions] = 1
    return np.packbits(bits).tobytes()


def positions(bitmap: bytes) -> np.ndarray:
    if len(bitmap) == _DENSE:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8))).astype(np.uint16)
    return np.frombuffer(bitmap, dtype=np.uint16)


def union(a: bytes, b: bytes) -> bytes:
    if len(a) == len(b) == _DENSE:
        return np.bitwise_or(np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)).tobytes()
    return pack(np.concatenate([positions(a), positions(b)]))


def cardinality(bitmap: bytes) -> int:
    if len(bitmap) == _DENSE:
        return int.from_bytes(bitmap, "little").bit_count()
    return len(bitmap) // 2


def _vertical(batches):
    held: dict = {}

    def flush():
        rows = list(held.items())
        held.clear()
        return batch_of(
            _POSTINGS,
            field=[k[0] for k, _ in rows],
            term=[k[1] for k, _ in rows],
            chunk=[k[2] for k, _ in rows],
            occurrences=[len(v) for _, v in rows],
            bitmap=[pack(np.array(v, dtype=np.int64)) for _, v in rows],
        )

    for batch in batches:
        for record, title, levels in zip(*(c.to_pylist() for c in batch.columns)):
            chunk, at = record >> 16, record & 0xFFFF
            for term in words(title):
                held.setdefault(("title", term, chunk), []).append(at)
            for level in levels or ():
                term = level.strip(" ").lower() if level else ""
                if term:
                    held.setdefault(("categories", term, chunk), []).append(at)
        if len(held) > _HELD:
            yield flush()
    if held:
        yield flush()


def _merged(batches):
    """Rows come sorted by field, term and chunk; rows of one key follow one another, over batches too."""
    key, total, bitmap, out = None, 0, b"", []

    def given(rows):
        return batch_of(
            _CARDS, field=[r[0][0] for r in rows], term=[r[0][1] for r in rows], occurrences=[r[1] for r in rows], records=[cardinality(r[2]) for r in rows]
        )

    for batch in batches:
        for field, term, chunk, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if (field, term, chunk) == key:
                total += n
                bitmap = union(bitmap, bits)
            else:
                if key is not None:
                    out.append((key, total, bitmap))
                key, total, bitmap = (field, term, chunk), n, bits
        if len(out) > 20_000:
            yield given(out)
            out = []
    if key is not None:
        out.append((key, total, bitmap))
    if out:
        yield given(out)


_CARDS = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def term_frequencies(catalog: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(field, term, occurrences, records, mark) of every term of title and every level of categories.

    Each distinct listing_id counts once; rows without one are left out.  mark is 'rare' for at most `rare` listings,
    'common' for more than the share `common` of all listings, those without the field included, else 'useful'; a
    term that is both is 'rare'.  A null or blank title, level or list has no terms.  An empty table gives no rows.
    """
    rows = latest_of_wide(catalog.select("listing_id", "title", "categories", "loaded_at"), "listing_id", ["title", "categories"])
    postings = rows.select("listing_id", "title", "categories").mapInArrow(_vertical, "field string, term string, chunk long, occurrences long, bitmap binary")
    keys = ["field", "term", "chunk"]
    cards = postings.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged, "field string, term string, occurrences long, records long")
    n = catalog.where("listing_id is not null").agg(F.count_distinct("listing_id").alias("n"))
    return (
        cards.groupBy("field", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .join(F.broadcast(n))  # one row
        .select(
            "field", "term", "occurrences", "records",
            F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("n"), "common").otherwise("useful").alias("mark"),
        )
    )


def marked_terms(catalog: DataFrame) -> DataFrame:
    """The terms that are too rare or too common: (field, term, mark)."""
    return term_frequencies(catalog).where("mark <> 'useful'").select("field", "term", "mark")
