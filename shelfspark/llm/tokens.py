"""Problem 8: the token ids of every text under a public byte-level BPE tokenizer.

Merge replay: each task keeps the distinct words of the records it has read.  Words not met before are laid out
as one chain of symbols, an index leads from every mergeable pair to the positions where it stands, and the merges
are applied to all words at once in rank order; a merge touches its two neighbours only, whose new pairs enter the
index.  Every merge that uses a symbol ranks after the one that made it, so one pass in rank order is enough.
Replaying per task instead of over one global table of words gives the same ids and needs no shuffle of the corpus.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Splits text into words before the merges; a fixed value of the tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words and new words that a task holds.
_KNOWN, _NEW = 500_000, 50_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str = DEFAULT_TOKENIZER) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """The id of each byte, and the merges: pair of ids -> (rank, id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    first = [0] * 256
    for letter, byte in byte_letters().items():
        first[byte] = vocab[letter]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return first, merges


def replay(words: list[bytes], first: list[int], merges: dict) -> list[list[int]]:
    """The ids of each word."""
    symbol: list[int] = []
    starts = []
    for word in words:
        starts.append(len(symbol))
        symbol.extend(first[b] for b in word)
        symbol.append(-1)  # no pair crosses it
    n = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    pair_of: dict[int, tuple] = {}
    ranks: list[int] = []

    def note(p: int, pair: tuple) -> None:
        found = merges.get(pair)
        if found is not None:
            at = index.get(found[0])
            if at is None:
                index[found[0]] = [p]
                pair_of[found[0]] = (*pair, found[1])
                heapq.heappush(ranks, found[0])
            else:
                at.append(p)

    for p in range(n - 1):
        note(p, (symbol[p], symbol[p + 1]))
    while ranks:
        rank = heapq.heappop(ranks)
        left, right, made = pair_of.pop(rank)
        for p in sorted(index.pop(rank)):
            q = after[p]
            if symbol[p] != left or symbol[q] != right:
                continue
            symbol[p], symbol[q] = made, -2
            r = after[q]
            after[p], before[r] = r, p
            o = before[p]
            if o >= 0:
                note(o, (symbol[o], made))
            note(p, (made, symbol[r]))
    out = []
    for p in starts:
        ids = []
        while symbol[p] != -1:
            ids.append(symbol[p])
            p = after[p]
        out.append(ids)
    return out


class Encoder:
    """Encodes batches of texts; remembers the words it has met, up to a bound."""

    def __init__(self, first: list[int], merges: dict):
        self.first, self.merges = first, merges
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(SPLIT)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > _KNOWN:
            self.known.clear()
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        for lo in range(0, len(new), _NEW):
            part = new[lo : lo + _NEW]
            known.update(zip(part, replay([w.encode("utf-8", "surrogatepass") for w in part], self.first, self.merges)))
        return [[i for w in words for i in known[w]] for words in cut]


def _encoded(tokenizer, counts_only: bool):
    def run(batches):
        encoder = Encoder(*tokenizer.value)
        for batch in batches:
            key = batch.column(0)
            texts = batch.column(1)
            for lo in range(0, max(1, len(texts)), 500):
                ids = encoder.encode(texts.slice(lo, 500).to_pylist())
                value = pa.array([len(i) for i in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([key.slice(lo, 500), value], names=["doc_id", "n_tokens" if counts_only else "ids"])

    return run


def _run(documents: DataFrame, path: str, counts_only: bool, result: str) -> DataFrame:
    tokenizer = documents.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary file
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(tokenizer, counts_only), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {result}")


def encode_documents(documents: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every row; a null or empty text has an empty list.  No special token is read or added."""
    return _run(documents, path, False, "ids array<int>")


def count_tokens(documents: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row; doc_id may be of any type."""
    return _run(documents, path, True, "n_tokens long")
