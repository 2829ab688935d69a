"""Problem 3: map freely typed values to the entries of a reference list.

A BK-tree over the folded reference entries under the unrestricted Damerau-Levenshtein distance, which is a metric,
answers which entries lie within a threshold; the triangle inequality prunes.  Trees are searched level by level for
a whole batch of values, so the distances of a level are one array computation.  The reference may be split into
shards; every value meets every shard, and what the shards found is judged together, so that shards change no result.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest_of_wide
from ..session import stage

#: Words that sellers put around a value; fixed values.
WRAPPERS = frozenset(
    "the visit store shop brand by inc llc us official ltd co material genuine real fabric soft outer 100 col color colour tone solid 1 shade closure type with front dept department for".split()
)
#: Abbreviations and other names that no edit distance reaches; fixed values.
SYNONYMS = {
    "blk": "black", "wht": "white", "gry": "grey", "nvy": "navyblue", "navy": "navyblue", "burg": "burgundy", "chrcl": "charcoal", "emrld": "emerald",
    "olive": "olivegreen", "velcro": "hookandloop", "zip": "zipper", "snap": "magneticsnap", "ss": "stainlesssteel", "sssteel": "stainlesssteel", "ladies": "womens", "lady": "womens",
    "gents": "mens", "man": "mens", "woman": "womens", "wool": "merinowool", "leather": "fullgrainleather", "pearl": "freshwaterpearl",
    "bamboo": "bamboofiber", "steel": "stainlesssteel", "silver": "sterlingsilver",
}
#: Digits and signs typed for letters; fixed values.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "5": "s", "@": "a", "$": "s", "4": "a", "7": "t"})

#: Apostrophes and trade marks go, signs for "and" become the word.
_SIGNS = str.maketrans({"'": None, "’": None, "`": None, "&": " and ", "+": " and ", "™": " ", "®": " "})

_PARENS = re.compile(r"\(([^)]*)\)")
_PIECE = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, without accents and apostrophes."""
    text = text.lower().translate(_SIGNS)
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _pieces(text: str) -> list[str]:
    """Words; signs typed for letters are read as letters inside words that have letters."""
    text = re.sub(r"(?<=\w)[@$]|[@$](?=\w)", lambda m: m[0].translate(LOOKALIKE), text)
    return [p.translate(LOOKALIKE) if not p.isdecimal() and any(c.isdigit() for c in p) else p for p in _PIECE.findall(text)]


def forms(value: str, wrappers: frozenset = WRAPPERS) -> list[str]:
    """The strings to look up for a value: with and without wrapper words, in both word orders."""
    text = fold(value)
    inside = " ".join(_PARENS.findall(text))
    out: list[str] = []
    for part in (text, _PARENS.sub(" ", text), inside):
        pieces = _pieces(part)
        bare = [p for p in pieces if p not in wrappers]
        for words in (pieces, bare):
            for order in (words, words[::-1]):
                key = "".join(order)
                if key and key not in out:
                    out.append(key)
    return out


def allowed(length: int) -> int:
    """The edits allowed in a value of this many letters."""
    return 0 if length < 3 else 1 if length < 5 else 2


def alphabet(keys: list[str]) -> dict[str, int]:
    """The letters of the entries, numbered from 1; any other letter of a value equals none of them and shares the next number."""
    return {c: i for i, c in enumerate(sorted({c for k in keys for c in k}), 1)}


def encode(strings: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of letter numbers, as wide as the longest, and their lengths."""
    lengths = np.fromiter((len(s) for s in strings), dtype=np.int32, count=len(strings))
    codes = np.zeros((len(strings), int(lengths.max(initial=0))), dtype=np.int32)
    other = len(letters) + 1
    for i, s in enumerate(strings):
        codes[i, : lengths[i]] = [letters.get(c, other) for c in s]
    return codes, lengths


def bags(codes: np.ndarray, letters: int) -> np.ndarray:
    """How often each letter number occurs in each row."""
    out = np.zeros((len(codes), letters + 2), dtype=np.int16)
    for j in range(codes.shape[1]):
        used = np.flatnonzero(codes[:, j])
        out[used, codes[used, j]] += 1
    return out


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, letters: int) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of each row of a to the row of b beside it."""
    n, rows, cols = len(a), int(la.max(initial=0)), int(lb.max(initial=0))
    at = np.arange(n)
    far = np.int32(rows + cols + 1)
    d = np.full((rows + 2, cols + 2, n), far, dtype=np.int32)
    d[1:, 1, :] = np.arange(rows + 1, dtype=np.int32)[:, None]
    d[1, 1:, :] = np.arange(cols + 1, dtype=np.int32)[:, None]
    last_row = np.zeros((letters + 2, n), dtype=np.int32)
    for i in range(1, rows + 1):
        ca = a[:, i - 1]
        last_col = np.zeros(n, dtype=np.int32)
        for j in range(1, cols + 1):
            cb = b[:, j - 1]
            i1 = last_row[cb, at]
            same = ca == cb
            cost = np.where(same, np.int32(0), np.int32(1))
            swap = d[i1, last_col, at] + (i - i1 - 1) + 1 + (j - last_col - 1)
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + cost, np.minimum(d[i + 1, j], d[i, j + 1]) + 1), swap)
            last_col = np.where(same, np.int32(j), last_col)
        last_row[ca, at] = i
    return d[la.astype(np.int64) + 1, lb.astype(np.int64) + 1, at]


#: Cells of the distance matrices that are worked on at once.
_CELLS = 4_000_000


class BKTree:
    """A forest of BK-trees over entries (key, id), one tree for each key length; equal keys share a node.

    Only trees of lengths within the threshold are searched.  The distance to a node decides which of its children
    may hold an answer, |distance - edge| <= threshold; where the difference of the letter counts, a lower bound of
    the distance, already rules the node out, it takes the distance's place in distance - edge <= threshold.
    """

    def __init__(self, entries: list[tuple[str, int]]):
        self.ids: dict[str, list[int]] = {}
        for key, ref in entries:
            self.ids.setdefault(key, []).append(ref)
        self.keys = sorted(self.ids)
        self.letters = alphabet(self.keys)
        self.codes, self.lengths = encode(self.keys, self.letters)
        self.bags = bags(self.codes, len(self.letters))
        self.roots: dict[int, int] = {}
        at: dict[int, np.ndarray] = {}
        for length in np.unique(self.lengths).tolist():
            members = np.flatnonzero(self.lengths == length)
            self.roots[length] = int(members[0])
            at[int(members[0])] = members[1:]
        edges: list[tuple[int, int, int]] = []
        while at:
            below: dict[int, np.ndarray] = {}
            for node, members in at.items():
                if not len(members):
                    continue
                one = np.repeat(node, len(members))
                apart = self._apart(self.codes, self.lengths, one, members)
                for k in np.unique(apart).tolist():
                    group = members[apart == k]
                    edges.append((node, k, int(group[0])))
                    below[int(group[0])] = group[1:]
            at = below
        edges.sort()
        flat = np.array(edges, dtype=np.int64).reshape(-1, 3)
        self.first = np.searchsorted(flat[:, 0], np.arange(len(self.keys) + 1))
        self.edge, self.child = flat[:, 1], flat[:, 2]

    def _apart(self, codes, lengths, of, nodes) -> np.ndarray:
        """The distances of rows of codes to nodes, in runs of similar length that fit the memory."""
        out = np.zeros(len(of), dtype=np.int64)
        order = np.argsort(lengths[of] + self.lengths[nodes], kind="stable")
        while len(order):
            most = int((lengths[of[order[:5_000]]].max() + 2) * (self.lengths[nodes[order[:5_000]]].max() + 2))
            part, order = np.split(order, [max(1, min(5_000, _CELLS // most))])
            out[part] = distances(codes[of[part]], lengths[of[part]], self.codes[nodes[part]], self.lengths[nodes[part]], len(self.letters))
        return out

    def search(self, strings: list[str]) -> list[list[tuple[int, int]]]:
        """For each string every entry within allowed(): (distance, id), nearest first."""
        out: list[list[tuple[int, int]]] = [[] for _ in strings]
        longest = int(self.lengths.max(initial=0)) + 2
        asked = [i for i, x in enumerate(strings) if 0 < len(x) <= longest]  # longer ones have no entry near
        if not self.keys or not asked:
            return out
        codes, lengths = encode([strings[i] for i in asked], self.letters)
        own = bags(codes, len(self.letters))
        reach = np.array([allowed(n) for n in lengths.tolist()], dtype=np.int64)
        start = [(i, self.roots[m]) for i, (n, r) in enumerate(zip(lengths.tolist(), reach.tolist())) for m in range(n - r, n + r + 1) if m in self.roots]
        query, node = (np.array(x, dtype=np.int64) for x in zip(*start)) if start else (np.empty(0, np.int64), np.empty(0, np.int64))
        while len(query):
            next_query, next_node = [], []
            for lo in range(0, len(query), 200_000):
                q, v = query[lo : lo + 200_000], node[lo : lo + 200_000]
                gap = own[q] - self.bags[v]
                apart = np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1)).astype(np.int64)
                near = np.flatnonzero(apart <= reach[q])
                exact = np.zeros(len(q), dtype=bool)
                exact[near] = True
                apart[near] = self._apart(codes, lengths, q[near], v[near])
                for i in near[apart[near] <= reach[q[near]]].tolist():
                    out[asked[q[i]]] += [(int(apart[i]), ref) for ref in self.ids[self.keys[v[i]]]]
                many = self.first[v + 1] - self.first[v]
                parent = np.repeat(np.arange(len(q)), many)
                at = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[v], many)
                off = apart[parent] - self.edge[at]
                keep = (off <= reach[q[parent]]) & ((off >= -reach[q[parent]]) | ~exact[parent])
                next_query.append(q[parent[keep]])
                next_node.append(self.child[at[keep]])
            query, node = np.concatenate(next_query), np.concatenate(next_node)
        return [sorted(found) for found in out]


class Shard:
    """A part of the reference of one field: finds what may be meant by a value."""

    def __init__(self, entries: list[tuple[str, int]], aliases: dict[str, str], wrappers: frozenset, whole: bool):
        self.tree = BKTree(entries)
        self.aliases, self.wrappers, self.whole = aliases, wrappers, whole
        self.skeleton: dict[str, list] = {}
        for key in self.tree.keys:
            self.skeleton.setdefault(re.sub("[aeiou]", "", key), []).append(key)

    def candidates(self, values: list[str]) -> list[list[tuple[int, int, str, int]]]:
        """(rule, order, key, id) for each value: what _judge chooses from.

        rule 0: a form equals the entry; order is the form's number.  rule 1: a form is another name of the entry, its
        start (four letters or more) or its letters without the vowels (three or more); order is three times the
        form's number, plus 0, 1 or 2.  Two entries are enough to tell that a start or skeleton is ambiguous.  rule 2:
        an entry of the tree; order is its distance.  The tree is asked unless the other rules already decide, which
        rule 1 can only do in a whole reference.
        """
        keys, out = self.tree.keys, []
        open_forms: dict[str, list[int]] = {}
        for i, value in enumerate(values):
            own, found, sure = forms(value, self.wrappers), [], False
            for n, key in enumerate(own):
                if key in self.tree.ids:
                    found.append((0, n, key))
                    sure = True
                other = [self.aliases[key]] if self.aliases.get(key) in self.tree.ids else []
                at = bisect.bisect_left(keys, key)
                starts = [k for k in keys[at : at + 2] if k.startswith(key)] if len(key) >= 4 else []
                bare = self.skeleton.get(key, [])[:2] if len(key) >= 3 else []
                found += [(1, 3 * n + r, k) for r, ks in enumerate((other, starts, bare)) for k in ks]
                sure |= self.whole and 1 in (len(other), len(starts), len(bare))
            out.append([(rule, order, key, min(self.tree.ids[key])) for rule, order, key in found])
            if not sure:
                for key in own:
                    open_forms.setdefault(key, []).append(i)
        for key, near in zip(open_forms, self.tree.search(list(open_forms))):
            for i in open_forms[key]:
                out[i] += [(2, apart, "", ref) for apart, ref in near]
        return out


_FOUND = pa.schema([("field", pa.string()), ("value", pa.string()), ("rule", pa.int32()), ("order", pa.int32()), ("key", pa.string()), ("ref_id", pa.int64())])
_FOUND_DDL = "field string, value string, rule int, order int, key string, ref_id long"


def _shards(refs, aliases: dict, wrappers: frozenset, whole: bool) -> dict[str, Shard]:
    by: dict[str, list] = {}
    for field, name, ref in refs:
        by.setdefault(field, []).append(("".join(_pieces(fold(name))), ref))
    return {field: Shard(entries, aliases, wrappers, whole) for field, entries in by.items()}


def _looked_up(shards: dict[str, Shard], fields: list, values: list) -> pa.RecordBatch:
    asked: dict[str, list] = {}
    for field, value in zip(fields, values):
        if field in shards:
            asked.setdefault(field, []).append(value)
    out: list[tuple] = []
    for field, own in asked.items():
        for value, found in zip(own, shards[field].candidates(own)):
            out += [(field, value, *f) for f in dict.fromkeys(found)]
    columns = zip(*out) if out else [[] for _ in _FOUND]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _look_up(sent, aliases: dict, wrappers: frozenset):
    """For a reference that was sent to the workers whole."""

    def run(batches):
        shards = None
        for batch in batches:
            shards = shards or _shards(sent.value, aliases, wrappers, True)
            for lo in range(0, batch.num_rows, 2_000):
                yield _looked_up(shards, *(c.slice(lo, 2_000).to_pylist() for c in batch.columns))

    return run


def _look_up_shard(aliases: dict, wrappers: frozenset):
    def run(values: pa.Table, refs: pa.Table) -> pa.Table:
        shards = _shards(zip(*(refs[c].to_pylist() for c in ("field", "canonical_name", "ref_id"))), aliases, wrappers, False)
        fields, own = values["field"].to_pylist(), values["value"].to_pylist()
        parts = [_looked_up(shards, fields[lo : lo + 2_000], own[lo : lo + 2_000]) for lo in range(0, len(own), 2_000)]
        return pa.Table.from_batches(parts, schema=_FOUND)

    return run


def map_values(
    values: DataFrame, refs: DataFrame, shard_entries: int = 20_000, task_values: int = 4_000, aliases: dict | None = None, wrappers: frozenset = WRAPPERS
) -> DataFrame:
    """(field, value, ref_id, distance) of every distinct (field, value); ref_id is 0 and distance null if unmatched.

    A form equal to an entry is at distance 0.  A known other name (aliases: form -> folded entry), the start of
    exactly one entry and the skeleton of exactly one count as one edit, and come before what the tree finds within
    allowed() edits; the first form counts among equals, then the smallest id.  A reference of at most shard_entries
    rows is sent to the workers, a larger one meets the values in shards; what is exactly one entry is judged over all
    shards.  Null fields or values are left out, so are null reference names.
    """
    aliases = SYNONYMS if aliases is None else aliases
    values = stage(values.where("field is not null and value is not null").select("field", "value").distinct(), "values")
    refs = refs.where("field is not null and canonical_name is not null").select("field", "canonical_name", F.col("ref_id").cast("long").alias("ref_id"))
    number = refs.count()
    tasks = max(1, math.ceil(values.count() / task_values))
    spread = values.withColumn("task", F.pmod(F.xxhash64("value"), F.lit(tasks)))
    if number <= shard_entries:
        sent = values.sparkSession.sparkContext.broadcast([tuple(r) for r in refs.collect()])  # shard_entries rows at most
        found = spread.repartition(tasks, "task").select("field", "value").mapInArrow(_look_up(sent, aliases, wrappers), _FOUND_DDL)
    else:
        shards = math.ceil(number / shard_entries)
        spread = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        copies = refs.withColumn("shard", F.pmod(F.xxhash64("canonical_name"), F.lit(shards)).cast("int")).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)).cast("array<bigint>")))
        found = spread.groupBy("shard", "task").cogroup(copies.groupBy("shard", "task")).applyInArrow(_look_up_shard(aliases, wrappers), _FOUND_DDL)
    of_value = ["field", "value"]
    judged = found.groupBy(*of_value, "rule", "order").agg(F.count_distinct("key").alias("keys"), F.min("ref_id").alias("ref_id"))
    judged = judged.where((F.col("rule") != 1) | (F.col("order") % 3 == 0) | (F.col("keys") == 1))
    best = judged.groupBy(*of_value).agg(F.min(F.struct("rule", "order", "ref_id")).alias("b"))
    distance = F.when(F.col("b.rule") == 2, F.col("b.order")).otherwise(F.col("b.rule"))
    return values.join(best, of_value, "left").select(*of_value, F.coalesce("b.ref_id", F.lit(0)).cast("long").alias("ref_id"), distance.alias("distance"))


KEYS = ("Department", "Material", "Color", "Closure")


#: Mapped values that are sent to all workers; more are joined, hot ones salted.
SENT, SALTS = 200_000, 16


def _typed(rows: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").alias("value")) for f in ("store", *KEYS)])
    return rows.select("listing_id", F.explode(pairs).alias("x")).select("listing_id", "x.field", "x.value").where("value is not null and trim(value) <> ''")


def _columns() -> list:
    return [F.col("store").alias("v_store"), *[F.col("details")[k].alias(f"v_{k}") for k in KEYS]]


def typed_values(catalog: DataFrame) -> DataFrame:
    """(listing_id, field, value): store and the four keys of details of each distinct listing, null and blank ones left out."""
    return _typed(latest_of_wide(catalog, "listing_id", _columns()))


def mapped_listings(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """(listing_id, field, ref_id) of every typed value that is not itself a canonical name of its field.

    ref_id is 0 where no entry lies within the allowed edits.  One field has one row per listing at most.
    """
    exact = refs.select("field", F.col("canonical_name").alias("value")).distinct()
    # values of all rows, older copies among them: what is mapped in vain meets no row
    distinct = _typed(catalog.select("listing_id", *_columns())).select("field", "value").distinct().join(exact, ["field", "value"], "left_anti")
    mapped = stage(map_values(distinct, refs).select("field", "value", "ref_id"), "mapped")
    typed, on = typed_values(catalog), ["field", "value"]
    if mapped.count() <= SENT:
        return typed.join(F.broadcast(mapped), on).select("listing_id", "field", "ref_id")
    typed = typed.withColumn("salt", F.pmod(F.xxhash64("listing_id"), F.lit(SALTS)).cast("int"))
    mapped = mapped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return typed.join(mapped, [*on, "salt"]).select("listing_id", "field", "ref_id")
