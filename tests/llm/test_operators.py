"""The operators for training data: edge cases, ties, empty tables, clashing columns, and brute force on small random inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import canonical, components, consensus, distinctive, frequency, mixing, neardup, repetition, sameitem, tokens
from shelfspark.llm.arrow import words
from shelfspark.llm.itemparts import Parser

EDGE = [
    {},
    {"listing_id": None, "title": "no id"},
    {"listing_id": 1, "title": None, "features": None, "description": None, "categories": None, "details": None, "store": None},
    {"listing_id": 2, "title": "", "features": [], "description": [None, ""], "categories": [None, "", "  "], "details": {}, "store": "  "},
    {"listing_id": 3, "title": "word " * 60_000, "features": ["long " * 30_000]},
]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- 1: frequencies

def test_bitmaps_union_and_cardinality():
    rng = random.Random(1)
    for size in (0, 1, 100, 4095, 4097, 30_000):
        a, b = ({rng.randrange(65_536) for _ in range(size)} for _ in range(2))
        pa, pb = (frequency.pack(np.array(sorted(x), dtype=np.int64)) for x in (a, b))
        assert set(frequency.positions(pa).tolist()) == a
        both = frequency.union(pa, pb)
        assert frequency.cardinality(both) == len(a | b) and set(frequency.positions(both).tolist()) == a | b


def test_term_frequencies_on_edges(spark, catalog):
    rows = [*EDGE, {"listing_id": 4, "title": "Red red É", "categories": [" Hats ", "hats", "Tops"]}, {"listing_id": 4, "title": "Red red É", "categories": [" Hats ", "hats", "Tops"]}, {"listing_id": -70_000, "title": "red"}]
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in frequency.term_frequencies(catalog(rows)).collect()}
    assert got[("title", "red")] == (3, 2, "rare") and got[("title", "é")] == (1, 1, "rare")
    assert got[("categories", "hats")] == (2, 1, "rare") and got[("title", "word")] == (60_000, 1, "rare")
    assert frequency.term_frequencies(catalog(rows).where("false")).count() == 0


def test_common_counts_all_listings(catalog):
    rows = [{"listing_id": i, "title": "common" if i < 4 else None} for i in range(10)]
    assert rows_of(frequency.marked_terms(catalog(rows))) == [("title", "common", "common")]


# ---- 2: distinctive terms

def brute_scores(texts, window=4):
    df = Counter(t for x in texts.values() for t in set(words(x)))
    out = {}
    for i, x in texts.items():
        w = words(x)
        for t, tf in Counter(w).items():
            near = {w[b] for a in range(len(w)) if w[a] == t for b in range(max(0, a - window + 1), min(len(w), a + window))} - {t}
            out[i, t] = (tf, df[t], len(near), round(len(near) * np.log((len(texts) + 1) / df[t]), 6))
    return out


def test_scores_equal_brute_force(catalog):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for i in range(30)}
    table = catalog([{"listing_id": i, "title": t} for i, t in texts.items()])
    want = brute_scores(texts)
    got = {(r["listing_id"], r["term"]): (r["tf"], r["records"], r["degree"], r["score"]) for r in distinctive.term_scores(table).collect()}
    assert got.keys() == want.keys() and all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-5 for k in want)
    rare = {(r["listing_id"], r["term"]): r["degree"] for r in distinctive.rare_repeated_terms(table, min_tf=3, max_records=9).collect()}
    assert rare == {k: v[2] for k, v in want.items() if v[0] >= 3 and v[1] <= 9}


def test_distinctive_edges(catalog):
    got = rows_of(distinctive.rare_repeated_terms(catalog(EDGE)).select("listing_id", "term", "tf"))
    assert got == [(3, "long", 30_000), (3, "word", 60_000)]
    assert distinctive.term_scores(catalog(EDGE).where("false")).count() == 0


# ---- 3: canonical names

REFS = [(1, "store", "Drearkflesh"), (2, "store", "Klathbourk & Sons"), (3, "Color", "Navy Blue"), (4, "Color", "Black"), (5, "Material", "Bamboo Fiber"), (6, "Closure", "Hook and Loop"), (7, "Department", "womens"), (8, "Department", "mens"), (9, "store", "Pleshjan Old Trading")]


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([*REFS, (10, None, "x"), (11, "Color", None)], "ref_id long, field string, canonical_name string").withColumn("value", F.lit("clash"))


@pytest.mark.parametrize(
    "field, value, want",
    [("store", "DREARKFLESH Inc.", 1), ("store", "Visit the Drearkfelsh Store", 1), ("store", "Sons & Klathbourk", 2), ("store", "Klathbourk_&_Sons", 2), ("store", "Pleshjan", 9), ("store", "Somebody Else", 0),
     ("Color", "col. navy blue", 3), ("Color", "blk", 4), ("Color", "Bl@ck", 4), ("Material", "100% Bambo Fibre", 5), ("Closure", "HookandLoop closure", 6), ("Department", "Women's", 7), ("Department", "MEN", 8), ("Department", "???", 0), ("Color", "é" * 500, 0)],
)
def test_mapping(spark, refs, field, value, want):
    values = spark.createDataFrame([(field, value), (field, value), (None, value), (field, None)], "field string, value string")
    assert rows_of(canonical.map_values(values, refs).select("value", "ref_id")) == [(value, want)]


def test_mapping_is_the_same_over_shards(spark, refs):
    values = spark.createDataFrame([(f, n[:-1] + "x") for _, f, n in REFS], "field string, value string")
    assert rows_of(canonical.map_values(values, refs)) == rows_of(canonical.map_values(values, refs, shard_entries=2, task_values=2))


@pytest.mark.parametrize("entries", [1, 2, 7])
def test_what_is_one_entry_is_judged_over_all_shards(spark, entries):
    names = ["bluebell", "bluebird", "crimson", "grn", "green", "amber", "teal", "umber", "wool", "linen", "cotton", "silk", "rayon", "nylon"]
    refs = spark.createDataFrame([(i + 1, "Color", n) for i, n in enumerate(names)], "ref_id long, field string, canonical_name string")
    values = spark.createDataFrame([("Color", v) for v in ("blueb", "crims", "grn", "crmsn", "umbr", "ambr", "ttttt", "cottn")], "field string, value string")
    got = {r["value"]: (r["ref_id"], r["distance"]) for r in canonical.map_values(values, refs, shard_entries=entries, task_values=3).collect()}
    assert got == {r["value"]: (r["ref_id"], r["distance"]) for r in canonical.map_values(values, refs).collect()}
    assert got["blueb"] == (0, None) and got["crims"] == (3, 1) and got["grn"] == (4, 0)


def test_long_and_foreign_values_are_compared_whole(spark):
    refs = spark.createDataFrame([(1, "store", "a" * 40 + "bbbb"), (2, "store", "一" * 5), (3, "store", "c" * 300)], "ref_id long, field string, canonical_name string")
    values = spark.createDataFrame([("store", "a" * 40 + "q" * 20), ("store", "严" * 5), ("store", "一" * 4 + "严"), ("store", "c" * 299 + "x"), ("store", "z" * 200_000)], "field string, value string")
    got = {r["value"]: r["ref_id"] for r in canonical.map_values(values, refs).collect()}
    assert list(got.values()).count(0) == 3 and got["一" * 4 + "严"] == 2 and got["c" * 299 + "x"] == 3


def test_tree_equals_brute_force():
    rng = random.Random(3)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    tree = canonical.BKTree([(n, i) for i, n in enumerate(names[:150])])
    asked = names[150:]
    for text, got in zip(asked, tree.search(asked)):
        c, n = canonical.encode([text] * len(tree.keys), tree.letters)
        apart = canonical.distances(c, n, tree.codes, tree.lengths, len(tree.letters)).tolist()
        assert got == sorted((d, i) for d, k in zip(apart, tree.keys) for i in tree.ids[k] if d <= canonical.allowed(len(text)))


def test_swaps_count_as_one_edit_and_edges(catalog, refs):
    letters = canonical.alphabet(["abcdxy"])
    a, n = canonical.encode(["ab", "ca", "abcd", ""], letters)
    b, m = canonical.encode(["ba", "abc", "acbd", "xy"], letters)
    assert canonical.distances(a, n, b, m, len(letters)).tolist() == [1, 2, 1, 2]
    rows = [*EDGE, {"listing_id": 5, "store": "Drearkflesh", "details": {"Color": "black"}}, {"listing_id": 6, "store": "drearkflesh "}]
    assert rows_of(canonical.mapped_listings(catalog(rows), refs)) == [(5, "Color", 4), (6, "store", 1)]
    assert canonical.mapped_listings(catalog(rows).where("false"), refs).count() == 0
    assert rows_of(canonical.mapped_listings(catalog(rows), refs.where("false")))[0] == (5, "Color", 0)


# ---- 5: consensus

LISTS = "session_id string, turn int, item string, x double, y double"


def test_ranks_do_not_feel_outliers_and_long_lists_are_cut_alike(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("s", 1, f"i{i}", rng.choice([1.0, 2.0, 1e12, None, rng.random()]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, LISTS)
    whole = rows_of(consensus.rank_scores(df, ["session_id", "turn"], "item", {"x": 1, "y": -1}))
    monkeypatch.setattr(consensus, "LONG_LIST", 10)
    assert rows_of(consensus.rank_scores(df, ["session_id", "turn"], "item", {"x": 1, "y": -1})) == whole
    x = [r[3] or 0.0 for r in rows]
    want = {r[2]: (sum(v < (r[3] or 0.0) for v in x) + (sum(v == (r[3] or 0.0) for v in x) + 1) / 2) / 300 for r in rows}
    assert all(abs(r[3] - want[r[2]]) < 1e-9 for r in whole)


def test_component_is_oriented_and_ties_go_by_item(spark):
    rows = [("s", 1, "b", 1.0, 5.0), ("s", 1, "a", 1.0, 5.0), ("s", 1, "c", 0.0, 0.0), ("s", 1, "c", 0.0, 0.0), ("t", 1, "z", None, None), ("t", 1, None, 1.0, 1.0)]
    got = consensus.placed(consensus.consensus_ranking(spark.createDataFrame(rows, LISTS), ["session_id", "turn"], "item", {"x": 1, "y": 1}), ["session_id", "turn"], "item")
    assert [(r["session_id"], r["item"]) for r in got.orderBy("session_id", "place").collect()] == [("s", "a"), ("s", "b"), ("s", "c"), ("t", "z")]
    empty = spark.createDataFrame([], LISTS)
    assert consensus.consensus_ranking(empty, ["session_id", "turn"], "item", {"x": 1, "y": 1}).count() == 0
    loads = consensus.first_component(spark.createDataFrame([(0.1, 0.9), (0.5, 0.5), (0.9, 0.1)], "r_x double, r_y double"), ["x", "y"])
    assert all(v > 0 for v in loads.values())


def test_leaders(spark, catalog):
    rows = [{"listing_id": i, "parent_asin": a, "rating_number": n, "average_rating": r} for i, (a, n, r) in enumerate([("A", 10**9, 1.0), ("B", 50, 4.0), ("C", None, None)])]
    cands = spark.createDataFrame([("s", 1, "A", 1.0, 0.1), ("s", 1, "B", 2.0, 0.9), ("s", 1, "B", 2.0, 0.9), ("s", 1, "C", None, 0.5), ("s", 2, "Q", None, None)], "session_id string, turn int, candidate_asin string, bm25 double, fused double")
    assert rows_of(consensus.leaders(cands, catalog(rows))) == [("s", 1, "B"), ("s", 2, "Q")]


# ---- 6: same items

ITEM = [
    {"listing_id": 1, "title": "Drearkflesh Navje Saile leggings, SKY BLUE, Linen, 74.9 cm, Best Gift Idea", "store": "Drearkflesh"},
    {"listing_id": 2, "title": "Must Have Stretch Leggings NAVJE-SAILE by Drearkflesh (29.5 in) (Linen)", "store": "Some Reseller", "features": ["Color: sky blue", "1 piece"]},
    {"listing_id": 3, "title": "Drearkflesh Navje Saile leggings Linen sky blue 749 mm", "store": "Drearkflesh", "features": ["Includes: 2-pack"]},
    {"listing_id": 4, "title": "Drearkflesh Navje Saile leggings Cotton sky blue 749 mm", "store": "Drearkflesh"},
    {"listing_id": 5, "title": "Drearkflesh Navje Saile leggings Linen black 749 mm", "store": "Drearkflesh"},
    {"listing_id": 6, "title": "Drearkflesh Navje Saile hoodie Linen sky blue 749 mm", "store": "Drearkflesh"},
    {"listing_id": 7, "title": "Model QX14386 Belt Linen black 30 in", "store": "Drearkflesh"},
    {"listing_id": 8, "title": "belt linen BLK 76.2cm qx-14386", "store": "Drearkflesh"},
    {"listing_id": 9, "title": "belt linen BLK 76.2cm qx-14387", "store": "Drearkflesh"},
]


@pytest.fixture
def item_refs(spark):
    rows = [(1, "store", "Drearkflesh"), (2, "Color", "Sky Blue"), (3, "Color", "Black"), (4, "Material", "Linen"), (5, "Material", "Cotton")]
    return spark.createDataFrame(rows, "ref_id long, field string, canonical_name string")


def test_same_items(catalog, item_refs):
    copies = [ITEM[0] | {"listing_id": i} for i in (20, 21)]
    got = rows_of(sameitem.same_item_pairs(catalog([*ITEM, *copies, ITEM[0], *(e | {"listing_id": 900 + k} for k, e in enumerate(EDGE))]), item_refs))
    group = [1, 2, 20, 21]
    assert got == sorted([(a, b) for a in group for b in group if a < b] + [(7, 8)], key=str)
    assert sameitem.same_item_pairs(catalog(ITEM).where("false"), item_refs).count() == 0


@pytest.mark.parametrize("code", ["", "QX14386 "])
def test_a_model_of_many_sizes_keeps_the_pair_of_one_size(catalog, item_refs, code):
    # the terms of the model are held by 31 listings, of which two are of one item
    sizes = [{"listing_id": k, "title": f"Drearkflesh Navje Saile {code}leggings Linen {100 * k} mm", "store": "Drearkflesh"} for k in range(1, 31)]
    other = {"listing_id": 50, "title": f"Drearkflesh Navje Saile Tovarn {code}leggings Linen 1000 mm", "store": "Some Reseller"}
    assert rows_of(sameitem.same_item_pairs(catalog([*sizes, other]), item_refs)) == [(10, 50)]


def test_large_groups_hang_on_their_smallest_id(catalog, item_refs, monkeypatch):
    monkeypatch.setattr(sameitem, "EXPANDED", 2)
    got = rows_of(sameitem.same_item_pairs(catalog([ITEM[0], ITEM[1], ITEM[0] | {"listing_id": 20}]), item_refs))
    assert got == [(1, 2), (1, 20)]


@pytest.mark.parametrize("salted", [500, 5])
def test_differently_worded_listings_of_an_item_are_paired_in_full(spark, monkeypatch, salted):
    monkeypatch.setattr(sameitem, "SALTED", salted, raising=False)
    members = spark.createDataFrame([(i, i) for i in range(1, 201)], "class long, listing_id long")
    links = spark.createDataFrame([(1, i) for i in range(2, 201)], "a long, b long")
    monkeypatch.setattr(sameitem, "same_item_links", lambda *_: (links, members))
    assert rows_of(sameitem.same_item_pairs(None, None)) == sorted([(a, b) for a in range(1, 201) for b in range(a + 1, 201)], key=str)


def test_parser_reads_units_and_counts():
    p = Parser({"Color": ["Navy Blue"], "Material": ["Full Grain Leather"], "store": []})
    r = p.parse('Zaif Korv Rain Coat 12" navy, set of two', None, ["crafted in Full Grain Leather", "weighs 12 oz"])
    assert (r["kind"], r["color"], r["material"], r["length"], r["count"], r["names"]) == ("raincoat", "navyblue", "fullgrainleather", 24, 2, ["zaif", "korv"])
    assert p.parse(None, None, None)["count"] == 1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert components.components(links.where("false")).count() == 0


# ---- 7: near duplicates

def jaccard(a, b, width):
    x, y = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("width, threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, width, threshold):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(0, 240, 4):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for k in range(4):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[i + k] = " ".join(w)
    texts |= {900: None, 901: "", 902: "short text", 903: texts[0], 904: texts[0].upper()}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] * 2, "listing_id long, text string").withColumn("loaded_at", F.current_timestamp()).withColumn("class", F.lit("clash"))
    links, members = neardup.similar_texts(df, width, threshold, 40)
    got = set(rows_of(neardup.similar_pairs(links, members)))
    full = {i: t for i, t in texts.items() if t and len(words(t)) >= 40}
    want = {(a, b) for a in full for b in full if a < b and jaccard(full[a], full[b], width) >= threshold}
    assert got <= want and len(got) >= 0.99 * len(want) and {(0, 903), (0, 904), (903, 904)} <= got


def _family(rng, n, others, vocabulary):
    """Texts of which a third are edited copies of one text, and the rest are unlike."""
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = {}
    for i in range(n):
        w = list(base) if i < n - others else [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.randint(2, 6)):
            w[rng.randrange(60)] = rng.choice(vocabulary)
        texts[i] = " ".join(w)
    return texts


@pytest.mark.parametrize("salted", [2048, 16])
def test_a_family_of_a_third_of_the_texts_is_found_whole(spark, monkeypatch, salted):
    monkeypatch.setattr(neardup, "SALTED", salted, raising=False)
    texts = _family(random.Random(9), 240, 160, [f"w{i}" for i in range(5000)])
    df = spark.createDataFrame(list(texts.items()), "listing_id long, text string").withColumn("loaded_at", F.current_timestamp())
    got = set(rows_of(neardup.similar_pairs(*neardup.similar_texts(df, 3, 0.5, 40))))
    assert got == {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b], 3) >= 0.5}


def test_copies_do_not_make_their_shingles_common(spark):
    texts = [" ".join(f"w{i}" for i in range(60))] * 500 + [" ".join(f"{k}v{i}" for i in range(60)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "listing_id long, text string").withColumn("loaded_at", F.current_timestamp()).coalesce(1)
    profile = df.select("listing_id", "loaded_at", "text").mapInArrow(neardup._profile(3, 40, 1 << 16), "listing_id long, loaded_at timestamp, class long, n int, sketch array<long>, part long, counts binary")
    count, rarity = neardup.rarity_table(profile, 1 << 16)
    assert count == 21 and (rarity > 0).all()


def test_names_are_packed_small_and_whole():
    part_bits, rest_bits = neardup.name_bits(200_000)
    draw = np.random.default_rng(1)
    names, classes = (draw.integers(0, 1 << 64, 300_000, dtype=np.uint64) for _ in range(2))
    names[1000:2000] = names[:1000]  # names of several holders
    parts = list(neardup.packed(names, classes, part_bits, rest_bits))
    assert sum(len(steps) + len(own) for _, steps, own in parts) < 8 * len(names)  # a row of name and class has 16 bytes
    got = {(part << rest_bits | int(x) >> 32, int(x) & 0xFFFFFFFF) for part, steps, own in parts for x in neardup.unpacked(steps, own)}
    assert got == set(zip((names >> np.uint64(64 - part_bits - rest_bits)).tolist(), (classes & np.uint64(0xFFFFFFFF)).tolist()))


def test_near_duplicate_edges(catalog):
    assert neardup.near_duplicate_listings(catalog(EDGE)).count() == 0
    assert neardup.near_duplicate_listings(catalog(EDGE).where("false")).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(1, 1 << 54, 120).astype(np.uint64)) << np.uint64(10)
    b = np.unique(np.r_[a[:90], rng.integers(1, 1 << 54, 20).astype(np.uint64) << np.uint64(10)])
    s = [neardup._sketches(np.array([0]), x)[0] for x in (a, b)]
    apart = sum(int(x ^ y).bit_count() if x ^ y >= 0 else (int(x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*map(list, s)))
    assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


# ---- 8: token ids

def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokens.DEFAULT_TOKENIZER)
    library.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["", "a", "aaaaaaaaaaa", "<|endoftext|>", "it's 12345  \n\t x", "日本語 ñ é", "x" * 200_000] + ["".join(rng.choice("ab é\n's12日<|>") for _ in range(80)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(-1, None, "x"), (None, "hi", "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_documents(df).collect()}
    assert got.pop(-1) == [] and got.pop(None) == library.encode("hi").ids
    assert got == {i: e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    assert tokens.encode_documents(df.where("false")).count() == 0


# ---- 9: mixing

def test_mix_meets_weights_and_caps(spark):
    rows = [(i, "big", f"text number {i} with some words") for i in range(300)] + [(1000 + i, "small", f"small {i}") for i in range(20)] + [(2000, "small", "small 3"), (2001, "none", "x"), (2002, None, "y"), (2003, "big", None), (2004, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 5), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    assert rows_of(mixing.unreachable_sources(docs, targets)) == [("absent",), ("small",)]
    report = {r["source"]: r for r in mixing.mixing_report(docs, targets).collect()}
    assert set(report) == {"big", "small", "absent"} and report["absent"]["used_tokens"] == 0
    mix = mixing.mixture(mixing.sized_documents(docs), targets).collect()
    used = Counter(r["doc_id"] for r in mix)
    assert max(used.values()) <= 3 and all(used[i] <= 1 for i in range(300)) and 2000 not in used and used[1003] == 3
    assert all(0 <= r["position"] <= 1 for r in mix) and [r["position"] for r in mix] == sorted(r["position"] for r in mix)
    big = sum(r["n_tokens"] for r in mix if r["source"] == "big")
    assert abs(big - report["big"]["demand"]) <= 12 and abs(sum(r["share"] for r in report.values()) - 1) < 1e-5
    assert mixing.mixing_report(docs.where("false"), targets).count() == 3
    assert mixing.mixing_report(docs, targets.where("false")).count() == 0


def test_texts_of_several_sources_are_dealt_by_demand(spark):
    # b has no text of its own, c shares some with a and has few; all are b's with larger ids
    rows = [(i, "a", f"{i:064d}", 10) for i in range(400)] + [(1000 + i, "b", f"{i:064d}", 10) for i in range(300)] + [(2000 + i, "c", f"{i:064d}", 10) for i in range(300, 400)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, text_hash string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.2, 1), ("c", 0.05, 1), ("d", 0.5, 1)], "source string, weight double, max_repeats int")
    mix = mixing.mixture(sized, targets).collect()
    assert len({r["doc_id"] % 1000 for r in mix}) == len(mix)  # each text once at most
    used = Counter(r["source"] for r in mix)
    # 800 texts are named, of which 400 exist; demands are 200, 160 and 40 of them
    assert all(abs(used[s] - n) <= 1 for s, n in (("a", 200), ("b", 160), ("c", 40)))
    even = mixing.mixture(sized.where("source <> 'c'"), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], targets.schema)).groupBy("source").count()
    assert {r[0]: r[1] for r in even.collect()} == {"a": 200, "b": 200}


def test_shares_move_over_time(spark):
    sized = spark.createDataFrame([(i, s, f"{s}{i:064d}", 10) for s in ("a", "b") for i in range(500)], "doc_id long, source string, text_hash string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    schedule = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 9.0), ("a", 0.5, 1.0), ("b", 0.5, 1.0), ("a", 1.0, 9.0), ("b", 1.0, 1.0)], "source string, time double, share double")
    mix = mixing.mixture(sized, targets, schedule).collect()
    fifths = Counter(int(r["position"] * 5) for r in mix)
    assert len(mix) == 1000 and all(abs(n - 200) <= 4 for k, n in fifths.items() if k < 5)  # positions are training time
    early = Counter(r["source"] for r in mix if r["position"] < 0.25)
    assert early["b"] > 2 * early["a"]
    flat = Counter(r["source"] for r in mixing.mixture(sized, targets).where("position < 0.25").collect())
    assert abs(flat["a"] - flat["b"]) <= 4


def test_default_schedule_keeps_weights(spark):
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.09, 2), ("c", 0.01, 3)], "source string, weight double, max_repeats int")
    rows = mixing.default_schedule(targets).collect()
    assert all(r["share"] >= 0 for r in rows) and all(abs(sum(r["share"] for r in rows if r["time"] == t) - 1) < 1e-9 for t in (0.0, 1.0))
    assert {r["source"]: round(r["area"], 9) for r in mixing.integrated(mixing.default_schedule(targets)).collect()} == {"a": 0.9, "b": 0.09, "c": 0.01}


# ---- 10: repetition

def brute_repeated(w, width=5):
    runs = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    hit = {i + k for i, r in enumerate(runs) if r in runs[:i] for k in range(width)}
    return len(hit) if len(w) > width else 0


def test_repeated_words_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        count, starts = repetition.repeated_words(w)
        assert count == brute_repeated(w) <= 5 * starts


def test_repetition_edges(spark):
    phrase = "one two three four five six "
    docs = [(1, None, "s"), (2, "", "s"), (3, phrase * 3, None), (4, "all words here are quite different from others", "S "), (5, phrase * 20_000, "s"), (6, "a a a a a", "s"), (7, "a a a a a a", "s"), (None, phrase * 2, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("stratum", F.lit("clash"))
    assert {r[0] for r in repetition.repetitive_documents(df).collect()} == {3, 5, 7, None}
    got = {r["doc_id"]: r for r in repetition.repetition_measures(df).collect()}
    assert got[1]["word_share"] == 0.0 and got[4]["stratum"] == "s" and got[3]["words_repeated"] == 12
    assert repetition.repetitive_documents(df.where("false")).count() == 0
    assert repetition.repeated_share(["Same line", "same  LINE", "other"]) == pytest.approx(9 / 23)


def test_cutoffs_keep_their_promise():
    assert repetition.certified(0, [0] * 100, 0.02, 0.05) == (1.0, False)
    few = repetition.certified(20, [0] * 100, 0.02, 0.05)
    assert few == (1.0, False)  # too few clean texts to show anything
    many = repetition.certified(5000, [0] * 20 + [5000] * 80, 0.02, 0.05)
    assert many[1] and many[0] == pytest.approx(repetition.CUTOFFS[19])
    assert repetition.log_binomial_cdf(1, 3, 0.5) == pytest.approx(np.log(0.5))


def test_cutoffs_come_from_labels_and_are_judged_elsewhere(spark):
    rng = random.Random(12)
    rows = [(i, "s" if i % 3 else "t", 100, 0, rng.random() * 0.3 if i % 5 else 0.6 + rng.random() * 0.4) for i in range(6000)]
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, words_repeated long, score double")
    labels = spark.createDataFrame([(i, i % 5 != 0) for i in range(6000)], "doc_id long, clean boolean")
    found, report = repetition.judged(measured, labels)
    got = {r["stratum"]: r for r in report.collect()}
    assert all(r["certified"] and 0.25 < r["cutoff"] < 0.35 and r["clean_rejected"] <= 0.03 * r["clean_judged"] for r in got.values())
    assert found.where("not clean and not rejected").count() == 0
    assert repetition.judged(measured.where("false"), labels)[1].count() == 0


def test_llm_is_imported_by_nothing_else():
    from pathlib import Path

    import shelfspark

    root = Path(shelfspark.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
