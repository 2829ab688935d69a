"""The queries of the operators for training data, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import stage
from ..sources import table
from . import canonical, components, consensus, distinctive, frequency, mixing, neardup, repetition, sameitem, tokens


def _ranking(s, d):
    scored = consensus.scored_candidates(table(s, d, "candidates"), table(s, d, "catalog"))
    ranking = consensus.consensus_ranking(scored, consensus.LIST, "candidate_asin", consensus.SCORES)
    return consensus.placed(ranking, consensus.LIST, "candidate_asin").select(*consensus.LIST, "candidate_asin", "projection", "place")


def _near(s, d):
    links, members = neardup.similar_texts(neardup.listing_texts(table(s, d, "catalog")), 3, 0.5, 40)
    # a class is named by its smallest listing_id
    names = stage(members.groupBy("class").agg(F.min("listing_id").alias("class_id")), "names")
    one, two = (names.select(F.col("class").alias(f"class_{k}"), F.col("class_id").alias(f"id_{k}")) for k in (1, 2))
    named = links.join(one, "class_1").join(two, "class_2")
    links = named.select(F.least("id_1", "id_2").alias("class_id_1"), F.greatest("id_1", "id_2").alias("class_id_2"), F.round("similarity", 6).alias("similarity"))
    return stage(links, "links"), members.join(names, "class").select("listing_id", "class_id")


def _near_links(s, d):
    """Every link between two different texts, as the smallest listing_id of each; p7_groups has the members of both."""
    return _near(s, d)[0]


def _near_groups(s, d):
    """listing_id, class_id (listings with the same word sequences), group_id and the class's links of every listing that takes part."""
    links, members = _near(s, d)
    found = components.components(links.select(F.col("class_id_1").alias("a"), F.col("class_id_2").alias("b"))).withColumnRenamed("node", "class_id")
    many = links.select(F.explode(F.array("class_id_1", "class_id_2")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    rows = members.join(found, "class_id", "left").join(many, "class_id", "left")
    return rows.select("listing_id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _mix(s, d):
    return mixing.mixture(stage(mixing.sized_documents(table(s, d, "documents")), "sized"), table(s, d, "mix_targets"))


def queries() -> dict:
    return {
        "p1_found": lambda s, d: frequency.marked_terms(table(s, d, "catalog")),
        "p1_terms": lambda s, d: frequency.term_frequencies(table(s, d, "catalog")),
        "p2_found": lambda s, d: distinctive.rare_repeated_terms(table(s, d, "catalog")).select("listing_id", "term"),
        "p2_scores": lambda s, d: distinctive.term_scores(table(s, d, "catalog")),
        "p3_found": lambda s, d: canonical.mapped_listings(table(s, d, "catalog"), table(s, d, "ref_values")),
        "p5_found": lambda s, d: consensus.leaders(table(s, d, "candidates"), table(s, d, "catalog")),
        "p5_component": _ranking,
        "p6_found": lambda s, d: sameitem.same_item_pairs(table(s, d, "catalog"), table(s, d, "ref_values")),
        "p6_groups": lambda s, d: sameitem.item_groups(table(s, d, "catalog"), table(s, d, "ref_values")),
        "p7_found": lambda s, d: neardup.near_duplicate_listings(table(s, d, "catalog")),
        "p7_groups": _near_groups,
        "p7_links": _near_links,
        "p8_ids": lambda s, d: tokens.encode_documents(table(s, d, "documents")),
        "p9_found": lambda s, d: mixing.unreachable_sources(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.mixing_report(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_mix": _mix,
        "p10_found": lambda s, d: repetition.repetitive_documents(table(s, d, "documents")),
        "p10_cutoffs": lambda s, d: repetition.rejection_report(table(s, d, "documents")),
        "p10_shares": lambda s, d: repetition.repetition(table(s, d, "documents")),
    }


_LISTING = "listing AS (SELECT * FROM catalog WHERE listing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_WORDS = lambda text: f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"
_TERMS = f"""{_LISTING}, n AS (SELECT count(*) AS n FROM listing),
held AS (SELECT listing_id, 'title' AS field, unnest({_WORDS("coalesce(title, '')")}) AS term FROM listing
  UNION ALL SELECT listing_id, 'categories', lower(trim(x)) FROM (SELECT listing_id, unnest(categories) AS x FROM listing) WHERE trim(x) <> ''),
freq AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT listing_id) AS records FROM held GROUP BY ALL),
marked AS (SELECT field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.2 * n THEN 'common' ELSE 'useful' END AS mark FROM freq, n)"""
_ALL = "concat_ws(' ', title, array_to_string(features, ' '), array_to_string(description, ' '))"
_BODY = "concat_ws(' ', array_to_string(features, ' '), array_to_string(description, ' '))"

_SIMILAR = f"""{_LISTING}, w AS (SELECT listing_id, {_WORDS(_BODY)} AS w FROM listing),
sh AS (SELECT DISTINCT listing_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 40),
size AS (SELECT listing_id, count(*) AS n FROM sh GROUP BY listing_id),
pair AS (SELECT a.listing_id AS listing_id_1, b.listing_id AS listing_id_2, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.listing_id < b.listing_id GROUP BY ALL),
similar_pair AS (SELECT listing_id_1, listing_id_2, c / (x.n + y.n - c) AS j FROM pair JOIN size x ON x.listing_id = listing_id_1 JOIN size y ON y.listing_id = listing_id_2 WHERE 2 * c >= x.n + y.n - c)"""
_CLASSES = """named AS (SELECT listing_id, string_agg(s, '|' ORDER BY s) AS content FROM sh GROUP BY listing_id),
member AS (SELECT listing_id, min(listing_id) OVER (PARTITION BY content) AS class_id FROM named),
link AS (SELECT DISTINCT least(a.class_id, b.class_id) AS class_id_1, greatest(a.class_id, b.class_id) AS class_id_2, round(j, 6) AS similarity FROM similar_pair JOIN member a ON a.listing_id = listing_id_1 JOIN member b ON b.listing_id = listing_id_2 WHERE a.class_id <> b.class_id)"""

_ORACLE = {
    "p1_found": f"WITH {_TERMS} SELECT field, term, mark FROM marked WHERE mark <> 'useful'",
    "p1_terms": f"WITH {_TERMS} SELECT field, term, occurrences, records, mark FROM marked",
    "p2_found": f"""WITH {_LISTING}, tf AS (SELECT listing_id, term, count(*) AS tf FROM (SELECT listing_id, unnest({_WORDS(_ALL)}) AS term FROM listing) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT listing_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df <= 5""",
    "p2_scores": f"""WITH {_LISTING}, n AS (SELECT count(*) AS n FROM listing), w AS (SELECT listing_id, {_WORDS(_ALL)} AS w FROM listing),
pos AS (SELECT listing_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS at FROM w),
tf AS (SELECT listing_id, term, count(*) AS tf FROM pos GROUP BY ALL), df AS (SELECT term, count(*) AS records FROM tf GROUP BY term),
near AS (SELECT a.listing_id, a.term, count(DISTINCT b.term) AS degree FROM pos a JOIN pos b ON a.listing_id = b.listing_id AND b.at BETWEEN a.at - 3 AND a.at + 3 AND a.term <> b.term GROUP BY ALL)
SELECT listing_id, term, tf, records, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) * ln((n + 1) / records), 6) AS score FROM tf JOIN df USING (term) LEFT JOIN near USING (listing_id, term), n""",
    "p5_found": """WITH r AS (SELECT parent_asin, arg_max(coalesce(rating_number, 0), loaded_at) AS rn, arg_max(coalesce(average_rating, 0), loaded_at) AS ar FROM catalog WHERE parent_asin IS NOT NULL GROUP BY parent_asin),
c AS (SELECT DISTINCT session_id, turn, candidate_asin, coalesce(bm25, 0) AS bm25, coalesce(fused, 0) AS fused FROM candidates),
v AS (SELECT session_id, turn, candidate_asin, bm25, fused, coalesce(rn, 0) AS rn, coalesce(ar, 0) AS ar FROM c LEFT JOIN r ON parent_asin = candidate_asin),
k AS (SELECT session_id, turn, candidate_asin, """ + " + ".join(f"rank() OVER (PARTITION BY session_id, turn ORDER BY {x}) + (count(*) OVER (PARTITION BY session_id, turn, {x}) - 1) / 2" for x in ("rn", "ar", "bm25", "fused")) + """ AS s FROM v)
SELECT session_id, turn, candidate_asin FROM k QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY s DESC, candidate_asin) = 1""",
    "p7_found": f"WITH {_SIMILAR} SELECT listing_id_1, listing_id_2 FROM similar_pair",
    "p7_links": f"""WITH {_SIMILAR}, {_CLASSES} SELECT class_id_1, class_id_2, similarity FROM link""",
    "p7_groups": f"""WITH RECURSIVE {_SIMILAR}, {_CLASSES},
both_ways AS (SELECT class_id_1 AS a, class_id_2 AS b FROM link UNION SELECT class_id_2, class_id_1 FROM link),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
comp AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node), many AS (SELECT a AS node, count(*) AS links FROM both_ways GROUP BY a)
SELECT listing_id, class_id, coalesce(component, class_id) AS group_id, coalesce(links, 0) AS links FROM member LEFT JOIN comp ON comp.node = class_id LEFT JOIN many ON many.node = class_id""",
    "p10_found": f"""WITH w AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM w WHERE len(w) > 5),
again AS (SELECT doc_id, pos FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) > 1),
hit AS (SELECT doc_id, count(DISTINCT pos + k) AS repeated FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id)
SELECT doc_id FROM hit JOIN w USING (doc_id) WHERE 4 * repeated >= len(w)""",
}


def oracle_sql() -> dict:
    return dict(_ORACLE)
