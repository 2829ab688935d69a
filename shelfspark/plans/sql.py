"""Pieces of the SQL that checks the engine's queries: an independent statement of the same semantics."""

from __future__ import annotations

from ..functions.lexicons import CATEGORY_NOISE, DEPARTMENTS, FIELDS, IRREGULAR, K1, LOW_VALUE, MAX_DF, STOPWORDS, TITLE_AUDIENCE


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def lookup(value: str, table: dict[str, str]) -> str:
    return "CASE " + value + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def flat(column: str) -> str:
    return f"coalesce(array_to_string(list_filter({column}, lambda x: x IS NOT NULL AND x <> ''), ' '), '')"


def surface(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[a-zA-Z0-9\\x{{0130}}\\x{{0131}}\\x{{017f}}\\x{{212a}}]+'), lambda x: lower(x)), "
        f"lambda x: length(x) > 1 AND x NOT IN ({listed(STOPWORDS + LOW_VALUE)}))"
    )


def stem(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN {cut(3)} || 'y' WHEN length({t}) > 4 AND {t} LIKE '%sses' THEN {cut(2)} "
        f"WHEN length({t}) > 4 AND regexp_matches({t}, '(ches|shes|xes|zes)$') THEN {cut(2)} "
        f"WHEN length({t}) > 3 AND regexp_matches({t}, 's$') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN {cut(1)} ELSE {t} END"
    )


def singulars(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"
    long = f"length({t}) > 4"
    return (
        f"list_filter([{{pos: 0, form: CASE WHEN {long} AND {t} LIKE '%ies' THEN {cut(3)} || 'ie' END}}, {{pos: 1, form: CASE WHEN {long} AND {t} LIKE '%ies' THEN {cut(3)} || 'y' END}}, "
        f"{{pos: 2, form: CASE WHEN {long} AND {t} LIKE '%ves' THEN {cut(3)} || 'f' END}}, {{pos: 3, form: CASE WHEN {long} AND {t} LIKE '%ves' THEN {cut(3)} || 'fe' END}}, "
        f"{{pos: 4, form: CASE WHEN {long} AND regexp_matches({t}, '(ch|sh|s|x|z)es$') THEN {cut(2)} END}}, {{pos: 5, form: CASE WHEN {t} NOT LIKE '%ss' THEN {cut(1)} END}}], "
        f"lambda x: x.form IS NOT NULL AND length({t}) > 3 AND {t} LIKE '%s')"
    )


def audience(text: str) -> str:
    words = f"list_transform(string_split_regex(replace(lower({text}), '''', ' '), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}]', '', 'g'))"
    return f"list_filter(list_transform({words}, lambda w: {lookup('w', TITLE_AUDIENCE)}), lambda g: g IS NOT NULL)[1]"


def category_path(column: str) -> str:
    parts = f"flatten(list_transform(list_filter({column}, lambda x: x IS NOT NULL), lambda x: string_split(x, ',')))"
    return f"coalesce(list_filter(list_transform({parts}, lambda p: trim(p)), lambda p: p <> '' AND lower(p) NOT IN ({listed(CATEGORY_NOISE)})), [])"


def ngrams(text: str, n: int = 4) -> str:
    plain = f"(' ' || trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')) || ' ')"
    return f"list_transform(range(1, length({plain}) - {n} + 2), lambda i: substring({plain}, i, {n}))"


_DEPT_KEY = "trim(regexp_replace(regexp_replace(lower(details['Department']), '[_-]', ' ', 'g'), '\\s+', ' ', 'g'))"

LISTING = (
    "listing AS (SELECT * REPLACE (trim(parent_asin) AS parent_asin) FROM catalog WHERE parent_asin IS NOT NULL AND trim(parent_asin) <> '' "
    "QUALIFY row_number() OVER (PARTITION BY trim(parent_asin) ORDER BY loaded_at NULLS FIRST, listing_id) = 1)"
)

PRODUCT = LISTING + f""",
product0 AS (SELECT listing_id AS doc_id, parent_asin, coalesce(title, '') AS title, {flat('features')} AS features_text, {flat('categories')} AS categories_text,
  {flat('description')} AS description_text, coalesce(store, '') AS store, {category_path('categories')} AS category_path,
  coalesce({lookup(_DEPT_KEY, DEPARTMENTS)}, {lookup(f"replace({_DEPT_KEY}, ' ', '-')", DEPARTMENTS)}) AS gender,
  regexp_replace(lower(coalesce(store, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS brand_key, coalesce(average_rating, 0.0) AS average_rating,
  coalesce(rating_number, 0) AS rating_number, coalesce(len(features), 0) AS n_features, coalesce(len(description), 0) > 0 AS has_description FROM listing),
product AS (SELECT *, coalesce({audience('title')}, {audience("array_to_string(category_path, ' ')")}) AS gender_fallback,
  lower(title || ' ' || features_text || ' ' || categories_text || ' ' || description_text) AS search_blob FROM product0)"""

COUNTS = f"counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_concat({surface('title')}, {surface('categories_text')})) AS token FROM product) GROUP BY token)"

CANONICAL = COUNTS + f""",
cand AS (SELECT token, own, c.pos AS pos, c.form AS form FROM (SELECT token, n AS own, unnest({singulars('token')}) AS c FROM counts)),
vote AS (SELECT cand.token, own, pos, form, coalesce(k.n, 0) AS votes FROM cand LEFT JOIN counts k ON k.token = cand.form),
best AS (SELECT token, own, form, votes FROM vote QUALIFY row_number() OVER (PARTITION BY token ORDER BY votes DESC, pos) = 1),
chosen AS (SELECT token, CASE WHEN votes >= 20 THEN form WHEN votes = 0 AND own >= 20 THEN token END AS target FROM best),
pair AS (SELECT p.plural, p.singular, a.n AS np, b.n AS ns FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in IRREGULAR)}) p(plural, singular)
  JOIN counts a ON a.token = p.plural JOIN counts b ON b.token = p.singular WHERE greatest(a.n, b.n) >= 20),
resolved AS (SELECT token, target FROM chosen WHERE target IS NOT NULL AND token NOT IN (SELECT plural FROM pair UNION ALL SELECT singular FROM pair)
  UNION ALL SELECT CASE WHEN np >= ns THEN singular ELSE plural END, CASE WHEN np >= ns THEN plural ELSE singular END FROM pair),
hop1 AS (SELECT a.token, coalesce(b.target, a.target) AS target FROM resolved a LEFT JOIN resolved b ON b.token = a.target),
hop2 AS (SELECT a.token, coalesce(b.target, a.target) AS target FROM hop1 a LEFT JOIN resolved b ON b.token = a.target),
hop3 AS (SELECT a.token, coalesce(b.target, a.target) AS target FROM hop2 a LEFT JOIN resolved b ON b.token = a.target),
canonical AS (SELECT a.token, coalesce(b.target, a.target) AS canonical FROM hop3 a LEFT JOIN resolved b ON b.token = a.target)"""

INDEX = CANONICAL + f""",
fieldtext AS (SELECT doc_id, 'title' AS field, title AS text FROM product UNION ALL SELECT doc_id, 'features', features_text FROM product UNION ALL SELECT doc_id, 'categories', categories_text FROM product
  UNION ALL SELECT doc_id, 'description', description_text FROM product UNION ALL SELECT doc_id, 'store', store FROM product),
fieldtoken AS (SELECT doc_id, field, unnest({surface('text')}) AS token FROM fieldtext),
postings AS (SELECT field, coalesce(c.canonical, {stem('f.token')}) AS term, doc_id, least(count(*), 32767)::INTEGER AS tf FROM fieldtoken f LEFT JOIN canonical c ON c.token = f.token GROUP BY ALL),
doc_stats AS (SELECT field, doc_id, sum(tf)::BIGINT AS dl FROM postings GROUP BY ALL),
n AS (SELECT count(*) AS n_docs FROM product),
field_stats AS (SELECT field, n_docs, sum(tf)::DOUBLE / n_docs AS avgdl FROM postings, n GROUP BY field, n_docs),
term_stats AS (SELECT field, term, count(*) AS df, n_docs, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, n GROUP BY field, term, n_docs)"""

_B = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}::DOUBLE" for f, (b, _) in FIELDS.items()) + " END"
_W = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, (_, w) in FIELDS.items()) + " END"

QUERIES = "queries AS (SELECT doc_id AS query_id, title AS text FROM product WHERE doc_id % 50 = 0)"


def search(depth: int) -> str:
    return INDEX + f""",
{QUERIES},
asked AS (SELECT DISTINCT query_id, coalesce(c.canonical, {stem('q.token')}) AS term FROM (SELECT query_id, unnest({surface('text')}) AS token FROM queries) q LEFT JOIN canonical c ON c.token = q.token),
capped AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY term) <= 48),
hit AS (SELECT query_id, p.field, p.doc_id, s.idf * p.tf * {K1 + 1}::DOUBLE / (p.tf + {K1}::DOUBLE * (1 - b + b * d.dl / fs.avgdl)) AS gain
  FROM (SELECT *, {_B} AS b FROM postings) p JOIN capped a ON a.term = p.term JOIN term_stats s ON s.term = p.term AND s.field = p.field AND s.df <= {MAX_DF}::DOUBLE * s.n_docs
  JOIN doc_stats d ON d.field = p.field AND d.doc_id = p.doc_id JOIN field_stats fs ON fs.field = p.field),
scored AS (SELECT query_id, field, doc_id, round(sum(gain), 9) AS score FROM hit GROUP BY ALL),
per_field AS (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored QUALIFY rank <= {depth}),
mixture AS (SELECT query_id, doc_id, round(sum({_W} * score), 9) AS score FROM per_field GROUP BY ALL)"""


GRAMS = f"""gram_postings AS (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest({ngrams('title')}) AS gram FROM product) GROUP BY ALL),
gn AS (SELECT count(*) AS n_docs FROM product),
gram_stats AS (SELECT gram, count(*) AS df, n_docs, ln(1 + n_docs / (1 + count(*))) AS idf FROM gram_postings, gn GROUP BY gram, n_docs),
doc_norms AS (SELECT doc_id, CASE WHEN norm = 0 THEN 1.0 ELSE norm END AS norm FROM
  (SELECT doc_id, sqrt(sum(power((1 + ln(tf)) * idf, 2)))::FLOAT::DOUBLE AS norm FROM gram_postings JOIN gram_stats USING (gram) GROUP BY doc_id))"""


def cosine(depth: int) -> str:
    return GRAMS + f""",
gram_asked AS (SELECT query_id, gram, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest({ngrams('title')}) AS gram FROM product WHERE doc_id % 50 = 0) GROUP BY ALL),
gram_weighted AS (SELECT query_id, gram, df, n_docs, idf, (1 + ln(qtf)) * idf AS w FROM gram_asked JOIN gram_stats USING (gram)),
qnorm AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM gram_weighted GROUP BY query_id),
dot AS (SELECT query_id, doc_id, sum(w * idf) AS dot FROM gram_weighted JOIN gram_postings USING (gram) WHERE df <= 0.25::DOUBLE * n_docs GROUP BY ALL),
gram_scored AS (SELECT query_id, doc_id, round(dot / (norm * qnorm), 9) AS score FROM dot JOIN doc_norms USING (doc_id) JOIN qnorm USING (query_id) WHERE qnorm > 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM gram_scored QUALIFY rank <= {depth})"""


FUSED = """lexmax AS (SELECT query_id, max(score) AS best FROM mixture GROUP BY query_id),
densemax AS (SELECT query_id, max(score) AS best FROM dense GROUP BY query_id),
fused AS (SELECT query_id, doc_id, round(0.78::DOUBLE * coalesce(l.s, 0) + (1 - 0.78::DOUBLE) * coalesce(d.s, 0), 9) AS score FROM
  (SELECT query_id, doc_id, CASE WHEN best > 0 THEN score / best ELSE 0 END AS s FROM mixture JOIN lexmax USING (query_id)) l FULL JOIN
  (SELECT query_id, doc_id, CASE WHEN best > 0 THEN score / best ELSE 0 END AS s FROM dense JOIN densemax USING (query_id)) d USING (query_id, doc_id))"""
