"""Problem 4: deeply nested records into flat tables that keep parent-child links.

Single-pass tagged emission: each payload is parsed once and visited depth first; every element of a list becomes a row
with the tag of its table (the list's path), its own key (the ordinals along the path), its parent's tag and key, and
its other fields as JSON; what the record holds outside its lists becomes a row of the root table.  The tables are the
tagged rows, split by tag, with a schema applied to the fields.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lists of the raw records, and the fields of each element; fixed values.
TABLES = {
    "categories": "value string",
    "details.variants": "color string",
    "details.variants.offers": "sku string, size string, price string",
    "details.variants.offers.stock": "depot string, qty long",
    "details.ranks": "shelf string, rank string",
    "details.care.steps": "step string",
    "details.care.steps.notes": "value string",
    "user_profile.preference_tags": "value string, tag string",
    "user_profile.preference_tags.evidence": "kind string, count long",
    "user_profile.history.periods": "label string",
    "user_profile.history.periods.items": "leaf string, n long",
}
#: Objects that may arrive as a string of JSON, or as one inside another.
ENCODED = ("details", "user_profile")
CORRUPT, ROOT = "_corrupt", "_record"

_SCHEMA = "record_id long, child_path string, ordinals string, parent_path string, parent_ordinals string, payload string"


def _tree(paths) -> dict:
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})
    return tree


def _no_constant(name: str):
    raise ValueError(name)


def _parse(text: str):
    return json.loads(text, parse_constant=_no_constant)


def _decoded(value):
    """The content of a value that may be JSON in a string."""
    while isinstance(value, str):
        try:
            value = _parse(value)
        except (ValueError, RecursionError):
            return None
    return value


def _bare(value: dict, tree: dict, path: str, lists: set) -> dict:
    """An object without the lists that have tables of their own; objects on the way to them keep the rest."""
    out = {}
    for key, inner in value.items():
        full = f"{path}.{key}" if path else key
        if full in lists:
            continue
        if key in tree:
            inner = _decoded(inner) if full in ENCODED else inner
            inner = _bare(inner, tree[key], full, lists) if isinstance(inner, dict) else inner
        out[key] = inner
    return out


def _fields(value, tree: dict, path: str, lists: set) -> str:
    return json.dumps(_bare(value, tree, path, lists) if isinstance(value, dict) else {"value": value})


def visit(record: dict, paths, with_payload: bool, with_root: bool = False):
    """Yields (path, ordinals, parent path, parent ordinals, payload) depth first, the record itself first if asked for."""
    lists = set(paths)
    root = ROOT if with_root else ""

    def walk(value, tree, path, parent_path, ordinals):
        if path in lists:
            elements = value if isinstance(value, list) else [value]
            for i, element in enumerate(elements):
                if element is None:
                    continue
                own = f"{ordinals}.{i}" if ordinals else str(i)
                yield path, own, parent_path, ordinals, _fields(element, tree, path, lists) if with_payload else None
                if tree and isinstance(element, dict):
                    yield from below(element, tree, path, path, own)
        elif isinstance(value, dict):
            yield from below(value, tree, path, parent_path, ordinals)

    def below(value, tree, path, parent_path, ordinals):
        for key, sub in tree.items():
            inner = value.get(key)
            full = f"{path}.{key}" if path else key
            if full in ENCODED:
                inner = _decoded(inner)
            if inner is not None:
                yield from walk(inner, sub, full, parent_path, ordinals)

    tree = _tree(paths)
    if with_root:
        yield ROOT, "", None, None, _fields(record, tree, "", lists) if with_payload else None
    yield from below(record, tree, "", root, "")


def _emit(paths, with_payload: bool, with_root: bool):
    names = ["record_id", "child_path", "ordinals", "parent_path", "parent_ordinals", "payload"]
    types = [pa.int64(), *[pa.string()] * 5]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for record_id, payload in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    record = _parse(payload) if payload is not None else None
                    rows = [(record_id, *r) for r in visit(record, paths, with_payload, with_root)] if isinstance(record, dict) else None
                except (ValueError, RecursionError):
                    rows = None
                out.extend(rows if rows is not None else [(record_id, CORRUPT, "", "", "", payload if with_payload else None)])
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def flatten_records(raw: DataFrame, paths=tuple(TABLES), with_payload: bool = True, with_root: bool = False) -> DataFrame:
    """(record_id, child_path, ordinals, parent_path, parent_ordinals, payload), one row per non-null list element.

    ordinals are zero-based positions along the path, joined by '.'; null elements keep their position.  A lone
    non-null value at a list's path is a list of one.  A payload that is null or not a complete JSON object gives one
    row with child_path '_corrupt' and empty keys; an object without lists gives none.  parent_path is '' for elements
    that hang on the record itself, or the tag of the root table with with_root, which adds a row of empty ordinals and
    null parent per record for what it holds outside its lists.  paths: None looks for the lists first, see list_paths.
    """
    paths = list_paths(raw) if paths is None else paths
    rows = raw.select(F.col("record_id").cast("long").alias("record_id"), F.col("payload").cast("string").alias("payload"))
    return rows.mapInArrow(_emit(tuple(paths), with_payload, with_root), _SCHEMA)


def _paths(batches):
    """The paths of the lists of a task's records."""
    found: set[str] = set()

    def walk(value, path):
        if path in ENCODED:
            value = _decoded(value)
        if isinstance(value, list):
            found.add(path)
            for element in value:
                if isinstance(element, dict):
                    walk(element, path)
        elif isinstance(value, dict):
            for key, inner in value.items():
                walk(inner, f"{path}.{key}" if path else key)

    for batch in batches:
        for payload in batch.column(0).to_pylist():
            try:
                record = _parse(payload) if payload is not None else None
                if isinstance(record, dict):
                    walk(record, "")
            except (ValueError, RecursionError):
                continue
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["path"])


def list_paths(raw: DataFrame, most: int = 1000) -> list[str]:
    """The paths at which any record has a list; raises if there are more than `most`, as keys are then values."""
    rows = raw.select(F.col("payload").cast("string").alias("payload")).mapInArrow(_paths, "path string").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many paths: keys of objects seem to be values")
    return sorted(r[0] for r in rows)


#: The fields of the root table; fixed values.
ROOT_FIELDS = (
    "kind string, parent_asin string, title string, price string, store string, average_rating string, rating_number string, sample_id string, details map<string,string>, user_profile map<string,string>"
)


def nested_table(tagged: DataFrame, path: str) -> DataFrame:
    """One table of the tagged rows: keys, parent's keys, and the fields of its schema; unreadable fields are null."""
    rows = tagged.where(F.col("child_path") == path)
    schema = ROOT_FIELDS if path == ROOT else TABLES[path]
    return rows.select("record_id", "ordinals", "parent_path", "parent_ordinals", F.from_json("payload", schema).alias("x")).select("record_id", "ordinals", "parent_path", "parent_ordinals", "x.*")


def write_tables(raw: DataFrame, path: str) -> None:
    """Write all tables in one pass, partitioned by child_path."""
    flatten_records(raw, with_root=True).write.mode("overwrite").partitionBy("child_path").parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One written table with its schema; only its own folder is read."""
    return nested_table(spark.read.parquet(path), name)


def typed_tables(raw: DataFrame) -> DataFrame:
    """All tables in one: (record_id, child_path, ordinals, parent_path, parent_ordinals, fields), fields as JSON of the table's schema.

    One pass over the payloads; the schema of each row's table is applied where the row is.
    """
    tagged = flatten_records(raw, with_root=True)
    fields = F.when(F.col("child_path") == ROOT, F.to_json(F.from_json("payload", ROOT_FIELDS)))
    for path, schema in TABLES.items():
        fields = fields.when(F.col("child_path") == path, F.to_json(F.from_json("payload", schema)))
    return tagged.select("record_id", "child_path", "ordinals", "parent_path", "parent_ordinals", fields.alias("fields"))


def list_elements(raw: DataFrame) -> DataFrame:
    """(record_id, child_path, ordinals) of every list element, and of every damaged record."""
    return flatten_records(raw, with_payload=False).select("record_id", "child_path", "ordinals")
