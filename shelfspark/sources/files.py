"""Files the engine reads and writes beside Parquet tables: JSON Lines, configurations and models."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_CATALOG = (
    "parent_asin string, title string, features array<string>, description array<string>, categories array<string>, details map<string,string>, "
    "average_rating double, rating_number bigint, store string, _corrupt_record string"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of JSON Lines, with listing_id by file order; damaged lines and rows without an id are left out.

    loaded_at is null, so the order of lines decides which of repeated ids is kept.
    """
    rows = spark.read.schema(RAW_CATALOG).json(path).withColumn("listing_id", F.monotonically_increasing_id())
    kept = rows.where("_corrupt_record is null and parent_asin is not null and trim(parent_asin) <> ''").drop("_corrupt_record")
    return kept.withColumn("loaded_at", F.lit(None).cast("timestamp"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON Lines; blank lines give none, damaged ones a row of nulls."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_trace(ranks: DataFrame, path: str) -> None:
    """Append recorded candidates to a trace partitioned by turn."""
    ranks.write.mode("append").partitionBy("turn").parquet(path)


def load_settings(defaults: dict, path: str) -> dict:
    """The settings of a JSON file laid over the defaults; null sections and unknown keys are skipped."""
    given = json.loads(Path(path).read_text())
    out = {}
    for section, value in defaults.items():
        own = given.get(section)
        if isinstance(value, dict):
            out[section] = value | {k: v for k, v in (own or {}).items() if k in value}
        else:
            out[section] = value if own is None else own
    return out


def save_settings(settings: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(settings, indent=2, sort_keys=True))


def save_weights(weights: dict[str, float], by_intent: dict[str, dict[str, float]], path: str) -> None:
    """A linear model as a file: the common weights, and those an intent replaces."""
    save_settings({"weights": weights, "by_intent": by_intent}, path)


def load_weights(features: list[str], path: str) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """The model of a file in the order of the features; a feature it lacks weighs 0, one that is not asked for is skipped."""
    given = json.loads(Path(path).read_text())
    weights = {f: float((given.get("weights") or {}).get(f, 0.0)) for f in features}
    return weights, {k: {f: float(w) for f, w in (own or {}).items() if f in weights} for k, own in (given.get("by_intent") or {}).items()}
