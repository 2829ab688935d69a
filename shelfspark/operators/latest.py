"""One row per key: the row loaded last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys with repeated rows that are sent to all workers; with more, all rows are shuffled.
SENT = 500_000


def _rows(df: DataFrame, key: str, columns: list, order: str | None) -> tuple[DataFrame, list]:
    at = F.col(order) if order and order in df.columns else F.lit(None).cast("timestamp")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), *columns, at.alias("__at"))
    return rows, [f for f in rows.schema.fields if f.name not in (key, "__at")]


def _first(rows: DataFrame, key: str, fields: list) -> DataFrame:
    tie = F.xxhash64(*[F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in fields]) if fields else F.lit(0)
    by = Window.partitionBy(key).orderBy(F.col("__at").desc_nulls_last(), tie)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").select(key, *[f.name for f in fields])


def latest(df: DataFrame, key: str, columns: list, order: str | None = "loaded_at") -> DataFrame:
    """The key and the columns asked for, of the row of each non-null key that was loaded last.

    Rows that repeat a key are copies, so any of them would do; taking the last makes the result defined where
    they are not.  Equal times fall back on a hash of the row.  Only the columns asked for are shuffled.  A key is
    unique but for its copies, so no group is large.  columns: names or Columns.
    """
    rows, fields = _rows(df, key, columns, order)
    return _first(rows, key, fields)


def latest_of_wide(df: DataFrame, key: str, columns: list, order: str | None = "loaded_at") -> DataFrame:
    """The same rows as latest, for wide rows of which few repeat a key: these stay where they are.

    A first pass over key and time only finds the keys that occur more than once.  While they are few they are sent to
    the workers, which drop the older rows on reading; only rows that tie are shuffled.  Runs a job.
    """
    rows, fields = _rows(df, key, columns, order)
    narrow = df.where(F.col(key).isNotNull())
    at = F.col(order) if order and order in df.columns else F.lit(None).cast("timestamp")
    never = F.lit("0001-01-01").cast("timestamp")
    times = narrow.select(key, F.coalesce(at.cast("timestamp"), never).alias("__last")).groupBy(key, "__last").agg(F.count("*").alias("__many"))
    repeated = times.groupBy(key).agg(F.sum("__many").alias("__rows"), F.max("__last").alias("__last"), F.max_by("__many", "__last").alias("__many")).where("__rows > 1").drop("__rows")
    found = repeated.limit(SENT + 1).agg(F.count("*"), F.max("__many")).first()
    if found[0] > SENT:
        return _first(rows, key, fields)
    names = [key, *[f.name for f in fields]]
    if not found[0]:
        return rows.select(*names)
    known = rows.join(F.broadcast(repeated), key, "left").where(F.col("__last").isNull() | (F.coalesce(F.col("__at").cast("timestamp"), never) == F.col("__last")))
    if found[1] == 1:
        return known.select(*names)
    alone = F.coalesce(F.col("__many"), F.lit(1)) == 1
    return known.where(alone).select(*names).unionByName(_first(known.where(~alone).select(*names, "__at"), key, fields))
