"""Key-value stores as an append-only table (store, key, type, value, ts, seq): reads, writes, deletes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.operators.relational import last_written

SCHEMA = "store string, key string, type string, value string, ts bigint, seq bigint"
#: The value types of a store, by their Spark names.
TYPES = {bool: "boolean", int: "bigint", float: "float", str: "string"}
SECRET = r"(?i)password|secret|token"


def put(spark: SparkSession, store: str, values: Mapping[str, object], ts: int, seq: int = 0) -> DataFrame:
    """Rows that write values; None deletes a key (a row without value)."""
    rows = []
    for i, (k, v) in enumerate(values.items()):
        text = None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        rows.append((store, k, "string" if v is None else TYPES[type(v)], text, ts, seq + i))
    return spark.createDataFrame(rows, SCHEMA)


def current(log: DataFrame) -> DataFrame:
    """The store as it stands: the last write of each key, deleted ones left out."""
    return last_written(log, ["store", "key"], "ts", "seq").where("value is not null")


def store_rows(log: DataFrame, store: str) -> DataFrame:
    """All present values of one store; the filter reaches the scan, as it is on a grouping key."""
    return current(log.where(F.col("store") == store))


def read_typed(log: DataFrame, store: str, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """One row with a column for each key of defaults (key -> (type, default)); values that don't parse are defaults."""
    keys = list(defaults)
    wide = store_rows(log, store).where(F.col("key").isin(keys)).groupBy().agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    return wide.select(*[F.coalesce(F.col(k).try_cast(t), F.lit(d).cast(t)).alias(k) for k, (t, d) in defaults.items()])


def schedule(log: DataFrame, store: str = "schedule") -> DataFrame:
    """The backup schedule with its defaults."""
    return read_typed(log, store, {"enabled": ("boolean", False), "interval_hours": ("bigint", 24), "require_charging": ("boolean", False), "require_wifi": ("boolean", False), "source_path": ("string", None)})


def unique_schedules(asked: DataFrame, key: str = "job") -> DataFrame:
    """One schedule a job: the last one asked for replaces all before it, whose number is `replaced`."""
    rest = [c for c in asked.columns if c != key]
    grouped = asked.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("__row"), (F.count("*") - 1).alias("replaced"))
    return grouped.select(key, "__row.*", "replaced")


def redacted(rows: DataFrame, pattern: str = SECRET) -> DataFrame:
    """rows with secret values masked: what may leave the store."""
    return rows.withColumn("value", F.when(F.col("key").rlike(pattern), F.lit("***")).otherwise(F.col("value")))


def deletions(spark: SparkSession, store: str, keys: Sequence[str], ts: int) -> DataFrame:
    """Rows that delete keys."""
    return put(spark, store, dict.fromkeys(keys), ts)
