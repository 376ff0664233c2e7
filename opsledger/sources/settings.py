"""Settings backups: JSON of (timestamp, appVersion, settings by store), read to typed rows and written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.functions.times import FILE_STAMP, shown
from opsledger.operators.keyvalue import redacted

REQUIRED = ("timestamp", "appVersion", "settings")


def parse(files: DataFrame, column: str = "value") -> DataFrame:
    """(timestamp, app_version, store, key, type, value) of settings documents, one per row.

    A document that isn't JSON or lacks a required key raises an error when its rows are read. Types are those the
    JSON shows (a long within int range is told apart only by a `types` map, which our own files carry).
    """
    spark = files.sparkSession
    doc = F.try_parse_json(F.col(column))
    checked = files.select(F.when(doc.isNotNull(), doc).otherwise(F.raise_error(F.lit("settings are not JSON"))).alias("doc"))
    for key in REQUIRED:
        there = F.try_variant_get("doc", f"$.{key}", "variant").isNotNull()
        checked = checked.withColumn("doc", F.when(there, F.col("doc")).otherwise(F.raise_error(F.lit(f"settings lack {key}"))))
    head = checked.select(
        F.try_variant_get("doc", "$.timestamp", "bigint").alias("timestamp"), F.try_variant_get("doc", "$.appVersion", "string").alias("app_version"),
        F.try_variant_get("doc", "$.settings", "variant").alias("settings"), F.from_json(F.try_variant_get("doc", "$.types", "string"), "map<string,map<string,string>>").alias("types"))
    stores = head.lateralJoin(spark.tvf.variant_explode(F.col("settings").outer())).select("timestamp", "app_version", "types", F.col("key").alias("store"), F.col("value").alias("pairs"))
    pairs = stores.lateralJoin(spark.tvf.variant_explode(F.col("pairs").outer())).select("timestamp", "app_version", "types", "store", "key", "value")
    shape = F.schema_of_variant("value")
    guessed = F.when(shape == "BOOLEAN", "boolean").when(shape == "BIGINT", "bigint").when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double").when(shape == "STRING", "string").otherwise("unsupported")
    told = F.try_element_at(F.try_element_at("types", F.col("store")), F.col("key"))
    return pairs.select("timestamp", "app_version", "store", "key", F.coalesce(told, guessed).alias("type"), F.try_variant_get("value", "$", "string").alias("value")).where("value is not null")


def quoted(text: F.Column) -> F.Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """parse of whole files."""
    return parse(spark.read.text(path, wholetext=True))


def _stores(rows: DataFrame, keep_secrets: bool) -> DataFrame:
    """(store, v, t): each store's values and types as the JSON of a member; empty stores are left out."""
    rows = rows if keep_secrets else redacted(rows)
    bare = F.col("type").isin("boolean", "bigint", "int", "float", "double") & (F.col("value") != "***")
    value, kind = F.when(bare, F.col("value")).otherwise(quoted(F.col("value"))), quoted(F.col("type"))
    of_key = lambda x: F.concat(quoted(F.col("key")), F.lit(": "), x)
    pair = rows.select("store", quoted(F.col("store")).alias("s"), F.struct("key", of_key(value).alias("v"), of_key(kind).alias("t")).alias("p"))
    stores = pair.groupBy("store", "s").agg(F.sort_array(F.collect_list("p")).alias("p"))
    block = lambda field: F.concat(F.lit("    "), F.col("s"), F.lit(": {\n      "), F.array_join(F.col(f"p.{field}"), ",\n      "), F.lit("\n    }"))
    return stores.select("store", block("v").alias("v"), block("t").alias("t"))


def _document(values: F.Column, kinds: F.Column, timestamp: int, app_version: str) -> F.Column:
    return F.concat(F.lit(f'{{\n  "timestamp": {int(timestamp)},\n  "appVersion": '), quoted(F.lit(app_version)),
                    F.lit(',\n  "settings": {\n'), values, F.lit('\n  },\n  "types": {\n'), kinds, F.lit("\n  }\n}"))


def documents(rows: DataFrame, timestamp: int, app_version: str, keep_secrets: bool = False) -> DataFrame:
    """(store, value): a settings document for each store of the rows (store, key, type, value), a table of any size.

    Secrets are masked unless asked for. Values keep their JSON types; `types` names them for an exact way back.
    """
    return _stores(rows, keep_secrets).select("store", _document(F.col("v"), F.col("t"), timestamp, app_version).alias("value"))


def to_json(rows: DataFrame, timestamp: int, app_version: str, keep_secrets: bool = False, most: int = 10_000) -> DataFrame:
    """(value): as documents(), but one document of all stores; an error where there are more than `most` of them."""
    told = F.raise_error(F.lit(f"more than {most} stores: use documents"))
    few = _stores(rows, keep_secrets).limit(most + 1).agg(F.sort_array(F.collect_list(F.struct("store", "v", "t"))).alias("b"))
    return few.select(F.when(F.size("b") > most, told.cast("string")).otherwise(_document(F.array_join("b.v", ",\n"), F.array_join("b.t", ",\n"), timestamp, app_version)).alias("value"))


def _folder(spark: SparkSession, folder: str, timestamp: int) -> str:
    name = spark.range(1).select(shown(F.lit(timestamp), FILE_STAMP)).first()[0]
    return f"{folder}/settings_backup_{name}.json"


def write(rows: DataFrame, folder: str, timestamp: int, app_version: str, keep_secrets: bool = False) -> str:
    """Write the document as a text file below folder, in a sub-folder named by its time; returns that folder."""
    to_json(rows, timestamp, app_version, keep_secrets).coalesce(1).write.text(out := _folder(rows.sparkSession, folder, timestamp))
    return out


def write_documents(rows: DataFrame, folder: str, timestamp: int, app_version: str, keep_secrets: bool = False) -> str:
    """As write(), but a document for each store, as one line of text files, which read_documents() takes."""
    lines = documents(rows, timestamp, app_version, keep_secrets).select(F.replace("value", F.lit("\n"), F.lit(" ")).alias("value"))
    lines.write.text(out := _folder(rows.sparkSession, folder, timestamp))
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """parse of files with a document a line."""
    return parse(spark.read.text(path))


def restore(rows: DataFrame, ts: int) -> DataFrame:
    """Parsed rows as writes of the key-value log, all in one append; types outside the store's kinds are left out."""
    kept = rows.where(F.col("type").isin("boolean", "int", "bigint", "float", "double", "string")).where(F.col("value") != "***")
    return kept.select("store", "key", F.when(F.col("type") == "int", "bigint").when(F.col("type") == "double", "float").otherwise(F.col("type")).alias("type"), "value", F.lit(ts).cast("bigint").alias("ts"), F.xxhash64("store", "key").alias("seq"))
