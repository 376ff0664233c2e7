"""Repeated runs of units (lines or sentences): find them over the whole corpus, and the units that later ones cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsledger.llm import bloom
from opsledger.llm.common import cut, fresh, remove, scratch, small_batches, small_by_bytes

#: A place of runs of their own widths: first unit * PLACE + width, which is below PLACE.
PLACE = 1 << 10
#: What a row that is broadcast takes besides its intervals.
ROW_BYTES = 64


def text_key(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(text)


def covered_intervals(runs: DataFrame, width: int | None) -> DataFrame:
    """(id, key, intervals): the unit ranges [start, end) of each document that a non-first repeated run covers.

    runs: id and key, which name a document (rows alike in both are one), pos (the run's first unit) and h1, h2 (two
    hashes of its text), one row per run of `width` units; without a width pos is a place as of PLACE, and equal runs
    are as wide. Of equal runs the one with the smallest (id, pos) is the first and covers nothing (each of them, if
    several texts of one id have it there).

    Runs are made once and written to the shared folder, in columns, until all is found. Their groups are aggregated
    before a shuffle; a Bloom filter of the groups of two runs or more is broadcast, and only runs that it lets through
    meet their groups, in a join that Spark may split where a run is hot.
    """
    spark, path = runs.sparkSession, scratch(runs.sparkSession, "runs")
    with small_batches(spark):
        runs.write.option("compression", "zstd").parquet(path)
    runs = spark.read.schema(runs.schema).parquet(path)
    place = F.struct("id", "pos")
    first = cut(runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    pieces = bloom.pieces_for(first.count())
    filter_ = bloom.once(bloom.spots(first, F.col("h1"), pieces))
    met = bloom.tested(bloom.spots(runs, F.col("h1"), pieces), filter_, "__may").where("__may").drop("__may").join(first, ["h1", "h2"])
    later = met.where(place != F.col("first")).select("id", "key", "pos").distinct()
    own = Window.partitionBy("id", "key").orderBy("pos")
    start, end = (F.col("pos"), F.col("pos") + width) if width is not None else (F.shiftright("pos", PLACE.bit_length() - 1), None)
    later = later.withColumn("start", start)
    later = later.withColumn("end", F.col("start") + F.col("pos").bitwiseAND(F.lit(PLACE - 1)) if end is None else end)
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(own))
    merged = islands.groupBy("id", "key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = cut(merged.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("intervals")))
    remove(spark, path)
    return out


def with_intervals(docs: DataFrame, id_: Column, text: Column, cover: DataFrame, name: str) -> DataFrame:
    """docs with the intervals of each, null for most, as a column.

    The intervals are broadcast where they are small; else a Bloom filter of the touched documents is, only those that
    it lets through are shuffled to their intervals, and the others pass.
    """
    own_id, own_key, may = fresh(docs, "__id", "__key", "__may")
    cover = cover.withColumnsRenamed({"id": own_id, "key": own_key, "intervals": name})
    size = F.size(name) * 16 + ROW_BYTES
    marked = small_by_bytes(cover, size)
    same = id_.eqNullSafe(F.col(own_id)) & (text_key(text) == F.col(own_key))
    if marked is not cover:
        return docs.join(marked, same, "left").drop(own_id, own_key)
    pieces = bloom.pieces_for(cover.count())
    filter_ = bloom.once(bloom.spots(cover, F.xxhash64(own_id, own_key), pieces))
    flagged = bloom.tested(bloom.spots(docs, F.xxhash64(id_.cast(cover.schema[own_id].dataType), text_key(text)), pieces), filter_, may)
    touched = flagged.where(may).drop(may).join(cover, same, "left").drop(own_id, own_key)
    return touched.unionByName(flagged.where(~F.col(may)).drop(may).withColumn(name, F.lit(None).cast(cover.schema[name].dataType)))


def inside(i: Column, intervals: Column) -> Column:
    """Whether unit i lies in one of the intervals."""
    return F.exists(intervals, lambda r: (i >= r["start"]) & (i < r["end"]))
