"""Bloom filters of 64-bit hashes by SQL functions: bitmaps of pieces, made in parallel, of bounded size, and tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import cut, fresh, small

#: Bits of one piece of a filter, as bitmap_construct_agg makes them; what a piece takes when it is broadcast.
PIECE_BITS, PIECE_BYTES = 32768, 4096
#: Bits of a filter for each hash, and of one that is broadcast at most (64 MiB).
BITS_PER_ROW, MOST_BITS = 16, 1 << 29


def pieces_for(rows: int, most_bits: int = MOST_BITS) -> int:
    """Pieces of a filter for so many hashes: a power of two."""
    return min(most_bits, max(PIECE_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length())) // PIECE_BITS


def spots(df: DataFrame, h: Column, pieces: int) -> DataFrame:
    """df with __piece, __a, __b: the two bits of a hash in one piece; null for a null hash."""
    low = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(PIECE_BITS - 1)).cast("smallint")
    return df.withColumns({"__piece": F.pmod(h, F.lit(pieces)).cast("int"), "__a": low(34), "__b": low(49)})


def once(spotted: DataFrame) -> DataFrame:
    """(__piece, __bits): the bits that any row sets. Bitmaps are made before their shuffle."""
    both = spotted.where("__piece is not null").select("__piece", F.explode(F.array("__a", "__b")).alias("__bit"))
    return both.groupBy("__piece").agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bits"))


def twice(spotted: DataFrame) -> DataFrame:
    """(__piece, __bits): the bits that two rows or more set.

    Each task folds its rows' bits to one row a piece, of two bytes a bit, which is dealt by piece and task; there, bits
    the task sets twice are told apart, and one row a piece and task, with every bit once or twice, meets those of the
    other tasks. So no row of the table is shuffled, and copies are folded before any two tasks meet.
    """
    own = spotted.where("__piece is not null").select(F.spark_partition_id().alias("__task"), "__piece", "__a", "__b")
    folded = own.groupBy("__piece", "__task").agg(F.sort_array(F.concat(F.collect_list("__a"), F.collect_list("__b"))).alias("__set"))
    again = F.array_distinct(F.filter("__set", lambda x, i: F.get(F.col("__set"), i - 1) == x))
    met = folded.select("__piece", F.concat(F.array_distinct("__set"), again).alias("__set")).repartition("__piece")
    counted = met.select("__piece", F.explode("__set").alias("__bit")).groupBy("__piece", "__bit").count().where("count > 1")
    return counted.groupBy("__piece").agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bits"))


def tested(spotted: DataFrame, filter_: DataFrame, name: str) -> DataFrame:
    """spotted with a boolean column: whether the filter, which is broadcast, has both bits. Its spots go."""

    def is_set(bit: str) -> Column:
        at = F.col(bit).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1

    met = spotted.join(F.broadcast(filter_), "__piece", "left")
    return met.withColumn(name, F.coalesce(is_set("__a") & is_set("__b"), F.lit(False))).drop("__piece", "__a", "__b", "__bits")


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key (long, never null) is in the one column of gone.

    The keys are broadcast where they are few; else a Bloom filter of them is. Of rows that it lets through, which are
    most where most go, only the keys are shuffled; those that aren't gone after all are few, and broadcast in their turn.
    """
    name, may = fresh(docs, "gone", "may")
    gone = cut(gone.toDF(name).distinct())
    marked = small(gone, 24)
    if marked is not gone:
        return docs.join(marked, F.col(key) == F.col(name), "left_anti")
    pieces = pieces_for(gone.count())
    flagged = tested(spots(docs, F.xxhash64(key), pieces), once(spots(gone, F.xxhash64(name), pieces)), may)
    stays, = fresh(docs, "stays")
    doubtful = cut(flagged.where(may).select(F.col(key).alias(stays)).join(gone, F.col(stays) == F.col(name), "left_anti").distinct())
    kept = flagged.where(may).join(small(doubtful, 24), F.col(key) == F.col(stays), "left_semi")
    return kept.unionByName(flagged.where(~F.col(may))).drop(may)


def only(docs: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """docs' rows whose key (long) is in the one column of kept, a computed table; as without(), few rows else shuffle."""
    name, may = kept.columns[0], fresh(docs, "may")[0]
    marked = small(kept, 24)
    if marked is kept:
        pieces = pieces_for(kept.count())
        docs = tested(spots(docs, F.xxhash64(F.col(key).cast("long")), pieces), once(spots(kept, F.xxhash64(name), pieces)), may).where(may).drop(may)
    return docs.join(marked, F.col(key) == F.col(name), "left_semi")
