"""Exact deduplication by two Bloom passes: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm import bloom
from opsledger.llm.common import cut, lower_az, small

#: Passes of the second kind, at most; beyond what they cover a filter has fewer bits a row.
MOST_PASSES = 16


def repeated(keyed: DataFrame, key: str, pass_bits: int = bloom.MOST_BITS, passes: int = MOST_PASSES) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may occur twice, rows whose key surely occurs once) of a computed table; null keys occur once.

    First pass: each key sets two bits of a Bloom filter, sharded by hash range; the bits that two rows set are found
    from the tasks' bitmaps. Second pass: a row is suspect if both its bits were set twice. A filter has 16 bits a row.
    Of more than pass_bits (64 MiB, which bounds what is broadcast) it is cut into hash ranges, each with a pass of its
    own over the narrow table, up to `passes` of them, that is half a billion rows; beyond, more and more rows are
    suspect, and results stay the same.
    """
    rows = max(1, keyed.count())
    pieces = bloom.pieces_for(rows, pass_bits * passes)
    spotted = bloom.spots(keyed, F.xxhash64(key), pieces)
    spotted = spotted.withColumn("__piece", F.when(F.col(key).isNotNull(), F.col("__piece")))
    step, parts = max(1, pass_bits // bloom.PIECE_BITS), []
    for low in range(0, pieces, step):
        own = spotted if pieces <= step else spotted.where(F.col("__piece").between(low, low + step - 1))
        parts.append(cut(bloom.tested(own, bloom.twice(own), "suspect")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if pieces > step:
        out = out.unionByName(keyed.where(F.col(key).isNull()).withColumn("suspect", F.lit(False)))
    return out.where("suspect").drop("suspect"), out.where("not suspect").drop("suspect")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays, a null id being the smallest; of rows that tie in id too, one stays and the rest are dropped.
    Empty tables give no rows; other columns are ignored, whatever their names. Only hashes, never texts, are kept or
    shuffled, and of those only the suspect ones; a group of copies is aggregated before its shuffle, and its result is
    broadcast where such groups are few, else joined by a shuffle that Spark may split.
    """
    sha = F.sha2(F.encode(lower_az(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256)
    hashed = cut(docs.select(F.col(id_col).alias("id"), F.unhex(sha).alias("sha")).withColumn("row", F.monotonically_increasing_id()))
    suspect, lone = repeated(hashed, "sha")
    alone = lone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    groups = cut(suspect.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("best")))
    shared = suspect.join(small(groups, 150), "sha").select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    out = alone.unionByName(shared)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
