"""Mixing sources to target weights by entropy balancing: tilted document rates, rounded into copies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import WORD, cut, freeing_group, local_table, small_by_bytes

#: No document is taken more often than this.
MOST = 2.0
#: Documents of a source that are rounded together.
BLOCK = 1000
#: Relative error of a source's tokens at which Newton stops, and its most iterations (bisection guards each step).
CLOSE, STEPS = 1e-7, 60


def _row_bytes() -> F.Column:
    """What a row of a table by source (s) takes, in bytes."""
    return F.coalesce(F.octet_length("s"), F.lit(0)) + 100


def ranked(table: DataFrame, column: str) -> DataFrame:
    """A table of distinct values of a column with `rank`, 0 the smallest by code point, null last.

    Ranges of values are sorted in parallel; the driver gets one count of rows for each range.
    """
    order = F.col(column).asc_nulls_last()
    dealt = cut(table.repartitionByRange(order).sortWithinPartitions(order).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("__range").count().collect()):
        offsets.append((r["__range"], before))
        before += r["count"]
    starts = local_table(table.sparkSession, __range=pa.array([x for x, _ in offsets], pa.int32()), __before=pa.array([x for _, x in offsets], pa.int64()))
    return dealt.join(F.broadcast(starts), "__range").withColumn("rank", F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float = MOST) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    The sources share `share` of all sizes by weight; a target stops at `most` times its source's size, and the excess
    is reshared by weight among the others until none is above. Each round sums, over the table of sources, what full
    sources take and what the others weigh, which gives the level, the target of a source of weight 1; it rises until
    no further source is full. Only these sums reach the driver, and nothing is sorted in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighted = cut(ranked(totals, "source").withColumn("weight", weight).withColumn("room", most * F.col("source_size")).drop("rank"))
    exact = "decimal(38,6)"
    budget = float(share * (weighted.agg(F.sum("source_size")).first()[0] or 0))
    level, full = 0.0, -1
    while True:
        held = F.col("room") <= level * F.col("weight")
        now = weighted.agg(F.count_if(held), F.sum(F.when(held, F.col("room").cast(exact))), F.sum(F.when(~held, F.col("weight").cast(exact)))).first()
        if now[0] == full or now[2] is None:
            break
        full, level = now[0], max(level, (budget - float(now[1] or 0)) / float(now[2]))
    return weighted.select("source", "source_size", F.least(level * F.col("weight"), "room").alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """(source, tilt, scale): the dual solution; a document's rate is least(most, exp(tilt * size / scale)).

    Among all rates in [0, most] that meet each source's token target, these stay closest to one copy a document in
    relative entropy. The dual is one convex function per source, since a source's tokens constrain only its own
    documents; each iteration sums its gradient and curvature over the histogram (source, size, n) in parallel, in
    decimals so that the order of summing does not matter, and takes a Newton step, or halves the bracket where that
    would leave it. A full source gets null (rate `most`), an empty target too small a tilt to take anything.
    """
    state = cut(targets.where("target > 0 and target < source_size * " + repr(most * (1 - 1e-12))).join(
        histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"), F.max("size").alias("longest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest")).withColumnRenamed("source", "s"),
        F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "target", "scale", F.lit(0.0).alias("tilt"), (F.lit(-60.0) * F.col("scale") / F.col("shortest")).alias("low"), (F.lit(1.0) * F.col("scale") / F.col("shortest")).alias("high"), F.lit(False).alias("done")))
    for _ in range(STEPS):
        now = state.select(F.col("source").alias("s"), "tilt", "scale")
        exact = "decimal(38,6)"
        z = F.col("size") / F.col("scale")
        rate = F.least(F.lit(most), F.exp(F.col("tilt") * z))
        part = histogram.join(small_by_bytes(now, _row_bytes()), F.col("source").eqNullSafe(F.col("s"))).select(
            "source", (F.col("n") * F.col("size") * rate).cast(exact).alias("g"),
            F.when(F.col("tilt") * z < math.log(most), F.col("n") * F.col("size") * z * rate).otherwise(0.0).cast(exact).alias("h"))
        sums = part.groupBy("source").agg(F.sum("g").cast("double").alias("g"), F.sum("h").cast("double").alias("h")).withColumnRenamed("source", "s")
        over = F.col("g") > F.col("target")
        met = state.join(sums, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(over, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") - (F.col("g") - F.col("target")) / F.col("h")
        inside = (F.col("h") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        good = F.abs(F.col("g") - F.col("target")) <= CLOSE * F.col("target")
        state = cut(met.withColumn("done", F.col("done") | good).withColumn("tilt", F.when(F.col("done"), F.col("tilt")).otherwise(step)).select("source", "target", "scale", "tilt", "low", "high", "done"))
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "tilt", "scale")


def _round(table: pa.Table) -> pa.Table:
    """Copies of a block's documents, longest first; each is rounded to where the block's error is least."""
    rows = zip(*(table[c].to_pylist() for c in ("size", "id", "row", "rate")))
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] is None, () if r[1] is None else (r[1],), r[2]))
    copies, error = [], 0.0
    for size, _, _, rate in ordered:
        low = int(rate)
        want = rate * size + error
        take = low + (1 if rate > low and abs(want - (low + 1) * size) < abs(want - low * size) else 0)
        error = want - take * size
        copies.append(take)
    return pa.table([pa.array([r[2] for r in ordered], pa.int64()), pa.array(copies, pa.int64())], names=["row", "copies"])


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = MOST, row_col: str | None = None) -> DataFrame:
    """(id, size, source, source_size, target, rate, copies): how often the mix takes each document; with row_col, a
    long, that as `key` too.

    Sizes are counted in words of the whole text, null as 0. Rates come from the entropy balance; blocks of about
    BLOCK documents of one source, dealt by a hash of the row, are rounded longest first with the error carried on, so
    a block misses its tokens by about half its shortest document. Copies are 0 to `most`. Null sources are a source;
    documents of size 0 get one copy, which takes nothing. Rows that repeat are documents of their own; a block that
    they crowd (or null ids of one size) is cut into several by row. Ties are dealt by the row's hash, and all sums are
    exact, so that reruns on the same files agree. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    sized = cut(docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(source_col).alias("source"), size.alias("size")))
    targets = cut(source_targets(sized, weights, share, most))
    histogram = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    found = tilts(histogram, targets, most)
    counted = histogram.groupBy("source").agg(F.sum("n").alias("docs"))
    plan = targets.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = cut(plan.join(counted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s"))
    tilted = F.least(F.lit(most), F.exp(F.col("tilt") * F.col("size") / F.col("scale")))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), F.lit(most)).otherwise(tilted)
    rated = cut(sized.join(small_by_bytes(plan, _row_bytes()), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({
        "rate": F.round(rate, 9), "row": F.monotonically_increasing_id(),
        "block": F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("docs") / BLOCK)),
    }))
    crowded = cut(rated.groupBy("source", "block").agg(F.count("*").alias("rows")).where(F.col("rows") > 4 * BLOCK).withColumnsRenamed({"source": "s", "block": "b"}))
    fine = rated.select("id", "source", "block", "size", "rate", "row")
    fine = fine.join(small_by_bytes(crowded, _row_bytes()), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    parts = F.coalesce(F.ceil(F.col("rows") / BLOCK), F.lit(1))
    fine = fine.withColumn("part", F.pmod(F.xxhash64("row"), parts)).drop("s", "b", "rows")
    copies = fine.groupBy("source", "block", "part").applyInArrow(freeing_group(_round), "row long, copies long")
    return rated.join(copies, "row").select(F.col("id").alias(id_col), *["key"][: row_col is not None], "size", "source", "source_size", "target", "rate", "copies")
