"""Summaries: each one partial aggregation before one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsledger.functions.numbers import kib, percent, truncated
from opsledger.functions.rules import is_active
from opsledger.operators.relational import stale_files


def timing_summary(timings: DataFrame) -> DataFrame:
    """(tag, avg_ms, min_ms, max_ms, n) of (tag, ms); the average loses its fraction. A tag of nulls alone has nulls and 0."""
    return timings.groupBy("tag").agg(truncated(F.avg("ms")).alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.count("ms").alias("n"))


def measured(timings: DataFrame, tag: str, ms: Sequence[int]) -> DataFrame:
    """timings with measurements of a tag appended."""
    return timings.unionByName(timings.sparkSession.createDataFrame([(tag, int(x)) for x in ms], "tag string, ms bigint"))


def tree_size(files: DataFrame) -> DataFrame:
    """(root, bytes, files) of (root, length, is_dir): hidden and empty files count, folders have no length."""
    return files.where(~F.col("is_dir")).groupBy("root").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def cleanup_totals(files: DataFrame, now: Column, keep: Sequence[str], hours: int = 24) -> DataFrame:
    """(candidates, freed_bytes, freed_kb): all stale entries count, bytes are of plain files alone."""
    freed = F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("length"))), F.lit(0).cast("bigint"))
    return stale_files(files, now, keep, hours).agg(F.count("*").alias("candidates"), freed.alias("freed_bytes"), kib(freed).alias("freed_kb"))


def check_summary(results: DataFrame, success: str = "success") -> DataFrame:
    """(total, passed, failed, success_percent); no rows: zeros."""
    total, passed = F.count("*"), F.count_if(F.coalesce(F.col(success), F.lit(False)))
    return results.agg(total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"), percent(passed, total).alias("success_percent"))


def all_passed(results: DataFrame, success: str = "success", by: Sequence[str] = ()) -> DataFrame:
    """Whether all rows succeed, for each `by`; no rows at all: true."""
    return results.groupBy(*by).agg(F.coalesce(F.bool_and(F.coalesce(F.col(success), F.lit(False))), F.lit(True)).alias("all_passed"))


def any_active(jobs: DataFrame, state: str = "state") -> DataFrame:
    """(active): whether a job waits or runs; no rows: false."""
    return jobs.agg(F.coalesce(F.bool_or(is_active(F.col(state))), F.lit(False)).alias("active"))


def joined_names(rows: DataFrame, by: Sequence[str], column: str, separator: str = ", ") -> DataFrame:
    """An ordered join of a column's values for each key; for groups whose text fits a row."""
    return rows.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(column)), separator).alias("names"))


def workflow_results(steps: DataFrame) -> DataFrame:
    """(workflow, success, message, details) of observed steps (workflow, step, ok, message).

    A workflow passes if all its steps do (an unknown one fails); the message is that of its first failing step.
    """
    failed = ~F.coalesce("ok", F.lit(False))
    first = F.min(F.when(failed, F.struct("step", "message")))["message"]
    found = steps.groupBy("workflow").agg(F.count_if(failed).alias("failures"), first.alias("why"), F.count("*").alias("n"))
    message = F.when(F.col("failures") == 0, "all steps passed").otherwise(F.coalesce("why", F.lit("failed")))
    return found.select("workflow", (F.col("failures") == 0).alias("success"), message.alias("message"), F.concat(F.lit("Steps: "), F.col("n").cast("string")).alias("details"))
