"""Filters, lookups, joins, unions and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsledger.functions.text import contains_any
from opsledger.functions.times import older_than


def by_severity(errors: DataFrame, severity: str | None = None) -> DataFrame:
    """Entries of one severity; all for None."""
    return errors if severity is None else errors.where(F.col("severity") == severity)


def first_by_id(rows: DataFrame, key: str, value, order: Sequence[str]) -> DataFrame:
    """The first row with an id, by the given order: at most one."""
    return rows.where(F.col(key) == value).orderBy(*order).limit(1)


def missing(grants: DataFrame) -> DataFrame:
    """Rows that are not granted; an unknown grant is missing."""
    return grants.where(~F.coalesce(F.col("granted"), F.lit(False)))


def matching_lines(lines: DataFrame, needles: Sequence[str], column: str = "value") -> DataFrame:
    """Lines that hold a needle, whatever the case; works on streams too."""
    return lines.where(contains_any(F.col(column), needles))


def stale_files(files: DataFrame, now: Column, keep: Sequence[str], hours: int = 24) -> DataFrame:
    """Files and folders unchanged for more than `hours` whose names hold none of `keep` (case counts)."""
    return files.where(older_than(F.col("modified"), now, hours)).where(~contains_any(F.col("name"), keep, False))


def named_files(files: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Plain files by the two ends of their names."""
    return files.where(~F.col("is_dir") & F.col("name").startswith(prefix) & F.col("name").endswith(suffix))


def newest_first(rows: DataFrame, time: str, *ties: str) -> DataFrame:
    """Rows from the newest; ties by the given columns, so that the order is defined."""
    return rows.orderBy(F.col(time).desc(), *ties)


def ranked_newest(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """rows with their place, 1 the newest, within each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc(), tie)))


def newest(rows: DataFrame, n: int, time: str, seq: str) -> DataFrame:
    """The newest n rows: what a log of n entries keeps. A top-k: no full sort, no single window task."""
    return rows.orderBy(F.col(time).desc(), F.col(seq).desc()).limit(n)


def first_frames(rows: DataFrame, stack: str, n: int) -> DataFrame:
    """rows with their stack cut to the first n frames."""
    return rows.withColumn(stack, F.slice(stack, 1, n))


def with_notes(results: DataFrame, notes: DataFrame, key: str = "test") -> DataFrame:
    """Results with the note of their key, null without one. Spark picks the join from the tables' sizes."""
    return results.join(notes, key, "left")


def all_rows(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Tables of equal columns put together, repeated rows kept."""
    for other in more:
        first = first.unionByName(other)
    return first


def last_written(rows: DataFrame, keys: Sequence[str], time: str, seq: str) -> DataFrame:
    """The last row of each key by (time, seq): an upsert over an append-only table. One shuffle of partial maxima."""
    rest = [c for c in rows.columns if c not in keys]
    newest_row = F.max_by(F.struct(*rest), F.struct(time, seq)).alias("__row")
    return rows.groupBy(*keys).agg(newest_row).select(*keys, "__row.*")


def lookup(rows: DataFrame, key: str, value, column: str = "_data") -> DataFrame:
    """One column of the first row with a key: the one parametrised query of the inventory. Null value: any row."""
    found = rows if value is None else rows.where(F.col(key) == value)
    return found.select(column).limit(1)


def first_present(rows: DataFrame, key: str, candidates: str, present: str) -> DataFrame:
    """(key, choice): the first candidate of an array that is in the array of present ones, else null."""
    return rows.select(key, F.get(F.filter(candidates, lambda c: F.array_contains(F.col(present), c)), F.lit(0)).alias("choice"))
