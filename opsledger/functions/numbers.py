"""Integer arithmetic as the operations data needs it: truncating, and guarded against zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB = 1024, 1_048_576


def whole_div(a: Column, b: Column | int) -> Column:
    """a / b, truncated toward zero; null where b is 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    """part * 100 / whole in whole percent, 0 where whole is 0."""
    return F.coalesce(whole_div(part * 100, whole), F.lit(0).cast("bigint"))


def truncated(x: Column) -> Column:
    """A number without its fraction."""
    return x.cast("int")


def kib(x: Column) -> Column:
    return whole_div(x, KIB)


def mib(x: Column) -> Column:
    return whole_div(x, MIB)


def scaled(x: Column, factor: float) -> Column:
    """x * factor in single precision, without fraction."""
    return (x.cast("float") * F.lit(factor).cast("float")).cast("int")


def block_space(block_size: Column, free: Column, total: Column) -> Column:
    """struct(used_mb, total_mb) of a volume; zeros where its numbers are unknown."""
    used = F.coalesce(mib((total - free) * block_size), F.lit(0).cast("bigint"))
    return F.struct(used.alias("used_mb"), F.coalesce(mib(total * block_size), F.lit(0).cast("bigint")).alias("total_mb"))


def memory(total: Column, free: Column, largest: Column) -> Column:
    """struct(used_mb, max_mb, available_mb) of a heap."""
    used, most = mib(total - free), mib(largest)
    return F.struct(used.alias("used_mb"), most.alias("max_mb"), (most - used).alias("available_mb"))
