"""Map expressions: settings and their like, as maps of strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(pairs: Column) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def masked(pairs: Column, pattern: str = r"(?i)password|secret|token", mask: str = "***") -> Column:
    """A map whose values of secret keys are masked."""
    return F.transform_values(pairs, lambda k, v: F.when(k.rlike(pattern), F.lit(mask)).otherwise(v))


def sorted_text(pairs: Column, order: Sequence[str] = ()) -> Column:
    """A map as text, [key=value,...]: keys of `order` first and in that order, the others by name."""
    rank = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), k), F.lit(0)), F.lit(len(order) + 1)) if order else F.lit(0)
    entries = F.array_sort(F.transform(F.map_entries(pairs), lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), F.coalesce(e["v"], F.lit("")))), ","), F.lit("]"))
