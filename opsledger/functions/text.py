"""String expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, needles: Iterable[str], ignore_case: bool = True) -> Column:
    """Whether text holds one of the needles; false for null text."""
    body = F.lower(text) if ignore_case else text
    found = F.lit(False)
    for needle in needles:
        found = found | body.contains(needle.lower() if ignore_case else needle)
    return F.coalesce(found, F.lit(False))


def without_prefix(text: Column, prefix: str) -> Column:
    """text without a leading prefix."""
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def after_last(text: Column, mark: str) -> Column:
    """What follows the last mark; the whole text without one."""
    return F.substring_index(text, mark, -1)


def trimmed(text: Column) -> Column:
    """text without white space, line ends too, at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """Whether text is null or white space only."""
    return F.coalesce(trimmed(text) == "", F.lit(True))


def head(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.left(text, F.lit(n))


def int_or(text: Column, default: int) -> Column:
    """text as an int, default where it is none: signs and digits alone count."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")), F.lit(default))


def short_id(*parts: Column) -> Column:
    """Eight hex digits from the hash of the parts: the same for the same row, unlike a random id."""
    return F.left(F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts])), F.lit(8))


def one_line(items: Column, separator: str = ", ") -> Column:
    """An array's items in order as one string."""
    return F.array_join(F.array_sort(items), separator)
