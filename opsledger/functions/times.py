"""Times: epoch milliseconds and time stamps, shown in the session's zone (pin it to UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOWN, FILE_STAMP, REPORT_STAMP = "yyyy-MM-dd HH:mm:ss", "yyyyMMdd_HHmmss", "yyyy-MM-dd_HH-mm-ss"


def stamped(ts: Column, pattern: str = SHOWN) -> Column:
    """A time stamp as text. Patterns begin with the year, which has no sign beyond 9999 either."""
    return F.ltrim(F.date_format(ts, pattern), F.lit("+"))


def shown(epoch_ms: Column, pattern: str = SHOWN) -> Column:
    """Epoch milliseconds as text."""
    return stamped(F.timestamp_millis(epoch_ms), pattern)


def older_than(modified: Column, now: Column, hours: int) -> Column:
    """Whether modified lies more than so many hours before now; exactly so many is not older."""
    return modified < now - F.make_dt_interval(F.lit(0), F.lit(hours))


def last_run_status(epoch_ms: Column, success: Column) -> Column:
    """Text of the last run: null where none has run (0 or null)."""
    word = F.when(F.coalesce(success, F.lit(False)), "Success").otherwise("Failed")
    return F.when(F.coalesce(epoch_ms, F.lit(0)) != 0, F.format_string("Last backup: %s (%s)", shown(epoch_ms), word))
