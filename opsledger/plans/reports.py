"""Reports in long form: (section_no, section, line_no, line), so that they stay tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsledger.functions.times import shown
from opsledger.operators.aggregates import check_summary, timing_summary
from opsledger.operators.relational import with_notes

COLUMNS = ["section_no", "section", "line_no", "line"]


def _section(df: DataFrame, number: int, name: str, line: F.Column, order: F.Column | None = None) -> DataFrame:
    return df.select(F.lit(number).alias("section_no"), F.lit(name).alias("section"), (F.lit(0).cast("string") if order is None else order.cast("string")).alias("line_no"), line.alias("line"))


def workflow_report(validations: DataFrame) -> DataFrame:
    """A summary, and each workflow's status, message and details by name; of (workflow, success, message, details)."""
    s = check_summary(validations)
    lines = F.array(*[F.format_string(f"- {name}: %s", F.col(c).cast("string")) for name, c in (("Total Tests", "total"), ("Passed", "passed"), ("Failed", "failed"))], F.format_string("- Success Rate: %s%%", F.col("success_percent").cast("string")))
    summary = s.select(F.posexplode(lines).alias("i", "text"))
    word = F.when(F.coalesce("success", F.lit(False)), "PASSED").otherwise("FAILED")
    body = F.format_string("%s: %s | %s | %s", "workflow", word, F.coalesce("message", F.lit("")), F.coalesce("details", F.lit("")))
    return _section(summary, 1, "Summary", F.col("text"), F.col("i")).unionByName(_section(validations, 2, "Detailed Results", body, F.col("workflow")))


def self_test_report(results: DataFrame, notes: DataFrame) -> DataFrame:
    """Each test's result, by name, and its note if there is one; of (test, passed) and (test, note)."""
    both = with_notes(results, notes)
    line = F.concat(F.col("test"), F.lit(": "), F.when(F.coalesce("passed", F.lit(False)), "PASS").otherwise("FAIL"), F.coalesce(F.concat(F.lit("  Note: "), F.col("note")), F.lit("")))
    return _section(both, 1, "Test Results", line, F.col("test"))


def performance_report(timings: DataFrame, memory: DataFrame, storage: DataFrame) -> DataFrame:
    """Timings by tag, memory (used_mb, max_mb, available_mb), storage (used_mb, total_mb)."""
    t = timing_summary(timings)
    line = F.format_string("%s: avg=%sms, min=%sms, max=%sms, count=%s", "tag", *[F.col(c).cast("string") for c in ("avg_ms", "min_ms", "max_ms", "n")])
    text = lambda fmt, *cols: F.format_string(fmt, *[F.col(c).cast("string") for c in cols])
    memory_lines = memory.select(F.posexplode(F.array(text("Used Memory: %s MB", "used_mb"), text("Max Heap Size: %s MB", "max_mb"), text("Available Heap: %s MB", "available_mb"))).alias("i", "text"))
    return (_section(t, 1, "Operation Timings", line, F.col("tag")).unionByName(_section(memory_lines, 2, "Memory Usage", F.col("text"), F.col("i")))
            .unionByName(_section(storage, 3, "Storage Usage", text("Internal App Storage: %s MB used of %s MB", "used_mb", "total_mb"))))


def combined(*reports: DataFrame) -> DataFrame:
    """Reports one after another: section numbers go on."""
    out = None
    for i, report in enumerate(reports):
        own = report.withColumn("section_no", F.col("section_no") + 100 * i)
        out = own if out is None else out.unionByName(own)
    return out.select(*COLUMNS)


def error_details(errors: DataFrame, frames: int = 15) -> DataFrame:
    """(id, details) of errors (id, timestamp_ms, severity, message, exception_class, cause, stack)."""
    stack = F.array_join(F.transform(F.slice("stack", 1, frames), lambda x: F.concat(F.lit("  at "), x)), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("Error ID: "), "id"), F.concat(F.lit("Time: "), shown(F.col("timestamp_ms"))), F.concat(F.lit("Severity: "), "severity"), F.concat(F.lit("Message: "), F.coalesce("message", F.lit("Unknown error"))),
                       F.lit(""), F.concat(F.lit("Exception: "), "exception_class"), F.concat(F.lit("Cause: "), F.coalesce("cause", F.lit("Unknown"))), F.lit(""), F.lit("Stack trace:"), stack)
    return errors.select("id", text.alias("details"))
