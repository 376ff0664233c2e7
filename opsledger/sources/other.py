"""Command output, snapshot lists, executable headers, the folder catalogue, and report sinks."""

from __future__ import annotations

import atexit
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsledger.functions.rules import elf_ok

COMMAND = "command string, exit int, output string"
CATALOGUE = "name string, path string, description string, always_accessible boolean, available boolean"


def run_command(spark: SparkSession, args: Sequence[str], timeout: float = 60) -> DataFrame:
    """(command, exit, output): a command run on the driver, both of its streams as one text; exit -1 if it can't run."""
    try:
        done = subprocess.run(list(args), stdout=subprocess.PIPE, stderr=subprocess.STDOUT, timeout=timeout, check=False)
        row = (" ".join(args), done.returncode, done.stdout.decode("utf-8", "replace"))
    except (OSError, subprocess.TimeoutExpired) as e:
        row = (" ".join(args), -1, str(e))
    return spark.createDataFrame([row], COMMAND)


def snapshots(outputs: DataFrame, column: str = "output") -> DataFrame:
    """outputs with the column as a variant, null where it is no JSON (messages may be mixed in): no schema is guessed."""
    return outputs.withColumn("snapshots", F.try_parse_json(F.col(column)))


def executables(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, valid): files whose header is that of a 64-bit ARM position-independent executable.

    Spark's binaryFile source leaves out hidden and empty files, none of which are executables.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", elf_ok(F.col("content"), F.col("length")).alias("valid"))


def work_folder(spark: SparkSession) -> str:
    """A new path that driver and executors share: below spark.checkpoint.dir, or on one machine in a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="opsledger-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/opsledger/work-{uuid.uuid4().hex}"


def folder_catalogue(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """accessible() of rows of (name, path, description, always_accessible, available)."""
    return accessible(spark.createDataFrame(list(rows), CATALOGUE))


def accessible(folders: DataFrame) -> DataFrame:
    """The folders that are there always, or now."""
    return folders.where("always_accessible or available").drop("available")


def _entry() -> Column:
    return F.struct("name", "path", "description", F.col("always_accessible").alias("alwaysAccessible"))


def catalogue_lines(folders: DataFrame) -> DataFrame:
    """(value): each folder as a JSON object, every field escaped; a table of any size."""
    return folders.select(F.to_json(_entry()).alias("value"))


def catalogue_json(folders: DataFrame, most: int = 100_000) -> DataFrame:
    """(value): a catalogue as one JSON array, by name, every field escaped; an error for more than `most` folders."""
    told = F.raise_error(F.lit(f"more than {most} folders: use catalogue_lines"))
    few = folders.limit(most + 1).agg(F.sort_array(F.collect_list(_entry())).alias("all"))
    return few.select(F.when(F.size("all") > most, told.cast("string")).otherwise(F.to_json("all")).alias("value"))


def write_error_log(errors: DataFrame, folder: str, frames: int = 5) -> None:
    """Append error entries as text: a head line, the exception, the first frames, a blank line."""
    from opsledger.functions.times import shown

    stack = F.array_join(F.transform(F.slice("stack", 1, frames), lambda x: F.concat(F.lit("  at "), x, F.lit("\n"))), "")
    text = F.concat(shown(F.col("timestamp_ms")), F.lit(" ["), F.col("severity"), F.lit("] ["), F.col("id"), F.lit("] "), F.coalesce("message", F.lit("Unknown error")), F.lit("\nException: "), F.col("exception_class"), F.lit("\n"), F.coalesce(stack, F.lit("")))
    errors.select(text.alias("value")).write.mode("append").text(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A long-form report (section, n, line) as one text file, in order."""
    report.orderBy("section_no", "line_no").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(folder)
