"""Log tails as streams: stateless filters in append mode, latest values by key in update mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsledger.operators.relational import matching_lines


def tail(spark: SparkSession, folder: str, needles: Sequence[str] = (), files_per_batch: int = 100) -> DataFrame:
    """New lines of the text files that arrive in a folder; with needles, those that hold one, whatever the case."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return matching_lines(lines, needles) if needles else lines


def collect_lines(lines: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of lines to text files, exactly once; all that is there now, or every 10 seconds for ever."""
    writer = lines.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def latest(changes: DataFrame, key: str, time: str, seq: str) -> DataFrame:
    """The newest row of each key; on a stream use update or complete mode. State is one row a key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, seq)).alias("row")).select(key, "row.*")


def write_latest(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest rows of a stream in a Parquet folder, replaced by each batch; all that is there now."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return rows.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def every(hours: float) -> dict:
    """The trigger of a periodic job; conditions such as charging have no counterpart here."""
    return {"processingTime": f"{int(hours * 3600)} seconds"}
