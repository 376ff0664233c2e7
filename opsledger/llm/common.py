"""Shared pieces of the corpus operators: the shared folder, word patterns, checkpoints, connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges of a task of the components, about, and such tasks at least (or as many as there are partitions).
TASK_EDGES, TASKS = 1 << 16, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a folder of our own.

    A session with neither a checkpoint folder nor a local master is refused, since a machine-local folder would
    lose files there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    set_already = context._jsc.sc().getCheckpointDir()
    if not base and set_already.isDefined():
        base = set_already.get()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="opsledger-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not set_already.isDefined():
        context.setCheckpointDir(base)
    return str(base)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Jobs that run within exchange Arrow batches of at most so many bytes with Python workers, long texts apart."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, with small_batches().

    They stay there after use, unless the session sets spark.cleaner.referenceTracking.cleanCheckpoints, by which Spark
    removes them with the DataFrame.
    """
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/opsledger/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder by Hadoop's file system, whatever the store."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free() -> None:
    """Give memory that nothing uses any more back to the system: Arrow's, numpy's, Python's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def freeing(f):
    """f, which makes batches from batches, with free() at the task's end: workers wait for tasks with little memory."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            free()

    return run


def freeing_group(f):
    """f, which makes a table from a group's table, with free() after it."""

    def run(table):
        try:
            return f(table)
        finally:
            free()

    return run


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Where every character is one byte, lower() does just that and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int = 64 << 20) -> bool:
    """Whether the rows of a computed table, at most row_bytes each, stay below the limit for a broadcast."""
    return df.count() * row_bytes <= limit_bytes


def pieces(spark: SparkSession, total: int, most: int, least: int) -> int:
    """Pieces of a total: so many that none exceeds `most`, and as many as shuffles have, but none below `least`."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(total // most + 1, min(wanted, total // least + 1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A computed table, marked for broadcast where its counted rows are few enough; else Spark joins it by shuffle."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


def small_by_bytes(df: DataFrame, size: Column, limit_bytes: int = 64 << 20) -> DataFrame:
    """As small(), for rows of no bounded size: the sum of `size` over the rows of a computed table decides."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit_bytes else df


def local_table(spark: SparkSession, **columns) -> DataFrame:
    """A small table of Arrow arrays, which takes no Python worker to make, as rows of Python would."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column (long) that numbers its rows, the same each time they are read: by file and place in the file.

    The driver gets the names of the files, which Spark's own listing holds too. Tables that aren't read from Parquet
    files are kept in the shared folder first, with their numbers.
    """
    import pyarrow as pa

    path, at, number = fresh(docs, "path", "at", "number")
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        return cut(docs.withColumn(name, F.monotonically_increasing_id()))
    names = sorted(r[0] for r in placed.select(path).distinct().collect())
    files = local_table(docs.sparkSession, **{path: pa.array(names, pa.string()), number: pa.array(range(len(names)), pa.int64())})
    joined = placed.join(small_by_bytes(files, F.octet_length(path) + 16), path)
    return joined.select(*docs.columns, (F.shiftleft(number, 40) + F.col(at)).alias(name))


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step on edges (u, v), in so many tasks: neighbours attach to the smallest node that u sees."""
    edges = edges.coalesce(parts)
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        seen = edges.unionByName(back).coalesce(parts).distinct().coalesce(parts)
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(parts)
    lowest = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = seen.join(lowest, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").coalesce(parts).distinct().coalesce(parts)


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node it reaches.

    Alternating large and small star steps; each round is a few shuffles of the edges, kept in the shared folder, and
    the number of rounds grows with the logarithm of the longest path. Tasks have TASK_EDGES edges each, so that few edges
    don't make a file for each of a shuffle's partitions and each round, all of which wait on disk for Spark's cleaner. Edges with a null end or one end are ignored.
    Nodes of any orderable type. Only two numbers of each round reach the driver.
    """
    edges = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state, parts = tuple(now), max(TASKS, -(-now[0] // TASK_EDGES))
        edges = cut(_star(_star(edges, True, parts), False, parts))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
