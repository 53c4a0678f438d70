"""What several operators of this package share: words, tables, Python batches and cut lineage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the space and the characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Only in local mode, and where none is named (tests), is a local one set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(f"{tempfile.gettempdir()}/argentum-checkpoints-{context.applicationId}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, with no lineage before them.

    A checkpoint also keeps what Spark has inferred of the rows: constraints, partitionings, and a size that
    each join multiplies. Over many rounds these grow until the driver has no time and memory left. So the
    checkpoint's rows get a plan of their own, of which nothing is known but the schema.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


#: A key is hot if it holds more rows than this, and more than half of a task's even share.
HOT_ROWS = 1000


def meet(big: DataFrame, small: DataFrame, on: list[str], n: str) -> DataFrame:
    """The inner join of big with small, which has one row for each key, and under n how many rows of big have it.

    Rows of hot keys meet a broadcast instead of one task. A hot key has more than a (2 x tasks)th of all rows, so
    there are fewer of them than twice the tasks. Both tables should be cut already, as they are read more than once.
    """
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, most = small.agg(F.sum(n), F.max(n)).first()
    limit = max(HOT_ROWS, (rows or 0) // (2 * tasks))
    if (most or 0) <= limit:
        return big.join(small.drop(n), on)
    hot = small.filter(F.col(n) > limit).drop(n)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(F.col(n) <= limit).drop(n), on)
    return big.join(F.broadcast(hot), on).unionByName(rest)


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/argentum-{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about most_bytes of the text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(n)
        yield batch.slice(start)


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on idle between stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_store() -> dict:
    """What this Python worker keeps from task to task. It hangs on a module of its own, as functions come by value."""
    return sys.modules.setdefault("argentum_worker_store", types.ModuleType("argentum_worker_store")).__dict__.setdefault("kept", {})


def drop_kept() -> None:
    """Empties the worker's store, so that a stage that doesn't use it has that memory."""
    worker_store().clear()
    give_back()


def ship(module) -> None:
    """Sends this module's functions to the Python workers by value, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(module)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Batches of texts that go to Python hold some MB, so that workers and the JVM's buffers stay small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, most)
