"""Shared plumbing: scratch tables, worker state, null-safe column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import textloom.llm as _package

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(_package)

#: Words of a text, as the contracts of the near-duplicate and mixing operators define them.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of ids and small numbers may be broadcast (at most some 30 MB).
BROADCAST_ROWS = 400_000


#: Bounds of an Arrow batch that holds whole texts, where an operator writes its tables itself:
#: rows, and bytes beyond which no further row is added.
ARROW_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}

#: Bytes of input after which a worker hands freed memory back.
TRIM_BYTES = 8 << 20


def shorten_batches(spark: SparkSession) -> dict[str, str]:
    """From now on the session keeps the batches it sends to a Python worker within ARROW_BOUNDS; returns what was set."""
    before = {key: spark.conf.get(key) for key in ARROW_BOUNDS}
    for key, most in ARROW_BOUNDS.items():
        if not (before[key].isdecimal() and 0 < int(before[key]) <= most):
            spark.conf.set(key, str(most))
    return before


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, the session keeps the batches it sends to a Python worker within ARROW_BOUNDS; afterwards as before."""
    before = shorten_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of our own, by application, where a local session names no shared one.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the checkpoint folder names it.

    Only a local session, where driver and executors are one process, may go without: it gets a
    temporary folder.  On a cluster that folder would be another on each machine, so this raises.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if where:
        return where
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _own_dirs[sc.applicationId]


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    They stay until the session's process ends, as lazy results may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_remove, fs, path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


def bucketed(rows: DataFrame, scratch: Scratch, name: str, buckets: int) -> DataFrame:
    """Writes rows to the shared folder as a table bucketed by ``block``, which joins on it without moving the rows."""
    spark, table = rows.sparkSession, f"textloom_{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "block").option("path", f"{scratch.root}/{name}").format("parquet").saveAsTable(table)
    atexit.register(_forget, spark, table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"drop table if exists {table}")
    except Exception:  # the session may already be gone when the process ends
        pass


def _remove(fs: Any, path: Any) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the JVM may already be gone when the process ends
        pass


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks, until another name is asked for.

    Workers outlive a stage of a pipeline; what its operator kept is freed when the next one starts.
    """
    holder = sys.modules.setdefault("_textloom_worker_state", types.ModuleType("_textloom_worker_state"))
    if getattr(holder, "name", name) != name:
        holder.state.clear()
        release_memory()
        holder.state = {}
    elif not hasattr(holder, "state"):
        holder.state = {}
    holder.name = name
    return holder.state


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into short ones, so that only a few texts are Python objects at a time.

    Freed memory goes back to the system on the way, or a worker would keep the most it ever held.
    """
    passed = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        passed += batch.nbytes
        if passed >= TRIM_BYTES:
            del batch
            _trim()
            passed = 0


def release_memory() -> None:
    """Hands freed memory back to the system, as far as its C library can."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most ``limit`` rows; looks no further than that.

    It runs df as far as that, so df should be a written table or a cheap scan.
    """
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (see ``small``) with a broadcast hint if its measured row count allows; else Spark shuffles it."""
    return F.broadcast(df) if small(df, limit) else df


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column of docs has it (in any case)."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def packed_rows(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that helper columns beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def unit_interval(*columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))
