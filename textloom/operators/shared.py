"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers and names may be broadcast.
BROADCAST_ROWS = 200_000

#: Whether Spark deletes a query's shuffle files at its end, not when the driver's memory is next cleared up.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Most bytes of an Arrow batch; below the greatest value Spark sums up the batch's bytes at every row, which for lists takes longer than sending them.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir or the checkpoint folder names; only a local session, one process, may go without."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _own[sc.applicationId]


class Tables:
    """Named tables of one computation; they go when the process ends, as lazy results may read them until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        atexit.register(_forget, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)

    def put(self, rows: DataFrame, name: str, by: str | None = None, short: bool = False) -> DataFrame:
        """The rows, written; a reader that filters by the column ``by`` (of few values) opens only its files.  What was shuffled for them goes at once.

        ``short``: all rows that go to Python are so short that their number is bound enough for a batch.
        """
        held = {CLEANUP: "true"} | ({BATCH_BYTES: str((1 << 31) - 1)} if short else {})
        was = {k: self.spark.conf.get(k, None) for k in held}
        for k, v in held.items():
            self.spark.conf.set(k, v)
        try:
            (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}").select(*(f"`{c}`" for c in rows.columns))

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(files: Any, path: Any) -> None:
    try:
        files.delete(path, True)
    except Exception:  # the JVM may be gone by then
        pass


def near(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows (a written table) with a broadcast hint if they are few by count; else Spark shuffles them."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows
