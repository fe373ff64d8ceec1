"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, maybe_broadcast

#: UTF-8 bytes of text meant for one bucket; a bucket is shuffled in one task's memory.
BUCKET_BYTES = 16 << 20

#: Rows meant for one bucket at most, for tables of very short texts.
BUCKET_ROWS = 50_000

#: Rows alike in id and text above which they are numbered and dealt apart.
HOT_ROWS = 2_000

#: Tasks that the buckets are dealt to, at most.
TASKS = 20_000

#: Buckets whose places are summed up in one task.
GROUP = 4_096


def _apart(own: DataFrame, scratch: Scratch) -> DataFrame:
    """own with ``nth``: 0, but a running number for rows that more than HOT_ROWS others equal in id and text.

    Such rows are counted, not gathered; any of them may have any of the numbers.
    """
    keyed = own.withColumn("h", F.xxhash64("text"))
    counts = keyed.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    hot = scratch.put(counts.filter(F.col("rows") > HOT_ROWS).select(F.col("doc_id").alias("id"), F.col("h").alias("g")), "hot")
    cold = own.withColumn("nth", F.lit(0).cast("long"))
    if hot.isEmpty():
        return cold
    same, hot = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), maybe_broadcast(hot)
    rest = keyed.join(hot, same, "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("nth"))
    counted = keyed.join(hot, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("rows"))
    return rest.unionByName(counted.select("doc_id", "text", F.explode(F.expr("sequence(1L, rows)")).alias("nth")))


def _places(counts: DataFrame) -> DataFrame:
    """``bucket, start``: where each bucket begins, from ``bucket, rows``; no window spans more than GROUP buckets or all groups."""
    grouped = counts.withColumn("group", F.floor(F.col("bucket") / GROUP))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(F.sum("rows").alias("all")).select("group", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("before", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(groups, "group")
    return placed.select("bucket", (F.col("offset") + F.col("before")).cast("long").alias("start"))


def shuffle_into_shards(
    docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Returns ``doc_id, text, shard, slot``: a seeded random order of all rows, cut into shards.

    Pass one deals the rows into buckets by a seeded hash of id and text; how many
    buckets follows from the measured bytes, so each fits a task's memory.  Pass
    two sorts each bucket by id and text, so that the order rows arrived in does
    not matter, and applies a Fisher-Yates shuffle (numpy's) seeded by the bucket.  The
    buckets one after the other are the shuffled table; shard ``s`` of ``n`` holds its
    places ``s*N/n`` up to ``(s+1)*N/n``, so row counts differ by one at most, and
    ``slot`` counts each shard's rows from 0.

    Null texts stay null, null ids are dealt like any other, repeated rows each
    get a place of their own (those that very many rows equal are numbered first and
    dealt to all buckets), an empty table gives none; other columns are not
    read.  Ids keep their type and value.  With fewer rows than shards the last shards may be empty.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n, total = own.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes), math.ceil(n / BUCKET_ROWS))
    dealt = _apart(own, scratch).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "nth"), F.lit(buckets)).cast("long"))
    starts = scratch.put(_places(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))), "starts")
    out = T.StructType([own.schema["doc_id"], own.schema["text"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    firsts = np.array([s * n // shards for s in range(shards + 1)], np.int64)

    def fisher_yates(rows: pa.Table, start: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start").to_numpy().copy()
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
        at = start.column("start")[0].as_py() + np.arange(len(order), dtype=np.int64)
        shard = ((at + 1) * shards - 1) // n  # the s with s*n//shards <= place < (s+1)*n//shards
        taken = rows.select(["doc_id", "text"]).take(pa.array(order))
        return taken.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - firsts[shard]))

    scattered = dealt.drop("nth").repartition(min(buckets, TASKS), "bucket")  # a task takes its buckets one by one
    return scattered.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(fisher_yates, out)


def write_shards(sharded: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Writes one folder per shard; rows carry their slot."""
    sharded.write.mode("overwrite").partitionBy("shard").format(file_format).save(path)
