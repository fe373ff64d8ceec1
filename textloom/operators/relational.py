"""A small SELECT builder: projection, implicit inner joins, conjunctions or a free condition, grouping, order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.shared import Tables, near

#: Rows meant for one range of an order.
RANGE_ROWS = 200_000


def select(
    spark: SparkSession, tables: dict[str, DataFrame], fields: list[str], where: list[tuple[str, ...]] = (), group_by: list[str] = (), order_by: list[str] = ()
) -> DataFrame:
    """``SELECT fields FROM tables WHERE ...``.

    Conditions are triples (left, operator, right) joined by AND.  If one is a single item, the items are
    taken as they stand, and the caller supplies all connectives.
    """
    free = any(len(w) == 1 for w in where)
    condition = " ".join(" ".join(w) for w in where) if free else " and ".join(" ".join(w) for w in where)
    sql = f"select {', '.join(fields)} from " + ", ".join(f"{{{name}}} as {name}" for name in tables)
    for word, part in (("where", condition), ("group by", ", ".join(group_by)), ("order by", ", ".join(order_by))):
        if part:
            sql += f" {word} {part}"
    return spark.sql(sql, **tables)


def batches(rows: DataFrame, size: int = 5000) -> Iterator[list[Row]]:
    """The rows in lists of ``size``; one partition at a time is fetched."""
    held: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def running_total(rows: DataFrame, order: list[Column | str], amount: Column) -> DataFrame:
    """rows with ``upto``: the total of ``amount`` up to and with each row, in the given order (which should tell rows apart).

    Rows are written by ranges of the order; the ranges' totals (one row each) give the offsets, so no task sorts the table.
    """
    tables = Tables(rows.sparkSession, "running")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = rows.withColumn("amount_", amount).repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id())
    ranged = tables.put(ranged, "ranges")
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range_").agg(F.sum("amount_").alias("t_")).select(F.col("range_").alias("of_"), F.coalesce(F.sum("t_").over(before), F.lit(0)).alias("offset_"))
    own = F.sum("amount_").over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("own_", own).join(near(tables.put(offsets, "offsets")), F.col("range_") == F.col("of_"))
    return placed.select(*rows.columns, (F.col("offset_") + F.col("own_")).alias("upto"))


def numbered(rows: DataFrame, order: list[Column | str], start: int = 1) -> DataFrame:
    """rows with ``id``, dense from ``start`` in the given order."""
    return running_total(rows, order, F.lit(1).cast("long")).withColumn("id", (F.col("upto") + (start - 1)).cast("long")).drop("upto")
