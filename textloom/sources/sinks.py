"""Tables and reports that the engine writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors as vec
from textloom.operators.relational import numbered


def with_ids(rows: DataFrame, start: int, *order: str) -> DataFrame:
    """``id`` and the columns of rows, ids dense from ``start`` in the given order."""
    return numbered(rows, list(order), start).select("id", *rows.columns)


def insert(rows: DataFrame, path: str, order: list[str] | None = None) -> DataFrame:
    """Appends rows to the table at path and returns what was added; with ``order`` rows get the ids that follow the table's largest."""
    spark = rows.sparkSession
    if order:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        known = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        last = (spark.read.parquet(path).agg(F.max("id")).first()[0] or 0) if known else 0
        rows = with_ids(rows, last + 1, *order)
    rows.write.mode("append").parquet(path)
    return rows


def truncate(spark: SparkSession, paths: list[str]) -> None:
    """Empties the tables, keeping their columns."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def execute(spark: SparkSession, statement: str) -> DataFrame:
    return spark.sql(statement)


def dump_vectors(vectors: DataFrame, path: str) -> None:
    """``id, raw, unit`` as Parquet, and ``id x1 ... xd`` with three decimals as text below ``<path>_text``."""
    vectors.select("id", F.col("v").alias("raw"), vec.normalised(F.col("v")).alias("unit")).write.mode("overwrite").parquet(path)
    cells = F.transform("v", lambda x: F.format_string("%.3f", x))
    vectors.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(cells, " ")).alias("value")).write.mode("overwrite").text(f"{path}_text")


def write_training_csv(vectors: DataFrame, labels: DataFrame, path: str) -> None:
    """``id,x1,...,xd,label`` lines of the vectors that have a label."""
    row = F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.col("label").cast("string"))
    vectors.join(labels, "id").select(row.alias("value")).write.mode("overwrite").text(path)


def summary_rows(by_method: dict[int, DataFrame]) -> DataFrame:
    """``doc_id, method_id, sentence_id, position`` of several methods' summaries (``doc_id, node, position``)."""
    parts = [s.select("doc_id", F.lit(m).alias("method_id"), F.col("node").alias("sentence_id"), "position") for m, s in by_method.items()]
    return reduce(DataFrame.unionByName, parts)


def evaluation_html(name: Column, sentences: Column) -> Column:
    """A summary as the evaluation page format: one numbered anchor a sentence."""
    escaped = F.transform(sentences, lambda s, i: F.concat(F.lit('<a name="'), (i + 1).cast("string"), F.lit('">['), (i + 1).cast("string"), F.lit("]</a> "), F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))))
    return F.concat(F.lit("<html><head><title>"), name, F.lit("</title></head><body>\n"), F.array_join(escaped, "\n"), F.lit("\n</body></html>"))


def report(metrics: DataFrame) -> str:
    """Metrics (``method, metric, value``: bounded by methods times metrics) as lines of text."""
    return "\n".join(f"{r['method']}\t{r['metric']}\t{r['value']:.4f}" for r in metrics.orderBy("method", "metric").collect())
