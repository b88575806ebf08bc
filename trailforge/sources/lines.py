"""Lines of text files with their numbers, read by splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, most_shared: int = 100_000) -> DataFrame:
    """(file, n, line): every line with its number in its file, from 1; empty lines count.

    Files are read by splits, so a large one is many tasks. A first scan counts the lines of each split and
    keeps no text; a split's lines are numbered from the sum of those before it, one number a split, sent
    to every task up to ``most_shared`` of them, counted, and else joined.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    text = text.withColumn("at", F.monotonically_increasing_id())  # a split is a stretch of one task's rows
    splits = text.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("file", "split", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    starts = F.broadcast(starts) if starts.count() <= most_shared else starts
    return text.join(starts, ["file", "split"]).select("file", (F.col("at") + F.col("shift") + 1).alias("n"), F.col("value").alias("line"))
