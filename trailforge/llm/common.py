"""Helpers that every corpus operator shares: reading, cutting lineage, ranking."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.functions.ranges import in_order, numbered
from trailforge.sources.scratch import new_folder, shared_dir, written

__all__ = ["LOWER", "SPACES", "UPPER", "ascii_lower", "deal_pairs", "gapless", "give_back", "in_order", "new_folder", "numbered", "shared_dir", "small_batches", "table", "whole_text", "written"]

#: ASCII white space that separates words: space and 0x09 to 0x0D.
SPACES = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For applications (the registered queries, the pipeline), not for operators: let the session
    hand documents to Python in batches of ``rows`` rows, where it has Spark's default of
    10,000, as a document can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: the worker stays for later tasks of
    other operators, and its unused memory counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def gapless(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order fixed by the rows alone; rows
    that agree in the first column of ``order`` follow one another.

    No task sees a whole group: rows go to buckets of about ``rows_per_bucket`` rows by the hash of
    that first column, each bucket is numbered on its own, and the buckets' counts, summed up
    bucket by bucket, give where each one starts. ``df`` should be cheap to read twice (a written table).
    """
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    spread = df.withColumn("_b", F.pmod(F.xxhash64(F.col(order[0])), F.lit(buckets)).cast("int"))
    keys = [*groups, "_b"]
    counts = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = spread.withColumn("_r", F.row_number().over(inside) - 1)
    return numbered.join(starts, same).withColumn(name, (F.col("_start") + F.col("_r")).cast("long")).drop("_b", "_r", "_start", *[f"_k{i}" for i in range(len(keys))])


def deal_pairs(rows: DataFrame, bucket: str, spread: str, chunk: int) -> DataFrame:
    """Rows with ``task`` and ``side`` so that any two rows of a bucket meet in one task.

    A bucket of at most ``chunk`` rows is one task (side 0). A larger one is cut into parts by
    the hash of ``spread``, and every two parts meet: a task of one part has side 0 only, a task
    of two parts has sides 0 and 1. ``rows`` should be cheap to read twice.
    """
    large = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    large = written(large.select(bucket, F.ceil(F.col("n") / chunk).cast("int").alias("_parts")), "large-buckets")
    # the list of large buckets is counted before it is broadcast; a longer one is joined by shuffling
    large = F.broadcast(large) if large.count() <= 100_000 else large
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(large, bucket, "left").withColumn("_own", F.pmod(F.xxhash64(spread), parts).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    task = F.xxhash64(bucket, low, high)
    side = F.when((low == high) | (F.col("_own") == low), 0).otherwise(1)
    return dealt.withColumn("task", task).withColumn("side", side).drop("_parts", "_own", "_other")
