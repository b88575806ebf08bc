"""Places in a sorted order, found by ranges: no task sees a whole table or a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailforge.sources.scratch import written


def in_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` sorted by ``order`` (nulls first) over many tasks and written, with ``_part``, the number of a
    row's range, and ``_at``, its place among all rows of that range and of those before. Read twice: give it a written table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], pos: str, total: str, most_shared: int = 500_000) -> DataFrame:
    """Rows with ``pos``, their place from 0 in ``order`` inside their group, and ``total``, the group's rows.

    Rows are cut into ranges of (groups, order), so a large group is sorted by many tasks. A range's
    places are shifted by what earlier ranges hold of the group: one number for each group and range,
    sent to every task up to ``most_shared`` of them, counted, and else joined. ``order`` should end in something that rows rarely share.
    """
    rows = in_order(df, [*groups, *order], "ordered")
    per = rows.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    per = per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), shift.alias("_shift"), F.sum("_n").over(whole).alias(total))
    per = written(per, "shifts")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    per = F.broadcast(per) if per.count() <= most_shared else per
    found = rows.join(per, same).withColumn(pos, F.col("_at") + F.col("_shift"))
    return found.drop("_part", "_at", "_p", "_shift", *[f"_g{i}" for i in range(len(groups))])
