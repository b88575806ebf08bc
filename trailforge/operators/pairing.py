"""Pairing, absorption, as-of values and rate limits: the stateful steps of trace normalisation
as window and join plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fifo(rows: DataFrame, keys: list[str], order: list[str], id: str, opens: str) -> DataFrame:
    """(keys, open_id, close_id): each close takes the oldest open row of its key that is still
    unmatched; what stays without a partner has a null there.

    Without a queue in Python: a close finds none waiting exactly where the running balance of
    opens and closes reaches a new low, so these closes are known from one running minimum; among
    the others, the k-th close answers the k-th open. All windows share one exchange by the keys.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col(opens), 1).otherwise(-1)
    rows = rows.withColumn("_level", F.sum(step).over(upto))
    low = F.least(F.coalesce(F.min("_level").over(before), F.lit(0)), F.lit(0))
    rows = rows.withColumn("_alone", ~F.col(opens) & (F.col("_level") < low))
    matched = F.col(opens) | ~F.col("_alone")
    turn = F.sum(F.when(matched, 1).otherwise(0)).over(Window.partitionBy(*keys, opens).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_k", F.when(matched, turn))
    pairs = rows.where("_k is not null").groupBy(*keys, "_k").agg(F.max(F.when(F.col(opens), F.col(id))).alias("open_id"), F.max(F.when(~F.col(opens), F.col(id))).alias("close_id"))
    alone = rows.where("_alone").select(*keys, F.lit(None).cast(rows.schema[id].dataType).alias("open_id"), F.col(id).alias("close_id"))
    return pairs.select(*keys, "open_id", "close_id").unionByName(alone)


def absorb(parents: DataFrame, parent_key: str, follow_ups: DataFrame, key: str, order: Column, value: Column, name: str = "absorbed") -> DataFrame:
    """Parents with the value of their last follow-up (null: none), whether that comes before or
    after the parent. The follow-ups are reduced to one a key before the join."""
    last = follow_ups.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, order).alias(name))
    return parents.join(last, F.col(parent_key) == F.col("_key"), "left").drop("_key")


def as_of(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Rows with the last value that is not null, up to and with each row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def architecture(human: Column, actors: Column) -> Column:
    """The architecture that a trace shows: human rows, else two or more actors, else one agent."""
    return F.when(human, "human_in_the_loop").when(actors >= 2, "multi_agent").otherwise("single_agent")
