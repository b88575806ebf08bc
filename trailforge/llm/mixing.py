"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import SPACES, whole_text, written

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, n_rows, source_size, target) from (source, size).

    Sources in code-point order, null last, get ``weights`` in turn and share the sum of all
    sizes by them. No target is above ``most`` times its source's size: what is above goes to
    the other sources by weight, again until none is above.
    """
    spark = sizes.sparkSession
    sums = written(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size")), "sources")
    # ranks without one task that sees all sources: ranges of names, numbered each on its own
    n = max(1, -(-sums.count() // 100_000))
    parts = written(sums.repartitionByRange(n, F.col("source").isNull(), "source").withColumn("_p", F.spark_partition_id()), "source-ranges")
    starts = parts.groupBy("_p").count().withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = written(parts.join(starts, "_p").withColumn("rank", rank).withColumn("weight", weight).drop("_p", "_start"), "source-weights")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = float("inf"), -1
    cap = F.col("source_size") * most
    above = F.lit(False)
    while True:
        got = ranked.agg(F.sum(F.when(above, 1).otherwise(0)), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if got[0] is None or got[0] == capped or not got[2]:
            break
        capped, level = got[0], (total - got[1]) / got[2]
        above = F.col("weight") * level > cap
    target = F.when(above, cap).otherwise(F.col("weight") * level) if level != float("inf") else F.lit(0.0)
    return ranked.select("source", "n_rows", "source_size", target.cast("double").alias("target"))


def pivotal(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractions ``part`` to 0 or 1, but for one that is left over.

    Two fractional items at a time transfer mass (size times fraction) until one is integral;
    which way is drawn so that every expectation stays. The sum of masses never changes.
    Gives the fractions, and the index of the one left fractional (-1: none).
    """
    p, draws = part.tolist(), rng.random(len(part)).tolist()
    sizes, held = size.tolist(), -1
    for j, u in enumerate(draws):
        if not 0.0 < p[j] < 1.0:
            continue
        if not sizes[j]:  # no mass to keep
            p[j] = float(u < p[j])
            continue
        if held < 0:
            held = j
            continue
        i, si, sj = held, sizes[held], sizes[j]
        to_i_room, to_i_mass = si * (1.0 - p[i]), sj * p[j]
        to_j_room, to_j_mass = sj * (1.0 - p[j]), si * p[i]
        up, down = min(to_i_room, to_i_mass), min(to_j_room, to_j_mass)
        if u * (up + down) < down:  # mass goes from j to i
            if to_i_room <= to_i_mass:
                p[i], p[j] = 1.0, p[j] - to_i_room / sj
            else:
                p[i], p[j] = p[i] + to_i_mass / si, 0.0
        elif to_j_room <= to_j_mass:
            p[i], p[j] = p[i] - to_j_room / si, 1.0
        else:
            p[i], p[j] = 0.0, p[j] + to_j_mass / sj
        p[i], p[j] = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in (p[i], p[j]))
        held = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return np.array(p), held


def _told_apart(alike: DataFrame, block: int = 65_536) -> DataFrame:
    """Each row ``alike`` times, numbered from 1 by ``nth``. Beyond a block of them the blocks are dealt over tasks first, so
    that neither an array nor a task holds all."""
    few = alike.where(F.col("alike") <= block).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("alike"))))
    blocks = alike.where(F.col("alike") > block).withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"(alike - 1) div {block}")))).repartition("_block")
    first = F.col("_block") * block
    many = blocks.withColumn("nth", F.explode(F.sequence(first + 1, F.least(first + block, F.col("alike"))))).drop("_block")
    return few.unionByName(many)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, most: float = 3.0, rows_per_group: int = 2_000, fan_in: int = 256, seed: int = 0) -> DataFrame:
    """(key, source, size, source_size, target, copies): how often the mix takes each row.

    A row's size is its count of words (null text: 0). Each row of a source should be taken
    target / source_size times: whole copies, and a fraction that is rounded by pivotal
    sampling, so that a source's taken words differ from its target by less than one document.
    Rows of a source are dealt over groups of about ``rows_per_group`` rows; each leaves one
    fraction at most, and these go up a reduction tree of ``fan_in``, to one for each source.
    Large rows are paired first, so that the fraction left at a root is that of a small row as a
    rule; it is rounded to the nearer side. Draws depend on the seed, source, group and sorted rows only: reruns agree. A source
    without words has target 0 and is not taken. Null ids and sources are values of their own; rows
    that agree in id, source and size are drawn one by one.
    """
    size = F.regexp_count(whole_text(text), F.lit(f"[^{SPACES}]+")).cast("long")
    sizes = written(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size")), "sizes")
    targets = written(source_targets(sizes, weights, most), "targets")
    few = F.broadcast(targets) if targets.count() <= 50_000 else targets  # counted; a longer list is joined by shuffling
    few = few.withColumnRenamed("source", "_source")
    # rows that agree in all of these are told apart by a number, so that they spread over groups
    alike = sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("alike"))
    rows = _told_apart(alike).drop("alike")
    rows = rows.join(few, rows.source.eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    groups = F.ceil(F.col("n_rows") / rows_per_group)
    rows = rows.withColumn("base", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio)).withColumn("n_groups", groups).withColumn("group", F.pmod(F.xxhash64("id", "size", "nth"), groups))
    columns = ["id", "source", "size", "nth", "source_size", "target", "base", "part", "n_groups", "group"]
    id_type = sizes.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, source string, size bigint, nth bigint, source_size bigint, target double, base bigint, part double, n_groups bigint, `group` bigint"

    def rounded(level: int):
        def run(group: pa.Table) -> pa.Table:
            order = pc.sort_indices(group, [("size", "descending"), ("id", "ascending"), ("nth", "ascending")])
            group = group.take(order)
            name = f"{seed}|{level}|{group.column('source')[0].as_py()}|{group.column('group')[0].as_py()}"
            rng = np.random.default_rng(zlib.crc32(name.encode()))
            part, left = pivotal(group.column("size").to_numpy(), group.column("part").to_numpy(), rng)
            if left >= 0 and group.column("n_groups")[0].as_py() == 1:  # the source's last fraction
                part[left] = float(part[left] >= 0.5)
            return group.set_column(columns.index("part"), "part", pa.array(part))

        return run

    done, level = [], 0
    now = written(rows.select(*columns).groupBy("source", "group").applyInArrow(rounded(0), schema), "mixed-0")
    while True:
        done.append(now.where("part = 0 or part = 1"))
        left = now.where("part > 0 and part < 1")
        if not left.take(1):
            break
        level += 1
        up = left.withColumn("group", F.floor(F.col("group") / fan_in)).withColumn("n_groups", F.ceil(F.col("n_groups") / fan_in)).select(*columns)
        now = written(up.groupBy("source", "group").applyInArrow(rounded(level), schema), f"mixed-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(key), "source", "size", "source_size", "target", (F.col("base") + F.col("part")).cast("long").alias("copies"))


def mixed(docs: DataFrame, most_shared: int = 100_000, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken.

    Rows are numbered and written first, and the draw is by row number, so each row gets its own
    copies, whatever keys rows share. Up to ``most_shared`` draws, counted, are sent to every
    task; more are joined by number. Options are those of ``mix`` but for the key.
    """
    numbered = written(docs.withColumn("__tf_row", F.monotonically_increasing_id()), "numbered")
    drawn = mix(numbered, key="__tf_row", **options).where("copies > 0").select("__tf_row", F.col("copies").alias("__tf_copies"))
    drawn = written(drawn, "drawn")
    drawn = F.broadcast(drawn) if drawn.count() <= most_shared else drawn
    return numbered.join(drawn, "__tf_row").withColumn("__tf_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__tf_copies"))).select(*docs.columns)
