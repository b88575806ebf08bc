"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import gapless, whole_text, written

PARTS = 64  # cells of one group and shard


def _per_shard(df: DataFrame, shard: str, amount: str, shards: int) -> list[int]:
    """Sums by shard; the driver gets one number for each shard."""
    found = dict(df.groupBy(shard).agg(F.sum(amount)).collect())
    return [int(found.get(s) or 0) for s in range(shards)]


def _pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _let_in(wanted: dict[tuple[int, int], int], room: list[int]) -> list[float]:
    """The share of the rows that want each shard, such that no shard ends above its room.

    ``wanted`` counts rows by (from, to). What leaves a shard makes room there, so shards that are
    full exchange rows; a shard whose inflow is still too large cuts it, by which others keep
    rows they would have given away and cut in turn, until all fit.
    """
    flow = {pair: float(n) for pair, n in wanted.items()}
    shards = range(len(room))
    tight = True
    while tight:
        tight = False
        for to in shards:
            inflow = sum(n for (_, t), n in flow.items() if t == to)
            most = max(0.0, room[to] + sum(n for (s, _), n in flow.items() if s == to))
            if inflow > most + 0.5:
                tight = True
                for pair in flow:
                    if pair[1] == to:
                        flow[pair] *= most / inflow
    total = [sum(n for (_, t), n in wanted.items() if t == to) for to in shards]
    return [sum(n for (_, t), n in flow.items() if t == to) / total[to] if total[to] else 1.0 for to in shards]


def propagate(cells: DataFrame, quotas: list[int], rounds: int = 20, slack: float = 0.1, whole: int = 500) -> DataFrame:
    """Move cells (group, cell, n, shard) to the shard where most of their group is.

    A cell is some rows of one group that start in one shard. In each round every group's
    histogram over the shards is summed up, and cells ask for the open shard that holds more of
    their group than their own (ties by a hash, so that two cells never swap): every move
    leaves fewer links cut. Rows pass between full shards in both directions as far as every shard
    stays within its quota and ``slack`` of it (``_let_in``, from one number for each pair of
    shards); who passes is drawn by hash, the cells of a group in a shard together, one by one where
    they have more than ``whole`` rows. Shards that had to refuse rows are closed in the next round,
    so that refused groups gather elsewhere. It ends when no move is wanted or possible, or after
    ``rounds``.
    """
    shards = len(quotas)
    closed = [False] * shards
    for turn in range(rounds):
        here = cells.groupBy("group", "shard").agg(F.sum("n").alias("here")).withColumn("weight", F.struct("here", F.xxhash64("group", "shard").alias("tie")))
        best = here.where(~_pick(closed, F.col("shard"))).groupBy("group").agg(F.max(F.struct("weight", "shard")).alias("best"))
        asked = here.join(best, "group", "left").select("group", "shard", "here", F.when(F.col("best.weight") > F.col("weight"), F.col("best.shard")).alias("to"))
        asked = written(asked, "asked")
        wanted = {(r["shard"], r["to"]): int(r["n"]) for r in asked.where("to is not null").groupBy("shard", "to").agg(F.sum("here").alias("n")).collect()}
        now = _per_shard(asked, "shard", "here", shards)
        share = _let_in(wanted, [int(q * (1 + slack)) - n for q, n in zip(quotas, now, strict=True)])
        if sum(n * share[to] for (_, to), n in wanted.items()) < 1:
            if not any(closed):
                break
            closed = [False] * shards
            continue
        moved = cells.join(asked.where("to is not null").select("group", "shard", "here", "to"), ["group", "shard"], "left")
        alone = F.when(F.col("here") > whole, F.col("cell")).otherwise(-1)
        drawn = F.pmod(F.xxhash64("group", alone, F.lit(turn)), F.lit(1_000_000)) / 1_000_000.0
        goes = F.col("to").isNotNull() & (drawn < _pick(share, F.coalesce("to", F.lit(0))))
        cells = written(moved.select("group", "cell", "n", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), "cells")
        closed = [x < 0.999 for x in share]
    return cells


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", rounds: int = 20) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard), one row for each document.

    Documents with equal texts are linked. The law is ``rows``: the shards' counts are at most
    one apart. Linked documents start in a shard by hash and move by label propagation under the
    quotas. Then each shard keeps its quota of rows, group by group, so that what is above it are
    whole groups but for one; these and the documents with no link fill what the quotas leave, again
    group by group. So few groups are cut: those above a quota, and those at a border of two shards.

    Slots are gapless from 0 in each shard. A null text is empty; null keys and repeated rows
    are documents of their own. An empty table gives an empty result. ``grown_shard`` belongs to another law and is null.
    A group of any size is dealt in ``PARTS`` cells a shard, so no task holds it whole.
    """
    body = whole_text(text)
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("group"),
    )
    cell = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(PARTS)) * shards + F.pmod(F.xxhash64("row"), F.lit(shards))
    base = written(base.withColumn("cell", cell.cast("int")), "shard-rows")
    n = base.count()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    cells = written(base.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n")), "all-cells")
    groups = cells.groupBy("group").agg(F.sum("n").alias("copies")).where("copies > 1")
    # a group's rows are numbered one after the other; those of a large group cell by cell
    run = F.when(F.col("copies") > 1000, F.xxhash64("group", "cell")).otherwise(F.xxhash64("group"))
    linked = written(cells.join(groups, "group").select("group", "cell", "n", F.pmod("cell", F.lit(shards)).cast("int").alias("shard"), run.alias("run")), "cells")
    placed = propagate(linked.drop("run"), quotas, rounds).select("group", "cell", F.col("shard").alias("to"))
    placed = placed.join(linked.select("group", "cell", "run"), ["group", "cell"])
    columns = ["row", "key", "size", "text_crc32", "run"]
    rows = base.join(placed, ["group", "cell"], "left").withColumn("run", F.coalesce("run", F.xxhash64("row")))
    rows = written(rows.select(*columns, F.col("to").alias("shard")), "shard-groups")
    numbered = gapless(rows.where("shard is not null"), ["shard"], ["run", "row"], "slot")
    numbered = written(numbered.withColumn("fits", F.col("slot") < _pick(quotas, F.col("shard"))), "placed")
    stay = numbered.where("fits")
    filled = _per_shard(stay.withColumn("one", F.lit(1)), "shard", "one", shards)
    rest = rows.where("shard is null").select(*columns).unionByName(numbered.where("not fits").select(*columns))
    rest = gapless(written(rest, "unplaced"), [], ["run", "row"], "at")
    ends, begins, so_far = [], [], 0
    for q, f in zip(quotas, filled, strict=True):
        begins.append(so_far)
        so_far += q - f
        ends.append(so_far)
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("at"))).cast("int")
    rest = rest.withColumn("shard", shard).withColumn("slot", F.col("at") - _pick(begins, F.col("shard")) + _pick(filled, F.col("shard")))
    kept = ["key", "size", "text_crc32", "shard", "slot"]
    out = stay.select(*kept).unionByName(rest.select(*kept))
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
