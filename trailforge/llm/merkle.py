"""Merkle manifests of datasets: fixed-size blocks of ordered digests, collapsed by SQL functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import LOWER, UPPER, numbered, written

#: Levels that a block collapses at once; a block holds FANOUT ** LEVELS digests.
FANOUT, LEVELS = 16, 3
_LISTS = "array<array<string>>"
_STEPS = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else its UTF-8 bytes' count, ``:`` and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def _collapsed(level: Column, fanout: int) -> Column:
    """The digests of every ``fanout`` consecutive digests; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * fanout + 1, fanout), ""), 256))


def _levels(digests: Column, count: Column, fanout: int, levels: int) -> Column:
    """The digests and the ``count`` (at most ``levels``) levels above them."""
    turns = F.slice(F.sequence(F.lit(1), F.lit(levels)), 1, count)
    return F.aggregate(turns, F.array(digests).cast(_LISTS), lambda done, _: F.concat(done, F.array(_collapsed(F.element_at(done, -1), fanout)).cast(_LISTS)))


def _steps(levels: Column, at: Column, fanout: int) -> Column:
    """For the digest at place ``at`` (from 0) of the lowest level: the joined digests left and right of
    it in its run, level by level."""

    def step(level: Column, k: Column) -> Column:
        mine = F.floor(at / F.pow(F.lit(fanout), k)).cast("int")
        first = mine - mine % fanout
        left, right = F.slice(level, first + 1, mine - first), F.slice(level, mine + 2, first + fanout - 1 - mine)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _blocks(nodes: DataFrame, group: str, fanout: int, levels: int) -> DataFrame:
    """(group, n, block, rows, levels): nodes (group, pos, n, digest, ...) of one block in order, ``rows``,
    and the levels that they collapse to."""
    size = fanout**levels
    rest = [c for c in nodes.columns if c not in (group, "n")]
    rows = nodes.groupBy(group, "n", F.floor(F.col("pos") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))
    count = F.lit(levels)
    for k in reversed(range(levels)):
        count = F.when(F.col("n") <= fanout**k, k).otherwise(count)
    return written(rows.withColumn("levels", _levels(F.transform("rows", lambda r: r["digest"]), count, fanout, levels)), "blocks")


def _climbed(nodes: DataFrame, group: str, fanout: int, levels: int) -> DataFrame:
    """(group, pos, steps, top): nodes (group, pos, n, digest) with their steps to the top of their group."""
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select(group, "pos", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("top"))
    blocks = _blocks(nodes.select("pos", group, "n", "digest"), group, fanout, levels)
    return _inside(blocks, _above(blocks, group, fanout, levels), group, fanout).select(group, "row.pos", "steps", "top")


def _above(blocks: DataFrame, group: str, fanout: int, levels: int) -> DataFrame:
    """(group, pos, steps, top): the blocks' steps from their roots to the top, one row a block, written."""
    roots = blocks.select(group, F.col("block").alias("pos"), F.ceil(F.col("n") / fanout**levels).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
    return written(_climbed(roots, group, fanout, levels), "block-steps")


def _inside(blocks: DataFrame, above: DataFrame, group: str, fanout: int) -> DataFrame:
    """Every row of the blocks as ``row``, with its group, its ``steps`` to the top, and the further columns of ``above``."""
    more = [c for c in above.columns if c not in (group, "pos", "steps")]
    above = above.select(F.col(group).alias("_group"), "pos", F.col("steps").alias("_above"), *more)
    above = F.broadcast(above) if above.count() <= 50_000 else above  # counted; so blocks stay where they are
    own = blocks.join(above, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("pos"))).select(group, "rows", "levels", "_above", *more)
    each = F.transform("rows", lambda r, i: F.struct(r.alias("row"), _steps(F.col("levels"), i, fanout).alias("steps")))
    return own.select(group, *more, "_above", F.inline(each)).select(group, *more, "row", F.concat("steps", "_above").alias("steps"))


def folded(steps: Column, digest: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(steps, digest, lambda done, s: F.sha2(F.concat(s["left"], done, s["right"]), 256))


def manifest(rows: DataFrame, group: str, order: str, digest: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The columns of ``rows`` with ``subroot``, ``root`` and ``steps``: the siblings (struct of left and right,
    joined) on each level from the row to the root.

    In each group rows ascend by ``order``, then by digest (nulls first); while several digests remain, every
    ``fanout`` consecutive ones become the digest of their hex text. What remains is the group's
    subroot, a lone row its own. Subroots, by group (null first, bytewise), likewise give the root.

    Rows are numbered by ranges, so a large group is sorted and hashed by many tasks. ``fanout ** levels``
    digests make a block, one array in one row, collapsed ``levels`` times by SQL functions; the blocks'
    roots are the next round's rows, so a trillion rows take three or four rounds. On the way back a
    block's steps are appended to those inside it; no tree passes through the driver.

    Null groups are a group, null orders come first in theirs; repeated rows are leaves of their own; other
    columns pass through, whatever their names. An empty table gives no rows.
    """
    own = F.struct(*[F.col(c) for c in rows.columns])
    leaves = rows.select(F.col(group).alias("group"), F.col(order).alias("key"), F.col(digest).alias("digest"), own.alias("own"))
    leaves = written(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")  # rows alike in all else are cut apart
    placed = numbered(leaves, ["group"], ["key", "digest", "salt"], "pos", "n").select("pos", "group", "n", "digest", "own")
    blocks = _blocks(placed, "group", fanout, levels)
    above = _above(blocks, "group", fanout, levels)
    tops = above.where("pos = 0").select(F.lit(0).alias("all"), F.col("top").alias("digest"), "group")
    tops = written(numbered(written(tops, "subroots"), ["all"], ["group"], "pos", "n"), "placed-subroots")
    up = _climbed(tops.select("all", "pos", "n", "digest"), "all", fanout, levels).select(F.col("pos").alias("_pos"), F.col("steps").alias("_further"), F.col("top").alias("root"))
    tops = tops.join(up, F.col("pos") == F.col("_pos")).select(F.col("group").alias("_of"), "_further", "root")
    above = written(above.join(tops, F.col("group").eqNullSafe(F.col("_of"))).select("group", "pos", F.concat("steps", "_further").alias("steps"), F.col("top").alias("subroot"), "root"), "root-steps")
    return _inside(blocks, above, "group", fanout).select("row.own.*", "subroot", "root", "steps")


DOCUMENT_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_proofs(docs: DataFrame, fields: Sequence[str] = DOCUMENT_FIELDS, group: str = "source", key: str = "doc_id", text: str = "text", every: int = 5) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): each document's place in the
    manifest, and whether its row, tampered with where ``every`` divides the crc32 of its key, still gives the root.

    Tampering lower-cases A-Z of the text; a text without them, or a null one, stays as it was. A null key is not
    tampered with. Texts are read once, for their digests, and go nowhere.
    """
    fresh = {text: F.translate(F.col(text), UPPER, LOWER)}
    tampered = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf([F.col(f) for f in fields]).alias("leaf"), F.when(tampered, leaf([fresh.get(f, F.col(f)) for f in fields])).alias("tampered"))
    found = manifest(rows, "group", "key", "leaf")
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select(F.col("key").alias(key), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("steps"), F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
