"""Document fingerprints: weighted SimHash, and search within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import give_back, whole_text, written
from trailforge.llm.near_text import _shingles

BITS, SHINGLE = 128, 5


def terms(text: str | None) -> Counter[bytes]:
    """The lower-case (A-Z) words of a text, between ASCII white space, and its shingles of five words, counted."""
    joined, first, last = _shingles(text, SHINGLE)
    found = Counter(joined.split())
    if len(first) > 1 or joined.count(b" ") >= SHINGLE - 1:
        found.update([joined[a:b] for a, b in zip(first, last, strict=True)])
    return found


def fingerprint(text: str | None) -> bytes:
    """128 bits: each distinct term votes with the bits of its hash, for (1) or against (0), with the weight
    1 + ln of its count, in sixteenths. A tie, as where there are no terms, is 0."""
    found = terms(text)
    weights = np.rint(16 + 16 * np.log(np.fromiter(found.values(), float, len(found))))
    votes, names = np.zeros(BITS), list(found)
    for at in range(0, len(names), 16_384):
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(n) for n in names[at : at + 16_384]]), np.uint8).reshape(-1, BITS // 8)
        votes += weights[at : at + 16_384] @ np.unpackbits(hashes, axis=1)
    return np.packbits(2 * votes > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine of two texts' weighted terms as the differing bits tell it; 0 at a right angle or beyond."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return 0.0 if 2 * differ >= BITS else float(np.cos(np.pi * differ / BITS))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): each document's fingerprint, 16 bytes. Equal texts have equal ones; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.binary())], ["key", "fp"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp binary").withColumnRenamed("key", key)


# --- search ----------------------------------------------------------------------------------


def block_choices(n: int, radius: int, bucket: int = 64) -> tuple[list[int], list[tuple[int, ...]]]:
    """The edges of the blocks and the choices of blocks that come first in each table.

    At most ``radius`` blocks hold a differing bit, so two fingerprints within the radius agree in all blocks of some
    choice of the others. Blocks are as few as leave about ``bucket`` of ``n`` even fingerprints under a key.
    """
    blocks = radius + 1
    while blocks < 2 * radius + 2 and (n >> int(BITS * (blocks - radius) / blocks)) > bucket:
        blocks += 1
    return [round(i * BITS / blocks) for i in range(blocks + 1)], list(combinations(range(blocks), blocks - radius))


def _tables(batches: Iterator[pa.RecordBatch], edges: list[int], choices: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """(fp, copies, asks) -> a row for each table: its number and the hash of the bits that come first in it."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
            for table, choice in enumerate(choices):
                first = np.packbits(np.concatenate([bits[:, edges[b] : edges[b + 1]] for b in choice], axis=1), axis=1)
                keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), table) for x in first], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), table, np.int32)), *(batch.column(c) for c in ("fp", "copies", "asks"))], ["key", "table", "fp", "copies", "asks"])


def _met(batches: Iterator[pa.RecordBatch], edges: list[int], choices: list[tuple[int, ...]], radius: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, table, fp, copies) sorted by task and side, queries (side 0) first -> (fp, other, copies), a row for
    each pair in its first common table, or its sums by query (other null)."""
    choice_masks = np.array([sum(1 << b for b in c) for c in choices])
    task, asked, total = None, None, None
    words = lambda fps: np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, 2)

    def result(fps: list, others: list | None, copies: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(others or [None] * len(fps), pa.binary()), pa.array(copies.astype(np.int64))], ["fp", "other", "copies"])

    def closed():
        if asked is not None and not pairs and (some := np.flatnonzero(total)).size:
            yield result([asked[i] for i in some], None, total[some])

    for batch in batches:
        tasks, sides = batch.column("task").to_numpy(), batch.column("side").to_numpy()
        cuts = np.append(0, np.flatnonzero((tasks[1:] != tasks[:-1]) | (sides[1:] != sides[:-1])) + 1)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tasks)], strict=True):
            if lo == hi:
                continue
            fps = batch.column("fp").slice(lo, hi - lo).to_pylist()
            if tasks[lo] != task:
                yield from closed()
                task, asked = tasks[lo], None
            if sides[lo] == 0:
                asked = (asked or []) + fps
                left, total = words(asked), np.zeros(len(asked), np.int64)
                continue
            if asked is None:
                continue
            right, copies, table = words(fps), batch.column("copies").slice(lo, hi - lo).to_numpy(), batch.column("table")[lo].as_py()
            for at in range(0, len(fps), step := max(1, (1 << 20) // len(asked))):
                differ = left[:, None, :] ^ right[None, at : at + step, :]
                i, j = np.nonzero(np.bitwise_count(differ).sum(axis=2, dtype=np.int64) <= radius)
                for k in range(0, len(i), 1 << 16):
                    a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    bits = np.unpackbits(differ[a, b].astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1)
                    touched = sum(bits[:, edges[x] : edges[x + 1]].any(axis=1).astype(np.int64) << x for x in range(len(edges) - 1))
                    own = ((touched[:, None] & choice_masks) == 0).argmax(axis=1) == table
                    a, b = a[own], b[own] + at
                    if pairs and len(a):
                        yield result([asked[x] for x in a], [fps[x] for x in b], copies[b])
                    np.add.at(total, a, copies[b])
    yield from closed()


def within(prints: DataFrame, asks: Column, radius: int = 6, pairs: bool = False, chunk: int = 4096, most_shared: int = 500_000) -> DataFrame:
    """All fingerprints within ``radius`` differing bits of those of the rows where ``asks`` holds.

    ``prints`` has a column ``fp`` of 16 bytes; rows with equal ones are one, with a count. Returned are (fp, n), for each
    asking fingerprint the rows within the radius, its own included; with ``pairs`` (fp, other, copies), the
    distinct fingerprints found and their rows. None within the radius is missed. Each table orders the bits with another choice
    of blocks first, and only fingerprints that agree in these meet; a pair counts in its first common table. Under a
    frequent key, fingerprints and queries are cut into parts of about ``chunk``, and all parts meet. Empty input gives no rows.
    """
    spark = prints.sparkSession
    classes = prints.where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.max(F.coalesce(asks, F.lit(False))).alias("asks"))
    classes = written(classes, "print-classes")
    edges, choices = block_choices(classes.count(), radius)
    rows = classes.mapInArrow(lambda b: _tables(b, edges, choices), "key bigint, table int, fp binary, copies bigint, asks boolean")
    rows = written(rows, "block-tables")
    keys = rows.groupBy("key").agg(F.count_if("asks").alias("asking"), F.count(F.lit(1)).alias("all")).where("asking > 0 and `all` > 0")
    parts = lambda c: F.ceil(F.col(c) / chunk).cast("int")
    keys = written(keys.select("key", parts("asking").alias("_q"), parts("all").alias("_a")), "asked-keys")
    keys = F.broadcast(keys) if keys.count() <= most_shared else keys  # counted
    met = rows.join(keys, "key")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = met.where("asks").select("*", F.lit(0).alias("side"), own("_q").alias("_i"), every("_a").alias("_j"))
    others = met.select("*", F.lit(1).alias("side"), every("_q").alias("_i"), own("_a").alias("_j"))
    both = queries.unionByName(others).select(F.xxhash64("key", "_i", "_j").alias("task"), "side", "table", "fp", "copies")
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "side")
    found = both.mapInArrow(lambda b: _met(b, edges, choices, radius, pairs), "fp binary, other binary, copies bigint")
    return found if pairs else found.groupBy("fp").agg(F.sum("copies").alias("n"))


# --- edited texts ------------------------------------------------------------------------------

WHOLE, FIRST, LAST = range(3)


def _result(key, text: str, print_: bytes, after: str, after_print: bytes) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    changed = print_ if edited == text else fingerprint(edited)
    return key, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, after_print)


def _followed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) of one range in order -> their results, but for the last one, which needs the first row of the next
    range: the first and the last row come out with their texts."""
    part, before, out = TaskContext.get().partitionId(), None, []
    texts = 0
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    nothing = (None,) * 6
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = (key, text, fingerprint(text))
            out.append((part, FIRST, text, key, *nothing) if before is None else (part, WHOLE, None, *_result(*before, *now[1:])))
            before, texts = now, texts + len(text)
            if len(out) >= 1000:
                yield batch_of()
                out = []
    if before is not None:
        out.append((part, LAST, before[1], before[0], *nothing))
    if out:
        yield batch_of()
    give_back()


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next): each document beside an edited copy, whose last
    floor(n_chars / 2) code points are the first as many of the next document's (or all it has), and beside the
    next one, in ascending order of the key; the first follows the last.

    Null texts are empty. Null keys come first; rows that share a key are ordered by a hash of the text, so that
    equal tables give equal results. A lone document is its own next. Empty input gives no rows; other columns are ignored.
    Texts of any length are read whole.

    Documents are sorted by ranges, which moves each text once; a task reads its range in order with one document in hand.
    At a range's end the next one's first document is joined, two texts a range.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    kept = [("key", arrow), ("n", pa.int64()), ("sha", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("text", pa.string()), *kept])
    result = f"key {kind.simpleString()}, n bigint, sha string, fp binary, edited_fp binary, near_edited double, near_next double"
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["key", "h", "row"]
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("key", "text")
    found = written(ranges.mapInArrow(lambda b: _followed(b, schema), f"part int, side int, text string, {result}"), "followed")
    first = found.where(F.col("side") == FIRST).select("part", F.col("text").alias("after"))
    # a row a range, without texts, so one window does
    following = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    last = found.where(F.col("side") == LAST).select("part", "key", "text").join(following, "part")
    last = last.join(first.withColumnRenamed("part", "next"), "next").select("key", "text", "after")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_result(k, t, fingerprint(t), a, fingerprint(a)) for k, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kept)], [n for n, _ in kept])

    names = [n for n, _ in kept]
    out = found.where(F.col("side") == WHOLE).select(*names).unionByName(last.mapInArrow(ends, result))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fp", "edited_fp", "near_edited", "near_next")
