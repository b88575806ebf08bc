"""SimHash near-duplicates, linked by a self-join of binary tries; with shingles compared, by Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import deal_pairs, give_back, written
from trailforge.llm.graph import components

BITS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _shingles(text: str | None, size: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-case words joined by blanks, and where each shingle of ``size`` words begins and ends."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return b"", [], []
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    k = min(size, len(words))
    first = np.concatenate(([0], gaps + 1))[: len(words) - k + 1].tolist()
    last = np.concatenate((gaps, [len(joined)]))[k - 1 :].tolist()
    return joined, first, last


def simhash(text: str | None, size: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of ``size`` words (repeats included); no word: 0."""
    joined, first, last = _shingles(text, size)
    if not first:
        return 0
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), 65_536):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + 65_536], last[at : at + 65_536], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4) -> DataFrame:
    """(key, fp): each document's fingerprint as a signed 64-bit long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp bigint").select(F.col("key").alias(key), "fp")


# --- the trie self-join inside a task -------------------------------------------------


def _expand(alo, ahi, blo, bhi, same):
    """All (i, j) of the node pairs; of a node with itself, those with i < j."""
    na, nb = ahi - alo, bhi - blo
    pairs = na * nb
    which = np.repeat(np.arange(len(na)), pairs)
    inside = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    i, j = alo[which] + inside // nb[which], blo[which] + inside % nb[which]
    keep = ~same[which] | (i < j)
    return i[keep], j[keep]


def trie_links(keys: np.ndarray, roots: list[np.ndarray], depth: int, budget: int, leaf: int = 64, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` (uint64, sorted inside every root range) at ``budget`` or fewer
    differing bits.

    ``roots`` are node pairs (a_lo, a_hi, b_lo, b_hi) whose keys share the first ``depth`` bits.
    A node of the binary trie is a range of the sorted keys; both nodes of a pair are split at
    the next bit, a pair that takes different branches has one more differing bit, and pairs
    beyond the budget are pruned. Pairs with at most ``leaf`` combinations are compared. Depth
    first over blocks of ``most`` node pairs, so that a dense cluster keeps a few blocks a level.
    """
    stack = [(depth, *roots, np.zeros(len(roots[0]), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > most:
            half = len(alo) // 2
            stack += [(bit, *(x[s] for x in (alo, ahi, blo, bhi, err))) for s in (slice(half), slice(half, None))]
            continue
        same = (alo == blo) & (ahi == bhi)
        done = ((ahi - alo) * (bhi - blo) <= leaf) | (bit >= BITS)
        if done.any():
            part = np.flatnonzero(done)
            # leaves of one bit depth can be many: a bounded number of combinations at a time
            sizes = np.cumsum((ahi[part] - alo[part]) * (bhi[part] - blo[part]))
            for piece in np.split(part, np.searchsorted(sizes, np.arange(1 << 19, int(sizes[-1]), 1 << 19))):
                i, j = _expand(alo[piece], ahi[piece], blo[piece], bhi[piece], same[piece])
                near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                if near.any():
                    yield i[near], j[near]
        go = ~done
        if not go.any():
            continue
        alo, ahi, blo, bhi, err, same = (x[go] for x in (alo, ahi, blo, bhi, err, same))
        amid, bmid = _split(keys, alo, ahi, bit), _split(keys, blo, bhi, bit)
        one = err + 1
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, one), (amid, ahi, blo, bmid, np.where(same, budget + 1, one).astype(np.int8))]
        new = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        if live.any():
            stack.append((bit + 1, *(x[live] for x in new)))


def _split(keys, lo, hi, bit):
    """First index of each range whose key has the bit set: a binary search over all ranges at once."""
    lo, hi, shift = lo.copy(), hi.copy(), np.uint64(BITS - 1 - bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        ones = np.zeros(len(lo), bool)
        ones[open_] = (keys[mid[open_]] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & ones, mid, hi)
        lo = np.where(open_ & ~ones, mid + 1, lo)
    return lo


class Forest:
    """Labels of linked rows of one task: each row's label is the smallest row it is linked with."""

    def __init__(self, n: int) -> None:
        self.labels = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.labels[i], self.labels[j]
            if (a == b).all():
                return
            np.minimum.at(self.labels, np.maximum(a, b), np.minimum(a, b))
            while (self.labels != (up := self.labels[self.labels])).any():
                self.labels = up


def _roots(task: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
    """The node pairs of rows sorted by (task, side): a task's two sides, or its one side with itself."""
    ends = np.flatnonzero(np.append((task[1:] != task[:-1]) | (side[1:] != side[:-1]), True)) + 1
    lo = np.append(0, ends[:-1])
    two = np.append(task[lo][1:] == task[lo][:-1], False) if len(lo) else np.zeros(0, bool)
    # a task with two sides compares them with each other; one with a single side of number 0, with itself
    alone = (side[lo] == 0) & ~two & ~np.append(False, two[:-1])
    alo, ahi = np.append(lo[alone], lo[two]), np.append(ends[alone], ends[two])
    nxt = np.flatnonzero(two) + 1
    blo, bhi = np.append(lo[alone], lo[nxt]), np.append(ends[alone], ends[nxt])
    some = (ahi - alo) * (bhi - blo) > np.where(np.arange(len(alo)) < alone.sum(), 1, 0)
    return [x[some] for x in (alo, ahi, blo, bhi)]


def _whole_tasks(batches: Iterator[pa.RecordBatch], most: int = 65_536) -> Iterator[pa.Table]:
    """Rows sorted by task, some ``most`` at a time, and never a part of a task."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        task = whole.column("task").to_numpy()
        cut = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
        if cut:
            yield whole.slice(0, cut)
        held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _linked(batches: Iterator[pa.RecordBatch], depth: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, key, rep) sorted by (task, side, key) -> links (u, v) that span what is linked."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        task, side, key, rep = (rows.column(c).to_numpy() for c in ("task", "side", "key", "rep"))
        roots = _roots(task, side)
        forest = Forest(len(key))
        for i, j in trie_links(key.view(np.uint64), roots, depth, budget):
            forest.link(i, j)
        child = np.flatnonzero(forest.labels != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[forest.labels[child]])], ["u", "v"])

    for whole in _whole_tasks(batches):
        yield links(whole)


def hamming_links(classes: DataFrame, budget: int = 4, blocks: int | None = None, chunk: int = 4096) -> DataFrame:
    """(fp, rep) with distinct fp -> links (u, v) between reps that span every pair of
    fingerprints at ``budget`` or fewer differing bits.

    Differing bits can touch at most ``budget`` of ``blocks`` blocks, so every pair agrees on
    some choice of ``blocks - budget`` blocks. For each choice the bits are reordered, the
    chosen blocks first; these first bits name a sub-trie, and sub-tries are dealt over the
    tasks, where the trie is joined with itself. Sub-tries of more than ``chunk`` fingerprints
    are cut into parts and every two parts meet in one task. Copies never come here: there is
    one row for each distinct fingerprint.
    """
    spark = classes.sparkSession
    if blocks is None:
        blocks = budget + 1 if classes.count() < 1 << 25 else budget + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - budget))
    depth = min(sum(edges[b + 1] - edges[b] for b in choice) for choice in choices)

    def reordered(choice):
        at, out = BITS, F.lit(0).cast("long")
        for b in [*choice, *(x for x in range(blocks) if x not in choice)]:
            width = edges[b + 1] - edges[b]
            at -= width
            field = F.shiftrightunsigned(F.col("fp"), BITS - edges[b + 1]).bitwiseAND(F.lit((1 << width) - 1))
            out = out.bitwiseOR(F.shiftleft(field, at))
        return out

    tries = F.array(*[F.struct(F.lit(t).alias("trie"), reordered(c).alias("key")) for t, c in enumerate(choices)])
    rows = classes.select("rep", F.explode(tries).alias("x")).select("rep", "x.trie", "x.key").withColumn("node", F.shiftleft(F.col("trie").cast("long"), depth).bitwiseOR(F.shiftrightunsigned("key", BITS - depth)))
    rows = written(rows.select("rep", "key", "node"), "tries")
    rows = deal_pairs(rows, "node", "key", chunk).select("task", "side", "key", "rep")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "task").sortWithinPartitions("task", "side", "key")
    found = rows.mapInArrow(lambda batches: _linked(batches, depth, budget), "u bigint, v bigint")
    return found.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, budget: int = 4) -> DataFrame:
    """(key, fp, component_id): every document with the smallest key that links of at most
    ``budget`` differing fingerprint bits reach, itself included.

    Documents without words have fingerprint 0 and are linked like any other. Null keys are no
    nodes: their rows get the component of their fingerprint (null if no row with it has a key).
    Repeated rows are one node. Empty input gives an empty result. Extra columns are ignored.
    """
    prints = fingerprints(docs, text, key, size).withColumnRenamed(key, "_key")
    prints = written(prints.select(F.col("_key").cast("long").alias("_key"), "fp"), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("_key").alias("rep")), "classes")
    found = components(hamming_links(classes.where("rep is not null"), budget))
    classes = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select(F.col("_key").alias(key), "fp", "component_id")


# --- near copies by the shingles themselves --------------------------------------------

ROWS, BANDS = 4, 28  # a pair at Jaccard 0.8 shares no band with probability (1 - 0.8 ** 4) ** 28 = 4e-7
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``size`` words."""
    joined, first, last = _shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], np.uint64))


def set_simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes; none: 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number for each band: its ``ROWS`` min-hashes and its place."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _MULTIPLIERS).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(ROWS, BANDS):
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out


def set_node(hashes: np.ndarray) -> int:
    """The number of a set as a node: 64 bits, signed."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "big", signed=True)


def _sketches(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(_key, digest, node, n, fp, bands) of each document's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            fps = np.array([set_simhash(x) for x in sets], np.uint64).view(np.int64)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([band_keys(x) for x in sets] or [np.zeros(0, np.uint64)]).view(np.int64)), BANDS)
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            counts, nodes = pa.array([len(x) for x in sets], pa.int32()), pa.array([set_node(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, nodes, counts, pa.array(fps), bands.cast(pa.list_(pa.int64()))], ["_key", "digest", "node", "n", "fp", "bands"])
        give_back()

    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("text")).mapInArrow(run, "_key bigint, digest binary, node bigint, n int, fp bigint, bands array<bigint>")


def pair_similarity(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of pairs of sets (sorted, distinct); of two empty ones 1."""
    ends = np.array([len(x) for x in sets])
    pair = np.concatenate([np.repeat(np.arange(len(i)), ends[i]), np.repeat(np.arange(len(j)), ends[j])])
    values = np.concatenate([sets[k] for k in (*i.tolist(), *j.tolist())])
    order = np.lexsort((values, pair))
    pair, values = pair[order], values[order]
    twice = (pair[1:] == pair[:-1]) & (values[1:] == values[:-1])
    both = np.bincount(pair[1:][twice], minlength=len(i))
    every = ends[i] + ends[j] - both
    return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def _near_links(batches: Iterator[pa.RecordBatch], budget: int, least: float, at_once: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, key, rep, n, label, shingles) sorted by (task, side, key) -> links (u, v) that span
    what is near: pairs of ``budget`` or fewer differing bits with a similarity of ``least`` or more.

    Rows of one label are linked already. Pairs are compared nearest fingerprints first, and only while no
    path links them, so a large group costs about a comparison a row once its middle is found.
    """
    for rows in _whole_tasks(batches, 8_192):
        task, side, key, rep, n, label = (rows.column(c).to_numpy() for c in ("task", "side", "key", "rep", "n", "label"))
        key, sets = key.view(np.uint64), [np.frombuffer(x, "<u8") for x in rows.column("shingles").to_pylist()]
        forest, order = Forest(len(key)), np.argsort(label, kind="stable")
        known = label[order][1:] == label[order][:-1]
        forest.link(order[1:][known], order[:-1][known])

        def settle(i: np.ndarray, j: np.ndarray) -> None:
            i, j = i[(o := np.argsort(np.bitwise_count(key[i] ^ key[j]), kind="stable"))], j[o]
            while len(i):
                some = max(1, int(np.searchsorted(np.cumsum(n[i] + n[j]), at_once)))
                near = pair_similarity(sets, i[:some], j[:some]) >= least
                forest.link(i[:some][near], j[:some][near])
                apart = forest.labels[i[some:]] != forest.labels[j[some:]]
                i, j = i[some:][apart], j[some:][apart]

        held, count = [], 0
        for i, j in trie_links(key, _roots(task, side), 0, budget):
            some = (forest.labels[i] != forest.labels[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6)
            held.append((i[some], j[some]))
            count += int(some.sum())
            if count > 1 << 17:
                settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
        if count:
            settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
        child = np.flatnonzero(forest.labels != np.arange(len(key)))
        child = child[label[child] != label[forest.labels[child]]]
        yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[forest.labels[child]])], ["u", "v"])
    give_back()


def fingerprint_pairs(classes: DataFrame, budget: int, chunk: int = 4096) -> DataFrame:
    """(node, fp) -> pairs (u, v) of nodes whose fingerprints agree, and pairs that span all fingerprints at
    ``budget`` or fewer differing bits, from the trie self-join."""
    prints = written(classes.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    alike = classes.join(prints, "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    return hamming_links(prints, budget, chunk=chunk).union(alike)


def jaccard_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, least: float = 0.8, budget: int = 28, chunk: int = 4096, close: int = 4) -> DataFrame:
    """(key, component_id): every document with the smallest key that pairs with a Jaccard similarity
    of ``least`` or more reach, over sets of shingles of ``size`` words; itself included.

    Equal sets are one class. The self-join of binary tries links the classes' SimHash fingerprints at
    ``close`` or fewer differing bits, and the sets of every link are compared whole. Pairs with more
    differing bits (at 0.8, 10 to 12 are expected), or whose path of links failed that comparison, are what
    is left: a budget of bits that wide leaves nothing to name sub-tries by, so these meet in sub-tries
    named by bands of min-hashes. First a class that differs in label from the smallest of its band meets
    that one; then, in the tasks of the bands that this left open, the trie join leaves pairs at ``budget``
    or fewer differing bits, all that no path links yet are compared whole, and only links that
    span come out. Documents without words are one class. Null keys are no nodes:
    they get the component of their class. The bands are for a ``least`` of 0.8 or more.
    """
    spark = docs.sparkSession
    sketches = written(_sketches(docs, text, key, size), "sketches")
    classes = sketches.groupBy("digest").agg(F.min("_key").alias("rep"), *[F.first(c).alias(c) for c in ("node", "n", "fp", "bands")])
    classes = written(classes, "classes")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    def shingles(nodes: DataFrame) -> DataFrame:
        """(node, shingles) of some classes, from the text of one row of each."""
        named = written(classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("_key")).distinct(), "named")
        named = F.broadcast(named) if named.count() <= 500_000 else named  # counted; else texts are exchanged
        texts = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("text")).join(named, "_key", "left_semi")
        sets = texts.select("text").mapInArrow(sets_of, "node bigint, shingles binary")
        return written(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "shingles")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            at = np.arange(len(a))
            near = pa.array(pair_similarity([*a, *b], at, at + len(a)) >= least) if len(a) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(near), batch.column("v").filter(near)], ["u", "v"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.distinct(), "pairs")
        sets = shingles(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        return written(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(compared, "u bigint, v bigint"), "verified")

    nodes = classes.where("rep is not null")
    close_links = verified(fingerprint_pairs(nodes.select("node", "fp"), close, chunk))
    nodes = nodes.join(components(close_links), "node", "left").select("node", "n", "fp", F.coalesce("component", "node").alias("label"), "bands")
    rows = nodes.select("node", "n", "fp", "label", F.explode("bands").alias("bucket"))
    firsts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"), F.min(F.struct("node", "label")).alias("first")).where("`all` > 1").drop("all")
    rows = written(rows.join(firsts, "bucket"), "bands")
    near = close_links.union(verified(rows.where("label <> first.label").select(F.col("node").alias("u"), F.col("first.node").alias("v"))))
    labels = components(near)
    labelled = rows.drop("label").join(labels, "node", "left").select("bucket", F.col("node").alias("rep"), "n", F.col("fp").alias("key"), F.coalesce("component", "node").alias("label"))
    labelled = written(labelled, "labelled-bands")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    opened = written(labelled.join(mixed, "bucket", "left_semi"), "open-bands")
    sets = shingles(opened.select(F.col("rep").alias("node")).distinct()).withColumnRenamed("node", "rep")
    rows = deal_pairs(opened, "bucket", "rep", chunk).join(sets, "rep")
    rows = rows.select("task", "side", "key", "rep", "n", "label", "shingles").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task")
    rows = rows.sortWithinPartitions("task", "side", F.col("key") < 0, "key")  # by the unsigned fingerprint
    more = written(rows.mapInArrow(lambda batches: _near_links(batches, budget, least), "u bigint, v bigint"), "near-links")
    found = components(near.union(more)).withColumnRenamed("node", "_node")
    classes = classes.join(found, classes.node == found._node, "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    names = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(names, "component").select("digest", "component_id")
    return sketches.join(classes, "digest").select(F.col("_key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", near=near_duplicates, most_shared: int = 1_000_000, **options) -> DataFrame:
    """The documents, one of each group that ``near`` finds: the one with the smallest key, nulls last.

    Every row is a document of its own: rows are numbered and written first, and groups are made
    of row numbers, so rows that share a key, or have none, go only where their texts are near
    another's. Which of the rows with a group's smallest key stays follows from the row numbers.
    Up to ``most_shared`` dropped rows, counted, are sent to every task; more are joined by number.
    """
    numbered = written(docs.withColumn("__tf_row", F.monotonically_increasing_id()), "numbered")
    groups = near(numbered, key="__tf_row", **options).select("__tf_row", "component_id")
    groups = groups.join(numbered.select("__tf_row", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__tf_row").alias("row")).alias("rank")), "__tf_row")
    groups = written(groups, "groups")
    first = groups.groupBy("component_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select("component_id", F.col("first.row").alias("first")), "first")
    first = F.broadcast(first) if first.count() <= most_shared // 4 else first
    dropped = written(groups.join(first, "component_id").where("__tf_row <> first").select("__tf_row"), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= most_shared else dropped
    return numbered.join(dropped, "__tf_row", "left_anti").select(*docs.columns)
