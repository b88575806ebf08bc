"""Near-duplicate embeddings by spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import deal_pairs, written
from trailforge.llm.graph import components
from trailforge.llm.near_text import Forest


@lru_cache(maxsize=16)
def codes(dim: int, words: int, structures: int, seed: int = 7) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each structure a random rotation and a code book of unit vectors for each block.

    A filter direction is one code word a block, side by side, scaled to length 1: with two
    blocks of ``words`` words, words**2 directions are stored as 2 * words short vectors.
    """
    rng = np.random.default_rng([seed, dim, words])
    cuts = np.array_split(np.arange(dim), 2 if dim >= 4 else 1)
    out = []
    for _ in range(structures):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        books = []
        for cut in cuts:
            book = rng.standard_normal((words, len(cut)))
            books.append((book / np.linalg.norm(book, axis=1, keepdims=True)).T / np.sqrt(len(cuts)))
        out.append((turn, books))
    return out


def list_decode(unit: np.ndarray, words: int, structures: int, slack: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter direction whose cap a unit vector falls into.

    A vector's cap height is ``slack`` below its best direction of the structure. The best
    direction is the best word of each block; a word is looked at only if with the best words
    of the other block it could exceed the height.
    """
    n, dim = unit.shape
    rows, filters = [], []
    for s, (turn, books) in enumerate(codes(dim, words, structures)):
        turned, at, scores = unit @ turn, 0, []
        for book in books:
            scores.append(turned[:, at : at + len(book)] @ book)
            at += len(book)
        best = [x.max(axis=1) for x in scores]
        height = sum(best) - slack
        order, kept = [], []
        for b, score in enumerate(scores):
            others = sum(best) - best[b]
            most = int((score >= (height - others)[:, None]).sum(axis=1).max(initial=1))
            top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            order.append(top)
            kept.append(np.take_along_axis(score, top, axis=1))
        if len(books) == 1:
            r, i = np.nonzero(kept[0] >= height[:, None])
            number = order[0][r, i]
        else:
            r, i, j = np.nonzero(kept[0][:, :, None] + kept[1][:, None, :] >= height[:, None, None])
            number = order[0][r, i] * words + order[1][r, j]
        rows.append(r)
        filters.append(number + s * words ** len(books))
    return np.concatenate(rows), np.concatenate(filters)


def _unit(vectors: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision, from their bytes in the column's own precision."""
    found = np.stack([np.frombuffer(v, kind) for v in vectors.to_pylist()]).astype("<f8")
    with np.errstate(over="ignore"):
        length = np.linalg.norm(found, axis=1, keepdims=True)
    if not (extreme := (length > 1e-140) & (length < np.inf)).all():  # squares that leave the range of doubles
        rows = np.flatnonzero(~extreme[:, 0])
        found[rows] /= np.abs(found[rows]).max(axis=1, keepdims=True)
        length = np.linalg.norm(found, axis=1, keepdims=True)
    return found / length


def _vectors(kind: str):
    """(id, label, embedding) -> the vector's bytes; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = None
                if label is not None and v.is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                out.append(None if x is None else x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vector"])

    return run


def cap_slack(dim: int, threshold: float, spread: float) -> float:
    """How far below its best direction a vector's cap reaches: ``spread`` times what a pair at the threshold differs by in
    the direction of one word, in as many standard deviations as blocks of eight components have."""
    return spread * np.sqrt(2 - 2 * threshold) / np.sqrt(dim / 8)


#: The mean of a label's unit vectors is taken off before filters are chosen where its square is at least SHARED, but for
#: labels with more than a share CROWDED of their vectors nearer to the mean than CLOSE, as directions from it tell little there.
#: A vector nearer to it than CORE goes by its place alone.
SHARED, CROWDED, CLOSE, CORE = 0.2, 0.02, 0.3, 0.15


def filter_lists(unit: np.ndarray, mean: np.ndarray, words: int, structures: int, threshold: float, spread: float) -> list[np.ndarray]:
    """The sorted filters of each unit vector, chosen by its direction from ``mean`` (a row each; zero: as it is).

    From the mean, a vector at distance r sees a near one at an angle wider by 1 / r, and so its slack is. Where r is under
    ``CORE``, its one filter is that of all vectors within reach of such ones. Few components leave room for few words.
    """
    n, dim = unit.shape
    words = min(words, max(8, 2 ** int(0.75 * dim)))
    off = unit - mean
    away = np.linalg.norm(off, axis=1)
    centred = mean.any(axis=1)
    off = np.where(away[:, None] > 1e-9, off / np.maximum(away, 1e-9)[:, None], unit)
    by_angle = np.flatnonzero(~centred | (away >= CORE))
    slack = cap_slack(dim, threshold, spread) / np.where(centred, away, 1.0)[by_angle]
    row, number = list_decode(off[by_angle], words, structures, slack) if len(by_angle) else (by_angle, by_angle)
    near = np.flatnonzero(centred & (away < CORE + np.sqrt(2 - 2 * threshold)))
    row, number = np.append(by_angle[row], near), np.append(number, np.full(len(near), structures * words ** (2 if dim >= 4 else 1)))
    order = np.lexsort((number, row))
    row, number = row[order], number[order]
    return np.split(number, np.searchsorted(row, np.arange(1, n)))


def _sums(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(label, vector) -> a task's sums of unit vectors by label and length."""
    found: dict = {}
    for batch in batches:
        labels, sizes = batch.column(0).to_pylist(), np.array([len(v) for v in batch.column(1).to_pylist()])
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            for label, v in zip([labels[i] for i in some], _unit(batch.column(1).take(pa.array(some)), kind), strict=True):
                n, total = found.get((label, int(size)), (0, 0.0))
                found[label, int(size)] = (n + 1, total + v)
        if len(found) * batch.num_rows > 10_000_000 or len(found) > 2000:
            yield _sum_rows(found, batch.column(0).type)
            found = {}
    if found:
        yield _sum_rows(found, batch.column(0).type)


def _sum_rows(found: dict, label: pa.DataType) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], label), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1].tolist() for k in keys], pa.list_(pa.float64()))], ["label", "size", "n", "total"])


def _means(classes: DataFrame, label_type: str, kind: str) -> DataFrame:
    """(label, size, mean): of the labels whose vectors share a direction, the mean of their unit vectors. Tasks add up
    their rows first; labels are summed component by component."""
    sums = classes.select("label", "vector").mapInArrow(lambda b: _sums(b, kind), f"label {label_type}, size int, n bigint, total array<double>")
    each = sums.select("label", "size", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "size", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    mean = each.groupBy("label", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    square = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)
    means = written(mean.where(square >= SHARED), "means")
    crowd = _with_means(classes, means).where("mean is not null").mapInArrow(lambda b: _crowd(b, kind), f"label {label_type}, size int, near bigint, n bigint")
    crowd = crowd.groupBy("label", "size").agg((F.sum("near") <= CROWDED * F.sum("n")).alias("clear")).where("clear").select("label", "size")
    return written(means.join(crowd, ["label", "size"], "left_semi"), "means")


def _with_means(classes: DataFrame, means: DataFrame) -> DataFrame:
    size = means.agg(F.sum(F.size("mean") * 8)).first()[0] or 0
    means = means.select(F.col("label").alias("_label"), F.col("size").alias("_size"), "mean")
    means = F.broadcast(means) if size <= 1 << 25 else means  # 32 MB of means; more are joined
    return classes.join(means, (F.col("label") == F.col("_label")) & (F.length("vector") == F.col("_size")), "left").select("label", "rep", "copies", "vector", "mean")


def _crowd(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(label, rep, copies, vector, mean) -> by label and length how many vectors are close to the mean, and how many there are."""
    for batch in batches:
        found: dict = {}
        sizes = np.array([len(v) for v in batch.column("vector").to_pylist()])
        labels, means = batch.column("label").to_pylist(), batch.column("mean").to_pylist()
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            away = np.linalg.norm(_unit(batch.column("vector").take(pa.array(some)), kind) - np.array([means[k] for k in some]), axis=1)
            for k, r in zip(some, away, strict=True):
                near, n = found.get((labels[k], int(size)), (0, 0))
                found[labels[k], int(size)] = (near + int(r < CLOSE), n + 1)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], batch.column("label").type), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([found[k][i] for k in keys], pa.int64()) for i in (0, 1))], ["label", "size", "near", "n"])


def _decoded(words: int, structures: int, threshold: float, spread: float, kind: str):
    step = max(16, min(1024, (1 << 21) // words))  # so that a block of scores stays at 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                sizes = np.array([len(v) for v in batch.column("vector").to_pylist()])
                means = batch.column("mean").to_pylist()
                lists: list = [None] * len(sizes)
                for size in np.unique(sizes):
                    some = np.flatnonzero(sizes == size)
                    unit = _unit(batch.column("vector").take(pa.array(some)), kind)
                    nothing = np.zeros(unit.shape[1])
                    mean = np.stack([nothing if means[k] is None else np.array(means[k]) for k in some])
                    for k, part in zip(some, filter_lists(unit, mean, words, structures, threshold, spread), strict=True):
                        lists[k] = part
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "rep", "copies", "vector")), pa.array(lists, pa.list_(pa.int64()))], ["label", "rep", "copies", "vector", "filters"])

    return run


def _first_common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least filter that both lists of each pair have."""
    wide = max(map(len, [*a, *b]))
    left, right = np.full((len(a), wide), -1, np.int64), np.full((len(b), wide), -2, np.int64)
    for k, x in enumerate(a):
        left[k, : len(x)] = x
    for k, x in enumerate(b):
        right[k, : len(x)] = x
    out = np.empty(len(i), np.int64)
    step = max(1, 4_000_000 // (wide * wide))
    for at in range(0, len(i), step):
        x, y = left[i[at : at + step]], right[j[at : at + step]]
        common = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[at : at + step] = np.where(common, x, np.iinfo(np.int64).max).min(axis=1)
    return out


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, filter, rep, copies, vector, filters) sorted by task and side -> rows
    (u, v, links): a count of links of u, or a link u, v of a set that spans all found ones.

    A pair that meets under several filters counts under the least one only.
    """
    names = ["u", "v", "links"]

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        side, rep, copies = (group.column(c).to_numpy() for c in ("side", "rep", "copies"))
        number = group.column("filter")[0].as_py()
        unit, lists = _unit(group.column("vector"), kind), [np.array(x, np.int64) for x in group.column("filters").to_pylist()]
        two = side[0] != side[-1]
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(rep)),) * 2
        close = unit[a] @ unit[b].T >= threshold
        i, j = np.nonzero(close if two else np.triu(close, 1))
        if not len(i):
            return None
        i, j = a[i], b[j]
        own = _first_common(lists, lists, i, j) == number
        i, j = i[own], j[own]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        forest = Forest(len(rep))
        forest.link(i, j)
        some, child = np.flatnonzero(links), np.flatnonzero(forest.labels != np.arange(len(rep)))
        u, v = np.append(rep[some], rep[child]), np.append(np.full(len(some), -1), rep[forest.labels[child]])
        known = np.append(np.zeros(len(some), bool), np.ones(len(child), bool))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=~known), pa.array(np.append(links[some], np.zeros(len(child))).astype(np.int64), mask=known)], names)

    held: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        task = whole.column("task").to_numpy()
        starts = np.append(0, np.flatnonzero(task[1:] != task[:-1]) + 1)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo > 1 and (found := compare(whole.slice(lo, hi - lo))) is not None:
                yield found
        held = whole.slice(int(starts[-1])).combine_chunks()
    if held is not None and (found := compare(held)) is not None:
        yield found


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, structures: int = 2, spread: float = 0.3, words: int | None = None, chunk: int = 2048) -> DataFrame:
    """(key, n_links, component_id, kept): vectors of equal labels with cosine of at least
    ``threshold``, in double precision.

    Equal vectors of a label are one class with a count of copies, so copies cost one row. Each
    class is decoded to the filters whose caps it falls into; classes meet under a filter of
    their label and are compared there; every link returned is checked, and recall is that of
    the filters (tests hold it to at least 0.99). ``words`` follows the number of classes, so
    that the classes under a filter stay few; a vector falls into about 4 filters with 8 words and 8
    with 512, at any size of table, and some 30 where the label's mean is taken off. A large filter is
    compared part by part.

    Null, empty, zero and non-finite vectors, vectors with a null component, and rows with a null
    label link with nothing: n_links 0, their own component. Vectors of different lengths never
    link; components of any finite size count. A null key is no node; its row counts as a copy and gets the component of its class.
    Repeated rows are copies.
    """
    spark = vectors.sparkSession
    key_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (key, label))
    kind = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).mapInArrow(_vectors(kind), f"id {key_type}, label {label_type}, vector binary")
    rows = written(rows.withColumn("same", F.sha2("vector", 256)), "vectors")
    classes = rows.where("same is not null").groupBy("label", "same").agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("vector").alias("vector"))
    classes = written(classes, "vector-classes")
    if words is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        words = int(max(8, 2 ** np.ceil(np.log2(np.sqrt(most) + 1))))
    live = classes.where("rep is not null").select("label", "rep", "copies", "vector")
    live = _with_means(live, _means(live, label_type, kind))
    decoded = live.mapInArrow(_decoded(words, structures, threshold, spread, kind), f"label {label_type}, rep bigint, copies bigint, vector binary, filters array<bigint>")
    decoded = written(decoded, "filter-lists")
    under = decoded.withColumn("filter", F.explode("filters")).withColumn("bucket", F.xxhash64("label", "filter", F.length("vector")))
    under = deal_pairs(under, "bucket", "rep", chunk).select("task", "side", "filter", "rep", "copies", "vector", "filters")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = under.repartition(n, "task").sortWithinPartitions("task", "side").mapInArrow(lambda b: _verified(b, threshold, kind), "u bigint, v bigint, links bigint")
    found = written(found, "vector-links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    named = components(found.where("v is not null").select("u", "v"))
    classes = classes.select("label", "same", "rep", "copies").join(counts, F.col("rep") == counts.u, "left").join(named, F.col("rep") == named.node, "left")
    classes = classes.select(F.col("label").alias("_label"), F.col("same").alias("_same"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "label", "same").join(classes, (F.col("label") == F.col("_label")) & (F.col("same") == F.col("_same")), "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
