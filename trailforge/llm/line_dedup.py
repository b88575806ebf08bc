"""Line dedup against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.llm.common import new_folder, written

#: Frequent hashes that every task may hold as a sorted array: 16 bytes each.
MOST_SHARED = 1_000_000


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: without ASCII white space (space, 0x09 to 0x0D) at both ends, A-Z lower-cased."""
    return list(map(bytes.strip, text.lower().split(b"\n")))


def _hashes(keys: list[bytes]) -> np.ndarray:
    """128 bits of each key, as two columns of longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").reshape(-1, 2).astype("<i8")


def _long_enough(keys, least_chars: int) -> list[bytes]:
    return [k for k in keys if k and (least_chars <= 1 or len(k.decode("utf-8", "replace")) >= least_chars)] if least_chars > 0 else list(keys)


class LineRuns:
    """Counts of documents by line hash, as sorted runs in levels.

    A run is a table in buckets of the hash, sorted inside each bucket. A batch's counts are one
    run of level 0. Two runs of a level are merged into one run of the next level, so that each
    hash is rewritten once a level and reading needs few runs. Hashes that have reached ``least``
    documents are settled: each new batch is anti-joined with those of every run before it adds
    its own. Counts are dealt like the buckets, so a batch is exchanged once, for its own counts;
    anti-joins and merges are joins of equal buckets and exchange no row.
    """

    def __init__(self, spark: SparkSession, least: int) -> None:
        self.spark, self.least = spark, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _run(self, counts: DataFrame, level: int) -> str:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", new_folder(self.spark, name)).saveAsTable(name)
        return name

    def _merge(self, one: str, other: str, level: int) -> str:
        """The run of two runs' summed counts: a full outer join, bucket by bucket."""
        x, y = self.spark.table(one), self.spark.table(other)
        both = x.join(y, (x.h1 == y.h1) & (x.h2 == y.h2), "full_outer")
        counts = both.select(*(F.coalesce(x[c], y[c]).alias(c) for c in ("h1", "h2")), (F.coalesce(x.n, F.lit(0)) + F.coalesce(y.n, F.lit(0))).alias("n"))
        run = self._run(counts, level)
        self._forget([one, other])
        return run

    def _forget(self, names: list[str]) -> None:
        for name in names:  # the table's name; its files are scratch in the shared folder
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def all_runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """Counts of a batch without the hashes that some run has settled."""
        for name in self.all_runs():
            counts = counts.join(self.spark.table(name).where(F.col("n") >= self.least).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return counts

    def add(self, batch: DataFrame) -> None:
        """Add a batch of partial counts (h1, h2, n)."""
        counts = batch.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        self.levels[0].append(self._run(self.unsettled(counts), 0))
        self.compact()

    def compact(self) -> None:
        """Merge two runs of a level, from the lowest level up."""
        for k, level in enumerate(self.levels):
            if len(level) >= 2:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._merge(*level, k + 1))
                level.clear()

    def frequent(self) -> DataFrame:
        """Hashes found in at least ``least`` documents, written. All runs are merged for it, the
        smaller ones first, and then forgotten."""
        names = self.all_runs()
        while len(names) > 1:
            names = [self._merge(*names[:2], len(self.levels)), *names[2:]]
        found = written(self.spark.table(names[0]).where(F.col("n") >= self.least).select("h1", "h2"), "frequent-lines")
        self._forget(names)
        self.levels = [[]]
        return found


def _counted(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Counter] = defaultdict(Counter)
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[b].update(_long_enough(set(line_keys(text.as_py() or b"")), least_chars))
            for b, counts in found.items():
                h = _hashes(list(counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b, np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(counts.values()), pa.int64())], ["batch", "h1", "h2", "n"])

    return run


def frequent_lines(docs: DataFrame, text: str = "text", least_docs: int = 10, least_chars: int = 1, batches: int = 8) -> DataFrame:
    """(h1, h2) of the line keys that ``least_docs`` or more rows hold.

    One scan hashes the lines of all documents; each row belongs to one of ``batches`` batches.
    A task counts the lines of the rows it has at hand before it writes them, so a line of every
    document is a few rows. The batches then go one by one through the runs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int").alias("batch"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(_counted(least_chars), "batch int, h1 bigint, h2 bigint, n bigint")
    path = new_folder(spark, "line-batches")
    counts.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(counts.schema).parquet(path)
    runs = LineRuns(spark, least_docs)
    for b in range(batches):
        runs.add(stored.where(F.col("batch") == b).drop("batch"))
    return runs.frequent()


def _probe(first: np.ndarray, second: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is in the sorted arrays; several entries may share the first half."""
    at, end = np.searchsorted(first, hashes[:, 0], "left"), np.searchsorted(first, hashes[:, 0], "right")
    found = np.zeros(len(hashes), bool)
    while (open_ := np.flatnonzero(at < end)).size:
        found[open_] |= second[at[open_]] == hashes[open_, 1]
        at[open_] += 1
    return found


def _sorted(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h2, h1))
    return h1[order], h2[order]


def _dropped(columns: list[str], frequent: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]):
    """Rows (text, columns...) -> the columns with the text without frequent lines. ``frequent`` gives
    the sorted hashes to look for in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or b"" for x in batch.column(0).to_pylist()]
                keys = [line_keys(x) for x in texts]
                n = np.array([len(x) for x in keys])
                hit = _probe(*frequent(batch), _hashes([k for x in keys for k in x]))
                ends = np.cumsum(n)
                dropped = np.add.reduceat(hit.astype(np.int64), ends - n)
                for k in np.flatnonzero(dropped):
                    own = hit[ends[k] - n[k] : ends[k]].tolist()
                    texts[k] = b"\n".join([x for x, h in zip(texts[k].split(b"\n"), own, strict=True) if not h])
                yield pa.RecordBatch.from_arrays([*batch.columns[1 : 1 + len(columns)], pa.array(texts, pa.binary()), pa.array(n), pa.array(dropped)], [*columns, "kept_text", "n_lines", "n_dropped"])

    return run


def drop_frequent_lines(docs: DataFrame, text: str = "text", least_docs: int = 10, least_chars: int = 1, batches: int = 8, most_shared: int = MOST_SHARED) -> DataFrame:
    """All columns of ``docs`` but the text (and those named like a new one) with ``kept_text`` (the
    text without the lines found in ``least_docs`` documents, whole and joined by newlines),
    ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space and A-Z lower-cased; other white space
    (U+0085, U+2028) is part of it. Keys of fewer than ``least_chars`` code points are never dropped. A null or
    empty text is one empty line. Each row is a document: a key that a row repeats counts once,
    rows that share an id, or have none, count each. Where every line goes the text is empty. An
    empty table gives an empty result; a text of any length is one row's work.

    Up to ``most_shared`` frequent hashes, counted first, go to every task as a sorted array,
    and no text is exchanged. A longer list is joined by hash with the rows' own hashes, and
    each row gets the hits among its own lines.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in (text, "kept_text", "n_lines", "n_dropped")]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("kept_text", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    body = F.col(text).cast("binary").alias("__tf_text")
    few = frequent_lines(docs, text, least_docs, least_chars, batches)
    if few.count() <= most_shared:
        found = few.toArrow()
        shared = spark.sparkContext.broadcast(_sorted(*(found.column(c).to_numpy() for c in ("h1", "h2"))))
        out = docs.select(body, *columns).mapInArrow(_dropped(columns, lambda batch: shared.value), schema)
    else:

        def own_hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for row, item in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    h = _hashes(_long_enough(set(line_keys(item.as_py() or b"")), least_chars))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["row", "h1", "h2"])

        def of_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            hits = batch.column(batch.num_columns - 1).flatten()  # frequent for one row is frequent for all
            return _sorted(*(hits.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)))

        numbered = written(docs.select(F.monotonically_increasing_id().alias("__tf_row"), body, *columns), "numbered")
        hashes = numbered.select("__tf_row", "__tf_text").mapInArrow(own_hashes, "row bigint, h1 bigint, h2 bigint")
        hits = hashes.join(few, ["h1", "h2"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("__tf_hits"))
        joined = numbered.join(hits, numbered["__tf_row"] == hits["row"], "left")
        out = joined.select("__tf_text", *columns, "__tf_hits").mapInArrow(_dropped(columns, of_rows), schema)
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
