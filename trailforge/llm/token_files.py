"""Token-id files: patched frame-of-reference blocks, written and read back by Spark tasks.

A file holds, in this order: a header; blocks; the start of each block; the documents' ids, null
flags and token counts. A block holds ``BLOCK`` ids (the last one fewer, padded with its
minimum): its minimum, a bit width, the ids less the minimum packed at that width, and the ids
that need more bits as an exception list. The width is chosen by a percentile of the bits needed.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import give_back, new_folder, written
from trailforge.llm.pretokens import splitter

MAGIC, BLOCK = b"TFPB0001", 4096
_HEADER = struct.Struct("<8sIIQQQ")  # magic, block size, blocks, ids, documents, place of the index
_BLOCK = struct.Struct("<IBxH")  # minimum, width, exceptions


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width -> (blocks, BLOCK * width / 64) words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i, lane in enumerate(lanes):
        word, off = divmod(i * width, 64)
        words[word] |= lane << np.uint64(off)
        if off + width > 64:
            words[word + 1] |= lane >> np.uint64(64 - off)
    return np.ascontiguousarray(words.T).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out, mask = np.empty((64, lanes.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for i in range(64):
        word, off = divmod(i * width, 64)
        x = lanes[word] >> np.uint64(off)
        if off + width > 64:
            x |= lanes[word + 1] << np.uint64(64 - off)
        np.bitwise_and(x, mask, out=out[i])
    return out.T.reshape(len(words), -1)


def encode_ids(ids: np.ndarray, percentile: float = 95.0, at_once: int = 128) -> tuple[list[bytes], list[int]]:
    """Blocks of the ids (unsigned, below 2**32), and each block's length in bytes; ``at_once`` blocks are worked on together."""
    blocks, sizes = [], []
    for at in range(0, len(ids), at_once * BLOCK):
        some = _encode_blocks(ids[at : at + at_once * BLOCK], percentile)
        blocks += some
        sizes += map(len, some)
    return blocks, sizes


def _encode_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    n = len(ids)
    count = -(-n // BLOCK)
    padded = np.empty(count * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[(count - 1) * BLOCK :].min()
    rows = padded.reshape(count, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    limit = np.partition(rest, at, axis=1)[:, at]
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    large = rest >> np.minimum(width, 31).astype(np.uint32)[:, None] != 0
    large[width >= 32] = False
    packed: list[bytes] = [b""] * count
    low = np.where(large, np.uint32(0), rest)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        if w:
            for k, words in zip(some.tolist(), _pack(low[some], int(w)), strict=True):
                packed[k] = words.tobytes()
    out = []
    for k in range(count):
        where = np.flatnonzero(large[k])
        body = _BLOCK.pack(int(least[k]), int(width[k]), len(where)) + packed[k] + where.astype("<u2").tobytes() + rest[k, where].astype("<u4").tobytes()
        out.append(body)
    return out


def decode_ids(data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of the blocks that start at ``starts``."""
    out = np.empty((len(starts), BLOCK), np.uint64)
    heads = [_BLOCK.unpack_from(data, s) for s in starts.tolist()]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        if w:
            words = np.stack([np.frombuffer(data, "<u8", BLOCK * int(w) // 64, int(starts[k]) + _BLOCK.size) for k in some])
            out[some] = _unpack(words, int(w))
        else:
            out[some] = 0
    for k, (least, w, patches) in enumerate(heads):
        if patches:
            at = int(starts[k]) + _BLOCK.size + BLOCK * w // 8
            where = np.frombuffer(data, "<u2", patches, at)
            out[k, where] = np.frombuffer(data, "<u4", patches, at + 2 * patches)
        out[k] += least
    return out.reshape(-1)[:n].astype(np.uint32)


def file_bytes(docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    blocks, sizes = encode_ids(ids)
    starts = np.cumsum([_HEADER.size, *sizes]).astype("<u8")
    header = _HEADER.pack(MAGIC, BLOCK, len(blocks), len(ids), len(docs), int(starts[-1]))
    tail = [starts[:-1].tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], "u1").tobytes(), np.array(counts, "<u8").tobytes()]
    return b"".join([header, *blocks, *tail])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a file."""
    magic, block, blocks, n, docs, at = _HEADER.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token-id file")
    starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    at += 8 * blocks
    keys, null = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "u1", docs, at + 8 * docs)
    counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], counts, decode_ids(data, starts, n)


# --- encoding by the tokenizers library -------------------------------------------------

#: How a byte-level pre-tokenizer splits a text: the pattern published with this vocabulary. Letters
#: and digits, the most frequent, are tried first here; every alternative begins with other characters, so no match changes.
PIECES = r""" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that a worker keeps, in two generations of half as many.
KEPT_PIECES = 500_000
#: Marks in a text cut at blanks: its first word has no blank before it; between two newlines, between two blanks.
_FIRST, _LINE, _BLANK = "\0", "\1", "\2"
_GAP = "\r"  # stands between words while they are cut into pieces; a word has none
_SPACE = r"\t-\r\x{85}\p{Z}"
#: What stands between two blanks but cannot be cut into pieces on its own.
_NO_WORD = rf"^$|^\n$|[{_SPACE}]$|[{_SPACE}][{_SPACE}]|^[\t\x{{b}}-\r\x{{85}}\p{{Z}}]|\r|.[\x01\x02]|[\x01\x02]."


def _visible() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


class _Pieces(dict):
    """The ids of pieces (little-endian unsigned 32-bit), encoded by the library's model when first met;
    no ids for the gap between words."""

    def __init__(self, library) -> None:
        super().__init__()
        self.tokenize, self.visible, self.old = library.model.tokenize, _visible(), {_GAP: b""}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():  # only the blank looks different
                visible = piece.replace(" ", "\u0120")
            else:
                visible = piece.encode().decode("latin-1").translate(self.visible)
            ids = array("I", [t.id for t in self.tokenize(visible)]).tobytes()
        if len(self) >= KEPT_PIECES // 2:
            self.old = {**self, _GAP: b""}
            self.clear()
        self[piece] = ids
        return ids


@cache
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return found, tuple(t.content for t in found.get_added_tokens_decoder().values()), _Pieces(found), splitter(PIECES)


def _words_ids(words: pa.Array, lacking: pa.Array, pieces: _Pieces, split) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct words one after the other, and each word's count; none for lacking ones."""
    first, after = pc.starts_with(words, _FIRST), pc.starts_with(words, "\n")
    bare = pc.if_else(first, pc.utf8_slice_codeunits(words, 1), pc.if_else(after, words, pc.binary_join_element_wise("", words, " ")))
    for mark, text in ((_FIRST, ""), (_LINE, "\n"), (_BLANK, " ")):
        at = pc.equal(words, mark)
        lacking = pc.or_(lacking, at) if not text else lacking
        bare = pc.if_else(at, text, bare)
    marks = pc.or_(pc.equal(bare, "\n"), pc.equal(bare, " "))
    plain = pc.if_else(pc.or_(lacking, marks), "x", bare)  # no piece of white space beside a gap
    cut = split(_GAP + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), _GAP)[0].as_py())
    ids = [*map(pieces.__getitem__, cut)]
    gaps = np.flatnonzero(np.fromiter(map(len, ids), np.int64, len(ids)) == 0)
    for k in np.flatnonzero(pc.or_(lacking, marks).to_numpy(zero_copy_only=False)):
        ids[gaps[k] + 1] = b"" if lacking[int(k)].as_py() else pieces[bare[int(k)].as_py()]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.frombuffer(b"".join(ids), "<u4"), np.add.reduceat(sizes, gaps)


def library_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, as the library gives them, one after the other, and each text's count.

    Texts are cut where the pre-tokenizer cuts too: at single blanks and newlines, and inside pairs of
    them. Each distinct word is cut into pieces once, each piece is encoded by the library's model
    and kept, and the words' ids are put together by their numbers. A text with longer runs of white
    space is cut into pieces as a whole; one that holds one of the vocabulary's added tokens, or a
    character that serves as a mark or gap here, goes to the library.
    """
    library, added, pieces, split = _library(path)
    if not len(texts):
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring(texts, _FIRST)
    for x in (_LINE, _BLANK, *added):
        odd = pc.or_(odd, pc.match_substring(texts, x))
    marked = pc.if_else(odd, "", texts)
    for x, mark in (("\n", " \n"), ("\n \n", f"{_LINE} \n"), ("  ", f" {_BLANK} ")):
        marked = pc.replace_substring(marked, x, mark)
    cut = pc.split_pattern(pc.binary_join_element_wise(_FIRST, marked, ""), " ")
    found = cut.flatten().dictionary_encode()
    at, ends = found.indices.to_numpy(), cut.offsets.to_numpy()
    lacking = pc.match_substring_regex(found.dictionary, _NO_WORD)
    flat, sizes = _words_ids(found.dictionary, lacking, pieces, split)
    each = sizes[at]
    out = flat[np.arange(each.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (np.cumsum(each) - each), each)]
    counts = np.add.reduceat(each, ends[:-1])
    odd = odd.to_numpy(zero_copy_only=False)
    runs = np.logical_or.reduceat(lacking.to_numpy(zero_copy_only=False)[at], ends[:-1])
    if (odd | runs).any():
        parts = np.split(out, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(odd | runs):
            text = texts[int(k)].as_py()
            if odd[k] or _GAP in text:
                parts[k] = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                parts[k] = np.frombuffer(b"".join(map(pieces.__getitem__, split(text))), "<u4")
            counts[k] = len(parts[k])
        out = np.concatenate(parts)
    return out, counts


# --- Spark jobs ---------------------------------------------------------------------------


def _save(folder: str, name: str, data: bytes) -> None:
    """Write under another name, then move: a task that runs again replaces a whole file by the same bytes."""
    system, path = fs.FileSystem.from_uri(folder)
    hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
    system.create_dir(path, recursive=True)
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, f"{path}/{name}")


def _rank(value: Column, bounds: list[int]) -> Column:
    """The number of sorted bounds below a value: first among every k-th bound, then among the k that
    follow, with k about the root of their number."""
    if not bounds:
        return F.lit(0)

    def constant(numbers: list[int]) -> Column:  # one literal, however long
        return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")

    k = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + k] for i in range(0, len(bounds), k)]
    inner = F.split(F.lit(";".join(",".join(map(str, row)) for row in rows)), ";")
    below = lambda array: F.size(F.filter(array, lambda b: b < value))
    row = F.greatest(below(constant([r[0] for r in rows])), F.lit(1))
    return (row - 1) * k + below(F.split(F.element_at(inner, row), ",").cast("array<bigint>"))


ROWS_AT_ONCE = 2_000


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``ROWS_AT_ONCE`` rows or 8 MB, whichever comes first."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= ROWS_AT_ONCE or size >= 8_000_000:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def write_token_files(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 0, ids_per_file: int = 4_000_000, docs_per_task: int = 8_000) -> tuple[str, DataFrame]:
    """Encode the texts, end each document with ``end_id``, and write token-id files in
    ascending order of ``key`` (nulls first). Gives the folder and the list of files
    (file, part, seq, n_docs, n_ids).

    Ranges of the key go to tasks (its quantiles come from the key column alone); each task
    sorts its range and streams it into files of about ``ids_per_file`` ids; a longer document
    has a longer file. Null texts are empty. Rows that share a key stay together, in order of their
    text, so a range's files hold the same bytes however its rows arrive: an attempt that runs again, or beside another, replaces a file by itself. There are
    100,000 ranges at most; a task holds one file's ids, however long its range is.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    n = docs.count()
    tasks = max(1, min(100_000, -(-n // docs_per_task)))
    bounds = docs.select(F.percentile_approx(key, [i / tasks for i in range(1, tasks)], 10 * tasks)).first()[0] if tasks > 1 else []
    bounds = sorted(set(bounds or []))
    part = F.when(F.col(key).isNull(), 0).otherwise(_rank(F.col(key).cast("long"), bounds)).cast("int")
    dealt = docs.select(part.alias("part"), F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        now, seq, keys, counts, held, total = -1, 0, [], [], [], 0

        def flush():
            nonlocal seq, keys, counts, held, total
            name = f"part-{now:06d}-{seq:06d}.pfor"
            _save(folder, name, file_bytes(keys, counts, np.concatenate(held)))
            out = pa.RecordBatch.from_pylist([{"file": name, "part": now, "seq": seq, "n_docs": len(keys), "n_ids": total}], listed)
            seq, keys, counts, held, total = seq + 1, [], [], [], 0
            return out

        for whole in _some_rows(batches):
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids, sizes = library_ids(batch.column(2), tokenizer)
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                ends = np.cumsum(sizes + 1)
                for p, k, n, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (sizes + 1).tolist(), ends.tolist(), strict=True):
                    if keys and (p != now or total >= ids_per_file):
                        yield flush()
                    if p != now:
                        now, seq = p, 0
                    keys.append(k)
                    counts.append(n)
                    held.append(ids[end - n : end])
                    total += n
        if keys:
            yield flush()
        give_back()

    files = written(dealt.mapInArrow(run, "file string, part int, seq int, n_docs bigint, n_ids bigint"), "token-file-list")
    return folder, files


def read_token_files(folder: str, files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): the documents of the files, ``start`` the number
    of ids of all documents before; ids as little-endian unsigned 32-bit integers, with their
    crc32. Without ``with_ids`` the ids are decoded and summed up, but not returned."""
    spark = files.sparkSession
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    if not files.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))

    names = ["file", "doc_id", "inside", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "file string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                docs, counts, ids = read_file(content.as_py())
                data, name = memoryview(ids.astype("<u4")).cast("B"), path.as_py().rsplit("/", 1)[-1]
                ends = np.cumsum(counts)
                for at in range(0, len(docs), 2_048):
                    s = slice(at, at + 2_048)
                    parts = [data[4 * a : 4 * b] for a, b in zip((ends[s] - counts[s]).tolist(), ends[s].tolist(), strict=True)]
                    columns = [pa.array([name] * len(parts)), pa.array(docs[s], pa.int64()), pa.array(ends[s] - counts[s]), pa.array(counts[s]), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([bytes(x) for x in parts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content").mapInArrow(run, schema)
    rows = rows.join(starts, "file").withColumn("start", F.col("base") + F.col("inside"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
