"""Quality rules: fixed rules, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import written
from trailforge.llm.linear import fit_sparse, platt, sigmoid

SYMBOLS = b"#*$%&|<>"
DIM = 1 << 17  # the upper half for words and word pairs, the lower half for character n-grams
_HALF = DIM // 2
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(words, their code points, symbols, repeated lines, words in repeated 5-word windows)."""
    n = len(words)
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    symbols = int(_SYMBOL[np.frombuffer(data, np.uint8)].sum()) if data else 0
    seen, repeated = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += bool(line.split())
        else:
            seen.add(line)
    inside = 0
    if n >= 6:
        ids: dict[bytes, int] = {}
        codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64) + np.uint64(1)
        # exact: each code below 2**64 stands for one window, built up two words at a time
        window = codes
        for k in range(1, 5):
            window = window[:-1] * np.uint64(len(ids) + 1) + codes[k:]
            if (len(ids) + 1.0) ** (k + 1) > 2.0**63 / (len(ids) + 1.0):
                window = np.unique(window, return_inverse=True)[1].astype(np.uint64)
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[back] > 1)
        if len(starts):
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 5, -1)
            inside = int((np.cumsum(edge[:n]) > 0).sum())
    return n, len(text) - spaces, symbols, repeated, inside


def hashed(text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's character 1-, 2- and 4-grams, and of its words and word pairs."""
    chars: list[np.ndarray] = []
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if len(c):
        chars.append(c & np.uint32(_HALF - 1))
    if len(c) > 1:
        two = (c[:-1] * np.uint32(0x01000193)) ^ c[1:]
        chars.append((two * np.uint32(0x9E3779B1)) >> np.uint32(16))
        if len(c) > 3:
            four = (two[:-2] * np.uint32(0xC2B2AE3D)) ^ two[2:]
            chars.append((four * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    w = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pairs = (w[:-1] * np.uint32(31) + w[1:]) * np.uint32(0x9E3779B1)
    return np.concatenate(chars) if chars else np.zeros(0, np.uint32), np.concatenate([w & np.uint32(_HALF - 1), pairs >> np.uint32(16)])


def margin(text: str, words: list[bytes], weights: np.ndarray, bias: float) -> float:
    """The regression's margin; features are the n-grams' shares of the text."""
    chars, tokens = hashed(text, words)
    out = bias
    if len(chars):
        out += SCALE * float(weights[:_HALF][chars].mean())
    if len(tokens):
        out += SCALE * float(weights[_HALF:][tokens].mean())
    return out


SCALE = 30.0


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    chars, tokens = hashed(text, text.encode("utf-8", "replace").split())
    at, x = [], []
    for start, found in ((0, chars), (_HALF, tokens)):
        if len(found):
            u, n = np.unique(found, return_counts=True)
            at.append(u.astype(np.int32) + start)
            x.append((SCALE * n / len(found)).astype(np.float32))
    return (np.concatenate(at), np.concatenate(x)) if at else (np.zeros(0, np.int32), np.zeros(0, np.float32))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = sorted((k, t or "", y) for b in batches for k, t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    y = np.array([r[2] for r in seen], float)
    if not len(seen) or not 0 < y.sum() < len(y):
        model = {"weights": "", "bias": 0.0, "platt": [0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))]}
    else:
        rows = [_row(t) for _, t, _ in seen]
        fold = np.array([zlib.crc32(str(k).encode()) % 5 == 4 for k, _, _ in seen])  # for calibration
        if not 0 < y[fold].sum() < fold.sum() or not 0 < y[~fold].sum() < (~fold).sum():
            fold = np.zeros(len(y), bool)
        w, bias = fit_sparse([r for r, f in zip(rows, fold, strict=True) if not f], y[~fold], DIM)
        held = fold if fold.any() else ~fold
        margins = np.array([w[at] @ x + bias for (at, x), f in zip(rows, held, strict=True) if f])
        model = {"weights": w.astype("<f4").tobytes().hex(), "bias": bias, "platt": platt(margins, y[held])}
    yield pa.RecordBatch.from_pylist([{"model": json.dumps(model)}])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most_rows: int = 5_000) -> dict:
    """The model, learned in one task from about ``most_rows`` labelled rows (all, if there are
    fewer; else those with the smallest hashes of the key). A fifth of them, by a hash of the
    key, only calibrates. A key with several labels counts as the least of them."""
    given = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    given = written(given, "labels")
    share = min(1.0, most_rows / max(1, given.count()))
    part = written(given.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "label-sample")
    part = F.broadcast(part) if part.count() <= 2 * most_rows else part  # bounded by most_rows, and counted
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.join(part, F.col("key") == F.col("_id")).select(F.col("_id").cast("string").alias("id"), "text", "_y")
    found = rows.repartition(1).mapInArrow(_fit, "model string").first()
    return json.loads(found[0]) if found else {"weights": "", "bias": 0.0, "platt": [0.0, 0.0]}


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: dict, text: str = "text", least_words: int = 10, most_repeated: int = 20, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` but the text (those named like a new one aside) with the counts of
    ``base_counts``, ``base_failed``, ``quality`` (the calibrated probability of label 1) and
    ``kept``.

    The base fails texts of fewer than ``least_words`` words or with more than ``most_repeated``
    per cent of the words in repeated windows; the others are kept at a probability of
    ``threshold`` or more. Null texts are empty. Every row is judged on its whole text alone, however long;
    repeated rows and null ids pass through, an empty table gives an empty result.
    """
    new = [*COLUMNS, "base_failed", "quality", "kept"]
    keep = [c for c in docs.columns if c not in (text, *new)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} bigint" for c in COLUMNS] + ["base_failed boolean", "quality double", "kept boolean"])
    packed, bias, (slope, offset) = model["weights"], model["bias"], model["platt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(bytes.fromhex(packed), "<f4") if packed else np.zeros(DIM, np.float32)
        for batch in batches:
            counts, margins = [], []
            for item in batch.column(0):
                body = item.as_py() or ""
                data = body.encode("utf-8", "replace")
                words = data.split()
                counts.append(base_counts(body, data, words))
                margins.append(margin(body, words, weights, bias))
            table = np.array(counts, np.int64).reshape(-1, len(COLUMNS))
            n, inside = table[:, 0], table[:, 4]
            failed = (n < least_words) | (100 * inside > most_repeated * n)
            p = sigmoid(slope * np.array(margins) + offset)
            columns = [*batch.columns[1:], *(pa.array(c) for c in table.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *new])

    return docs.select(F.col(text).alias("__tf_text"), *keep).mapInArrow(run, schema)
