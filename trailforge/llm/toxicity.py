"""Toxicity by noisy-channel deobfuscation.

Disguised spellings are character lattices: a digit or symbol may stand for letters, a separator
for nothing, a stretched letter for one or two. The Viterbi path of a lattice under a character
language model of the whole corpus is the restored spelling; words and word beginnings of the
restored text are scored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import give_back, written
from trailforge.llm.linear import fit_dense, sigmoid

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœßùúûü"
SIZE = 64  # symbols of the language model: 0 for all that is no letter, 63 for other letters
_CODES = np.zeros(0x250, np.uint8)
_CODES[0xC0:] = 63
for _i, _c in enumerate(LETTERS):
    _CODES[ord(_c)] = _i + 1
_CODES[[0xD7, 0xF7]] = 0

#: What a character may stand for besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l", "¢": "c",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ι": "i",
}
SEPARATORS = " .-_*'~·/\\"
SWAP_COST, DROP_COST, KEEP_COST, STRETCH_COST = 1.0, 0.1, 7.0, 0.5
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\w)")
#: What gives a lattice an arc besides the word itself: a character that stands for others, a separator inside, a repeated letter.
_ARCS = re.compile(rf"[{re.escape(''.join(STANDS_FOR))}]|[^{re.escape(SEPARATORS)}][{re.escape(SEPARATORS)}]+[^{re.escape(SEPARATORS)}]|([^\W\d_])\1")
#: A stretch with no two fixed characters in a row: characters with arcs and runs, single others between them.
_CORE = re.compile(rf"(?:[{re.escape(''.join(STANDS_FOR) + SEPARATORS)}]|(.)\1+)(?:.??(?:[{re.escape(''.join(STANDS_FOR) + SEPARATORS)}]|(.)\2+))*", re.DOTALL)
_SPACE = re.compile(r"\s")
_EDGES = "\"'.,;:!?()[]{}<>|#%&*~«»“”…-_=+`"


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(points < 0x250, _CODES[np.minimum(points, 0x24F)], np.uint8(63))


class _Codes(dict):
    """The symbol of each character."""

    def __missing__(self, c: str) -> int:
        found = self[c] = int(_CODES[ord(c)]) if ord(c) < 0x250 else 63
        return found


_CODE = _Codes()


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid and (t := text.as_py()):
                s = _symbols(f"  {t.lower()} ").astype(np.int32)
                codes = s[:-2] * SIZE**2 + s[1:-1] * SIZE + s[2:]
                if len(codes) < 20_000:
                    np.add.at(counts, codes, 1)
                else:
                    counts += np.bincount(codes, minlength=SIZE**3)
    give_back()
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["code", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(symbol | two symbols before) over all texts: 64 x 64 x 64 numbers, whatever the corpus.

    Every task counts its trigrams, Spark sums the counts, and the driver gets the sums."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(_count_trigrams, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n3 = np.zeros(SIZE**3)
    n3[found.column("code").to_numpy()] = found.column("n").to_numpy()
    n3 = n3.reshape(SIZE, SIZE, SIZE)
    n2 = n3.sum(axis=0)
    n1 = n2.sum(axis=0)
    p1 = (n1 + 1) / (n1.sum() + SIZE)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2) / (n3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each step of a lower-case span the strings it may stand for, with their costs.

    Two equal characters that stand for letters may stand for two different ones; a longer run stands,
    like that of a letter, for one or two of the same, so a run of any length is one step."""
    steps: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", span, re.DOTALL):
        c, n = m[1], len(m[0])
        if c in STANDS_FOR:
            one = [(c, 0.0 if c.isalpha() else KEEP_COST), *((x, SWAP_COST) for x in STANDS_FOR[c])]
            if n <= 2:
                steps += [one] * n
            else:
                letters = [(x * k, SWAP_COST * k + STRETCH_COST * (n - k)) for x in STANDS_FOR[c] for k in (1, 2)]
                steps.append([(c * n, n * one[0][1]), *letters])
        elif c in SEPARATORS:
            steps.append([("", DROP_COST * n), (c * n, KEEP_COST)])
        elif c.isalpha() and n > 1:
            steps.append([(c, STRETCH_COST * (n - 1)), (c * 2, STRETCH_COST * (n - 2)), *([(c * n, KEEP_COST)] if n > 2 else [])])
        else:
            steps.append([(c * n, 0.0)])
    return steps


def _viterbi(before: str, core: str, after: str, model: list[float]) -> str:
    """The most likely spelling of ``core`` between fixed characters, where a state is the last two
    symbols. ``model`` is the flat list of a character model. A state keeps its score and the way
    back, so time and memory grow with the length alone."""
    first = [0, 0, *(_CODE[c] for c in before)][-2:]
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(first[0], first[1]): (0.0, None)}
    for step in [*lattice(core), *([(c, 0.0)] for c in after)]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        choices = [(string, cost, [_CODE[c] for c in string]) for string, cost in step]
        for (a, b), (score, way) in best.items():
            for string, cost, symbols in choices:
                x, y, s = a, b, score - cost
                for symbol in symbols:
                    s += model[(x * SIZE + y) * SIZE + symbol]
                    x, y = y, symbol
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, (way, string))
        best = new
    out, way = [], max(best.values(), key=lambda state: state[0])[1]
    while way is not None:
        way, string = way
        out.append(string)
    text = "".join(reversed(out))
    return text[: len(text) - len(after)]


def restore(span: str, model: list[float], known: dict[tuple[str, str, str], str]) -> str:
    """The most likely spelling behind a lower-case span: the Viterbi path of its lattice. Two fixed
    characters leave one state, so the path is that of each stretch between such places; stretches
    are kept in ``known``."""
    out, done = [], 0
    for m in _CORE.finditer(span):
        a, b = m.span()
        key = (span[max(0, a - 2) : a], m[0], f"{span[b : b + 2]} "[:2])
        found = known.get(key)
        if found is None:
            found = _viterbi(*key, model)
            if len(m[0]) <= 60:  # longer ones are worked out each time
                if len(known) >= 200_000:
                    known.clear()
                known[key] = found
        out += [span[done:a], found]
        done = b
    return "".join([*out, span[done:]]).strip()


class Restorer:
    """Restored words of texts; words met lately are kept, in two bounded generations."""

    KEPT = 100_000

    def __init__(self, model: np.ndarray) -> None:
        self.model, self.kept, self.old, self.cores = model.ravel().tolist(), {}, {}, {}

    def word(self, raw: str) -> tuple[str, ...]:
        """What a lower-case word is scored as: itself without marks at its ends, and if its
        lattice has any other path, what it is restored to."""
        found = self.kept.get(raw)
        if found is None:
            found = self.old.get(raw)
            if found is None:
                plain = raw.strip(_EDGES)
                found = (plain,) if plain else ()
                if _ARCS.search(raw):
                    found = tuple(dict.fromkeys([*found, restore(raw.strip("\"',;:?[]{}<>#%&*"), self.model, self.cores).strip(_EDGES)]))
            if len(raw) <= 100:  # longer ones are worked out each time
                if len(self.kept) >= self.KEPT:
                    self.kept, self.old = {}, self.kept
                self.kept[raw] = found
        return found

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        text = text.lower()
        out: set[str] = set()
        known = self.kept.get
        for raw in set(text.split()):
            found = known(raw)
            if found is None:
                found = self.word(raw)
                known = self.kept.get  # the generations may have changed
            out.update(found)
        for m in _SPACED.finditer(text):
            out.update(restore(_SPACE.sub(" ", m[0]), self.model, self.cores).split())
        return out


def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings."""
    return (word, f"4^{word[:4]}", f"5^{word[:5]}") if len(word) > 5 else (word, f"4^{word[:4]}") if len(word) > 4 else (word,)


def evidence(hits: list[float], n_words: int) -> list[float]:
    """(log count of telling words, the largest weight, telling words by root of all words)."""
    return [float(np.log1p(len(hits))), max(hits, default=0.0), len(hits) / (1.0 + n_words) ** 0.5]


class Weights(dict):
    """The weight of words: the largest of a word and its beginnings, 0 for a word that tells nothing."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = max((self.weights[f] for f in features(word) if f in self.weights), default=0.0)
        if len(self) >= 200_000:
            self.clear()
        self[word] = found
        return found


def telling(rows: list[tuple[np.ndarray, int]], words: list[str], least: int, least_weight: float) -> dict[str, float]:
    """The words and beginnings that toxic texts hold far more often than others,
    with their log ratios; the ratios' lower bounds count for ``least_weight``. ``rows`` are
    the numbers of a text's distinct words, with its label."""
    digests = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.int64)
    groups: dict[tuple, set[int]] = {}
    other = 0
    for ids, y in rows:
        other += not y
        if y:  # near copies, which mostly share the least hashes of their words, count once
            groups.setdefault(tuple(np.sort(digests[ids])[:SKETCH].tolist()), set()).update(ids.tolist())
    toxic = Counter(f for ids in groups.values() for f in {f for i in ids for f in features(words[i])})
    floor = max(least, 0.004 * len(groups))
    toxic = {f: n for f, n in toxic.items() if n >= floor}
    some = {i: found for i, w in enumerate(words) if (found := [f for f in features(w) if f in toxic])}
    mask = np.zeros(len(words), bool)
    mask[list(some)] = True
    clean = Counter(f for ids, y in rows if not y for f in {f for i in ids[mask[ids]].tolist() for f in some[i]})
    weights = {}
    for f, n in toxic.items():
        w = float(np.log((n + 0.5) / (len(groups) + 1)) - np.log((clean[f] + 0.5) / (other + 1)))
        doubt = 1.5 * (1 / (n + 0.5) + 1 / (clean[f] + 0.5)) ** 0.5
        if w - doubt >= least_weight:
            weights[f] = w
    # a beginning that one word accounts for says nothing more than the word
    whole: dict[str, int] = {}
    for f in weights:
        if "^" not in f:
            for b in features(f)[1:]:
                whole[b] = max(whole.get(b, 0), toxic[f])
    return {f: w for f, w in weights.items() if whole.get(f, 0) < 0.7 * toxic[f]}


SKETCH = 1  # least hashes that near copies share; with 2 or 3 more clean texts are called toxic (27 of 3,531 on sf0.1, not 15)
NOTHING_KNOWN = [0.0, 0.0, 0.0, -5.0]  # without any labelled row, no text is called toxic


def _restored(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            digest = [zlib.crc32(t.encode("utf-8", "replace")) for t in texts]
            words = pa.array([sorted(restorer.words(t)) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.int64()), words, batch.column(1)], ["digest", "words", "y"])
        del restorer
        give_back()

    return run


def _fit(least: int, least_weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        rows: list[tuple[int, list[int], int]] = []
        for batch in batches:
            for digest, words, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((digest, np.array([number.setdefault(w, len(number)) for w in words], np.int32), y))
        rows.sort(key=lambda r: (r[0], len(r[1]), r[2]))
        words, toxic = list(number), sum(r[2] for r in rows)
        if not rows:
            found, line = {}, NOTHING_KNOWN
        elif 0 < toxic < len(rows):
            # the line is fitted on evidence from words that the other half of the rows gave
            halves = [[(ids, y) for digest, ids, y in rows if digest % 2 == k] for k in (0, 1)]
            x, y = [], []
            for own, other in (halves, halves[::-1]):
                weights = Weights(telling(other, words, least, least_weight))
                of_word = np.array([weights[w] for w in words])
                x += [evidence([v for v in of_word[ids].tolist() if v], len(ids)) for ids, _ in own]
                y += [float(v) for _, v in own]
            line = fit_dense(np.array(x), np.array(y)).tolist()
            found = telling([(ids, y) for _, ids, y in rows], words, least, least_weight)
        else:  # one kind of label only: its smoothed share
            found, line = {}, [0.0, 0.0, 0.0, float(np.log((toxic + 1) / (len(rows) - toxic + 1)))]
        del rows, number, words
        give_back()
        yield pa.RecordBatch.from_pylist([{"model": json.dumps({"weights": found, "line": line})}])

    return run


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, text: str = "text", key: str = "doc_id", label: str = "toxic", most_rows: int = 12_000, least: int = 4, least_weight: float = 2.1) -> dict:
    """Weights of telling words and beginnings, and the logistic line over a text's evidence.

    The words of the labelled texts are restored in parallel; weights and line are learned in one task from about ``most_rows`` labelled rows (all, if there are fewer; else
    those with the smallest hashes of the key), of equal texts one. Labels other than 0 and 1 and
    null keys are ignored. A telling word or beginning is in ``least`` toxic texts, and in four of a thousand of
    them, near copies counted once. A key with several labels counts as toxic if any says so.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    given = written(given, "labels")
    share = min(1.0, most_rows / max(1, given.count()))
    part = written(given.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "label-sample")
    part = F.broadcast(part) if part.count() <= 2 * most_rows else part  # bounded by most_rows, and counted
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.join(part, F.col("key") == F.col("_id")).select("text", "_y").dropDuplicates(["text", "_y"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(min(n, 100), F.xxhash64("text")).mapInArrow(_restored(model), "digest bigint, words array<string>, y int")
    found = written(rows, "labelled-words").repartition(1).mapInArrow(_fit(least, least_weight), "model string").first()
    return json.loads(found[0]) if found else {"weights": {}, "line": NOTHING_KNOWN}


def score(docs: DataFrame, model: np.ndarray, learned: dict, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` (one named like the new one aside) and ``name``, from 0 to 1. Only
    the text is an input; null and empty texts have no evidence. Every row is scored on its whole text:
    words, runs and spaced spellings of any length are decoded whole."""
    keep = [c for c in docs.columns if c != name]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{name}` double"])
    weights, line = learned["weights"], np.array(learned["line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, weigh = Restorer(model), Weights(weights)
        for batch in batches:
            found = (restorer.words(t.as_py() or "") for t in batch.column(0))
            x = np.array([evidence([v for v in map(weigh.__getitem__, words) if v], len(words)) for words in found]).reshape(-1, 3)
            p = sigmoid(x @ line[:-1] + line[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], [*keep, name])
        del restorer
        give_back()

    return docs.select(F.col(text).alias("__tf_text"), *keep).mapInArrow(run, schema)
