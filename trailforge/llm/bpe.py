"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece one token is stored: the last token of the prefix's own BPE
encoding. It is unique: of the tokens that end the prefix, exactly one goes together with the
last token of the shorter prefix that it leaves. Appending bytes adds entries and changes none;
after an edit only the entries near it are worked out again.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.pretokens import splitter


def load_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        #: The longest token that ends in these two bytes.
        self._reach: dict[bytes, int] = {}
        for token in ranks:
            end = token[-2:]
            if self._reach.get(end, 0) < len(token):
                self._reach[end] = len(token)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token that
        merging never makes."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                made = [self.ranks.get(self.tokens[a] + self.tokens[b], token) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(made)
                if best >= token:
                    break
                at = made.index(best)
                parts[at : at + 2] = [best]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        """Whether the BPE encoding of the token's own bytes is the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two adjacent tokens alone.

        Both tokens' merges are undone, the later first. The parts at the border would merge
        across it if their pair's rank is below that of the merge that took one of them away
        (of equal ranks the one further left goes first).
        """
        tokens, ranks, limit, ok = self.tokens, self.ranks, 1 << 40, True
        x, y = left, right
        while True:
            across = ranks.get(tokens[x] + tokens[y])
            if across is not None and across < limit:
                ok = False
                break
            x_late = x if len(tokens[x]) > 1 else -1
            y_late = y if len(tokens[y]) > 1 else -1
            if x_late > y_late:
                limit, x = x, self.halves(x)[1]
            elif y_late >= 0:
                limit, y = y + 1, self.halves(y)[0]
            else:
                break
        if len(self._fits) > 150_000:
            self._fits.clear()  # in place: extend() holds its get
        self._fits[left << 32 | right] = ok
        return ok

    def extend(self, data: bytes, last: list[int], stop: Callable[[int], bool] | None = None) -> None:
        """Add to ``last`` (entry i: the last token of the prefix of i + 1 bytes) what it lacks of ``data``."""
        ranks, fits, known, reach = self.ranks.get, self.fits, self._fits.get, self._reach.get
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - reach(data[max(0, end - 2) : end], 1)), end):
                token = ranks(data[start:end])
                if token is None:
                    continue
                if start:
                    fit = known(last[start - 1] << 32 | token)
                    if not (fits(last[start - 1], token) if fit is None else fit):
                        continue
                if self.made(token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if stop is not None and stop(end):
                return

    def ids(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece's ids: a piece that is a token is that token, whether or not merging makes it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.ids(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableEncoding:
    """The encoding of one byte string that grows and is edited."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b"") -> None:
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start`` to ``end``; gives the number of entries worked out anew.

        An entry depends on the bytes and entries of the longest token's length before it, so
        once that many entries in a row are as they were, all later ones are.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, run = old[:start], 0

        def settled(at: int) -> bool:
            nonlocal run
            was = at - 1 - shift
            run = run + 1 if at > start + len(new) and old[was] == self.last[-1] else 0
            return run >= self.bpe.longest

        self.bpe.extend(self.data, self.last, settled)
        done = len(self.last)
        self.last += old[done - shift :]
        return done - start

    def ids(self) -> list[int]:
        return self.bpe.ids(self.last)


@cache
def _encoder(path: str) -> PrefixBPE:
    return PrefixBPE(load_ranks(path))


#: Bytes of encoded pieces that a worker keeps between rows, by piece; emptied at this many.
KEPT_PIECES = 400_000
_kept: dict[tuple[str, str], dict[str, bytes]] = {}


def encode_texts(texts: list[str], path: str, pattern: str, most: int = KEPT_PIECES) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers.

    Pieces not seen lately are encoded in sorted order: each takes over the entries of the
    prefix that it shares with the one before, and appends the rest.
    """
    kept, bpe = _kept.setdefault((path, pattern), {}), _encoder(path)
    split = [*map(splitter(pattern), texts)]
    new = set().union(*split).difference(kept)
    if len(kept) + len(new) > most:
        kept.clear()
        new = set().union(*split)
    before, last = b"", []
    for piece, name in sorted([(p.encode("utf-8"), p) for p in new]):
        whole = bpe.ranks.get(piece)
        if whole is not None:
            kept[name] = whole.to_bytes(4, "little")
            continue
        same = 0
        for x, y in zip(before, piece, strict=False):
            if x != y:
                break
            same += 1
        del last[same:]
        bpe.extend(piece, last)
        before = piece
        kept[name] = array("I", bpe.ids(last)).tobytes()
    return [b"".join(map(kept.__getitem__, s)) for s in split]


def encode_docs(docs: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = True, names: tuple[str, str, str] = ("n_tokens", "ids", "decoded"), kept_pieces: int = KEPT_PIECES) -> DataFrame:
    """All columns of ``docs`` but the text (and any named like a new one), with the count of
    ids, the ids (binary, little-endian unsigned 32-bit) and, with ``decode``, the bytes that
    decoding these ids gives.

    Null and empty texts have no ids. Special tokens are never made. Rows are independent: ties,
    repeated rows and null ids pass through. The vocabulary is read by each worker from ``path``,
    which every executor must have; a worker keeps the ids of up to
    ``kept_pieces`` pieces (about 250 bytes each) for its later tasks.
    """
    new = names if decode else names[:2]
    keep = [c for c in docs.columns if c not in (text, *new)]
    kinds = {"n_tokens": "bigint", "ids": "binary", "decoded": "binary"}
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {k}" for n, k in zip(new, kinds.values(), strict=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = encode_texts([t or "" for t in batch.column(0).to_pylist()], path, pattern, kept_pieces)
                columns = [*batch.columns[1:], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *new])

    return docs.select(F.col(text).alias("__tf_text"), *keep).mapInArrow(run, schema)
