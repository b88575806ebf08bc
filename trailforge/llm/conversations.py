"""Repair of conversation structure by a rank-compressed dynamic program over macro edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import give_back, written

SPACES = " \t\n\v\f\r"
#: What a prefix of repaired turns ends with: nothing, the system turn, a user turn, an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after one more turn that an insert or a new role gives.
NEXT = (USER, USER, ASSISTANT, USER)
#: A turn's fault, in the order of precedence, and what it costs to keep it.
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
INSERT, REROLE, DELETE = 2, 2, 3


def _after_inserts(state: int, run: int) -> int:
    for _ in range(run):
        state = NEXT[state]
    return state


#: Macro edits: a run of inserts, then what happens to the turn. No code is the beginning of another, so lists of
#: as many codes compare like their texts. Longer runs only come back to a state that a shorter one reaches.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")


@lru_cache(maxsize=32)
def moves(kind: int) -> tuple[tuple[int, int, int, int], ...]:
    """(from, code, to, cost) of every macro edit of a turn; ``kind`` is its role's initial (s, u, a, other) and fault."""
    initial, fault = divmod(kind, 4)
    kept = {(NONE, 0): SYSTEM, (NONE, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
    out = []
    for number, code in enumerate(CODES):
        for state in range(4):
            at, cost = _after_inserts(state, len(code) - 1), INSERT * (len(code) - 1)
            if code[-1] == "D":
                out.append((state, number, at, cost + DELETE))
            elif fault <= TRUNCATED and code[-1] == "R":
                out.append((state, number, NEXT[at], cost + REROLE + fault))
            elif fault <= TRUNCATED and (at, initial) in kept:
                out.append((state, number, kept[at, initial], cost + fault))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def step(layer: tuple, kind: int) -> tuple[tuple, int, tuple]:
    """The next layer, what is taken off its costs, and each state's parent (state, code).

    A layer has for each state the (cost, rank) of its best prefix, or None: costs above the least, and
    the place of its audit among the layer's, which stands for the audit itself. What an assistant turn at the end
    (or a user turn and an insert) can go on to, nothing or a system turn at the end can do better by one deleted
    system turn at most; beyond that they are left out. So few layers occur, and they are looked up.
    """
    best: list = [None] * 4
    for state, code, to, cost in moves(kind):
        if layer[state] is not None:
            found = (layer[state][0] + cost, layer[state][1], code, state)
            if best[to] is None or found < best[to]:
                best[to] = found
    paired = min((b[0] + more for b, more in ((best[ASSISTANT], 0), (best[USER], INSERT)) if b is not None), default=None)
    if paired is not None:
        for state, lead in ((NONE, DELETE), (SYSTEM, 0)):
            if best[state] is not None and best[state][0] > paired + lead:
                best[state] = None
    reached = [b for b in best if b is not None]
    least, order = min(b[0] for b in reached), {k: n for n, k in enumerate(sorted({(b[1], b[2]) for b in reached}))}
    layer = tuple(None if b is None else (b[0] - least, order[b[1], b[2]]) for b in best)
    return layer, least, tuple(None if b is None else (b[3], b[2]) for b in best)


def begun(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def transfer(kinds: bytes) -> list[int]:
    """For each state before a block of turns and each after it, cost and rank of the best edits; -1 where there are none."""
    out = []
    for state in range(4):
        layer, cost = begun(state), 0
        for kind in kinds:
            layer, more, _ = step(layer, kind)
            cost += more
        for reached in layer:
            out += (-1, -1) if reached is None else (cost + reached[0], reached[1])
    return out


def through(layer: list, table: list[int]) -> tuple[list, list]:
    """The layer of (cost, rank) after a block, and each state's parent before it."""
    best: list = [None] * 4
    for state in range(4):
        if layer[state] is not None:
            for to in range(4):
                cost, rank = table[8 * state + 2 * to : 8 * state + 2 * to + 2]
                if cost >= 0:
                    found = (layer[state][0] + cost, layer[state][1], rank, state)
                    best[to] = found if best[to] is None else min(best[to], found)
    order = {k: n for n, k in enumerate(sorted({b[1:3] for b in best if b is not None}))}
    return [None if b is None else (b[0], order[b[1:3]]) for b in best], [None if b is None else b[3] for b in best]


def chosen(layer: list) -> tuple[int, int]:
    """(cost, state) of the best end: after nothing or an assistant turn, or inserts up to one."""
    more = {NONE: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
    return min((x[0] + more[s], x[1], s) for s, x in enumerate(layer) if x is not None)[::2]


def edits(kinds: bytes, start: int, end: int, last: bool) -> list[tuple[str, int]]:
    """(edit, state after it) of a block of turns from ``start`` to ``end``; after the last block, inserts complete a pair."""
    layer, parents = begun(start), []
    for kind in kinds:
        layer, _, back = step(layer, kind)
        parents.append(back)
    codes, state = [], end
    for back in reversed(parents):
        state, code = back[state]
        codes.append(CODES[code])
    out = []
    for code, kind in zip(reversed(codes), kinds, strict=True):
        for edit in code:
            if edit == "K" and kind // 4 == 0:
                state = SYSTEM
            elif edit != "D":
                state = NEXT[state]
            out.append((edit, state))
    while last and state in (SYSTEM, USER):
        state = NEXT[state]
        out.append(("I", state))
    return out


# --- blocks of turns ----------------------------------------------------------------------


def _kind(role: str, text: str) -> int:
    core = text.rstrip(SPACES)
    return 4 * "sua?".index(role[:1] if role[:1] in ("s", "u", "a") else "?") + (BLANK if not core else CLEAN if core[-1] in ".!?" else TRUNCATED)


def _cut(batches: Iterator[pa.RecordBatch], kind: pa.DataType, most_turns: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, turn, role, text) -> blocks of turns of one conversation, in their order."""
    part, seq = TaskContext.get().partitionId(), 0
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("seq", pa.int64()), ("turns", turns), ("kinds", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64())])
    done: list = []
    held: list = []
    size = chars = 0

    def closed() -> None:
        nonlocal seq, held, size
        numbers = [t for t, _, _ in held[1] if t is not None]
        done.append((held[0], part, seq, [{"role": r, "text": t} for _, r, t in held[1]], bytes(_kind(r, t) for _, r, t in held[1]), min(numbers, default=None), max(numbers, default=None), len(set(numbers))))
        seq, held, size = seq + 1, [], 0

    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            if held and (held[0] != conv or len(held[1]) >= most_turns or size + len(text) > most_chars):
                closed()
            if not held:
                held = [conv, []]
            held[1].append((turn, role, text))
            size, chars = size + len(text), chars + len(text)
            if len(done) >= 2000 or chars >= most_chars:
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done, chars = [], 0
    if held:
        closed()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    give_back()


def blocks(rows: DataFrame, most_turns: int = 4096, most_chars: int = 1 << 22) -> DataFrame:
    """(conv, part, seq, turns, kinds, low, high, distinct, twice): rows (conv, turn, role, text), by turn (nulls
    first; then role and a hash of the text), cut into blocks of one conversation, in the order of part and seq.

    ``kinds`` has a byte for each turn, ``twice`` the places of turns whose role and text the conversation has
    earlier. Conversations are sorted by ranges, so that a long one is cut by many tasks.
    """
    spark = rows.sparkSession
    conv = rows.schema["conv"].dataType
    kind = pa.int64() if conv.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    order = ["conv", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()]  # the last cuts a range of equal rows
    rows = rows.select(F.col("conv").cast("bigint" if kind == pa.int64() else "string").alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    rows = rows.withColumns({f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *[f"_o{i}" for i in range(5)]).sortWithinPartitions(*[f"_o{i}" for i in range(5)])
    cut = ranges.select("conv", "turn", "role", "text").mapInArrow(
        lambda batches: _cut(batches, kind, most_turns, most_chars),
        f"conv {'bigint' if kind == pa.int64() else 'string'}, part int, seq bigint, turns array<struct<role:string,text:string>>, kinds binary, low bigint, high bigint, distinct bigint",
    )
    cut = written(cut, "turn-blocks")
    each = cut.select("conv", "part", "seq", F.posexplode("turns").alias("at", "turn"))
    each = each.select("conv", F.col("turn.role").alias("role"), F.sha2("turn.text", 256).alias("digest"), F.struct("part", "seq", "at").alias("place"))
    again = each.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first"), "repeats")
    again = F.broadcast(again) if again.count() <= 200_000 else again  # counted; Spark cuts a frequent turn's rows apart where it joins them
    twice = each.join(again, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))).where("place > first")
    twice = written(twice.groupBy(F.col("place.part").alias("part"), F.col("place.seq").alias("seq")).agg(F.collect_list("place.at").alias("twice")), "twice")
    twice = F.broadcast(twice) if twice.count() <= 200_000 else twice
    return cut.join(twice, ["part", "seq"], "left")


def _marked(kinds: bytes, twice: list[int] | None) -> bytes:
    """The kinds with the repeated turns that are not blank as duplicates."""
    out = bytearray(kinds)
    for at in twice or ():
        if out[at] % 4 != BLANK:
            out[at] = out[at] // 4 * 4 + DUPLICATE
    return bytes(out)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv, part, seq, kinds, twice, low, high, distinct) -> with their transfer table and counts instead of the kinds."""
    for batch in batches:
        kinds = [_marked(k, t) for k, t in zip(batch.column("kinds").to_pylist(), batch.column("twice").to_pylist(), strict=True)]
        faults = [[sum(k % 4 == f for k in x) for x in kinds] for f in (BLANK, DUPLICATE, TRUNCATED)]
        wrong = [sum((a // 4, b // 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(x, x[1:], strict=False)) for x in kinds]
        own = [pa.array(x, pa.int64()) for x in (*faults, wrong, [x[0] // 4 for x in kinds], [x[-1] // 4 for x in kinds])]
        table = pa.array([transfer(x) for x in kinds], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "seq", "low", "high", "distinct")), *own, table], ["conv", "part", "seq", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last", "table"])


def _decided(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Tables sorted by conversation and block -> for each block its place, the states before and after it, whether
    it is the last, and at the last the conversation's counts. Of a conversation, a few numbers a block are kept."""
    names = ["blank", "duplicate", "truncated", "illegal"]
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("seq", pa.int64()), ("place", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("final", pa.bool_()), *((n, pa.int64()) for n in ("gaps", *names, "cost"))])

    def ended() -> pa.RecordBatch:
        cost, state = chosen(layer)
        states = [state]
        for back in reversed(parents):
            states.append(back[states[-1]])
        states.reverse()
        n, rest = len(places), [None] * (len(places) - 1)
        gaps = high - low + 1 - distinct if low is not None else 0
        cols = [[conv] * n, *zip(*places, strict=True), range(n), states[:-1], states[1:], [False] * (n - 1) + [True], [*rest, gaps], *([*rest, counts[k]] for k in names), [*rest, cost]]
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    places: list = []
    out: list = []
    for batch in batches:
        for row in batch.to_pylist():
            if places and row["conv"] != conv:
                out.append(ended())
                places = []
            if not places:
                conv, layer, parents, places, counts, low, high, distinct, before = row["conv"], list(begun(NONE)), [], [], dict.fromkeys(names, 0), None, None, 0, None
            layer, back = through(layer, row["table"])
            parents.append(back)
            places.append((row["part"], row["seq"]))
            for n in names:
                counts[n] += row[n]
            if before is not None and (before, row["first"]) not in ((0, 1), (1, 2), (2, 1)):
                counts["illegal"] += 1
            before = row["last"]
            if row["low"] is not None:
                distinct += row["distinct"] - (high == row["low"])
                low, high = row["low"] if low is None else low, row["high"]
        if len(out) >= 1000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if places:
        out.append(ended())
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def decisions(cut: DataFrame) -> DataFrame:
    """For each block the states before and after it in the cheapest repair of its conversation, with the
    conversation's counts at its last block. Each block is one small table of 16 costs and ranks; a
    conversation's tables, one for 4,096 turns, are put together in one task."""
    spark = cut.sparkSession
    kind = pa.int64() if cut.schema["conv"].dataType.simpleString() == "bigint" else pa.string()
    conv = f"conv {'bigint' if kind == pa.int64() else 'string'}, part int, seq bigint"
    tables = cut.select("conv", "part", "seq", "kinds", "twice", "low", "high", "distinct").mapInArrow(
        _tables, f"{conv}, low bigint, high bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first bigint, last bigint, table array<bigint>"
    )
    tables = tables.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "part", "seq")
    found = tables.mapInArrow(lambda b: _decided(b, kind), f"{conv}, place bigint, start int, end int, final boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint")
    return written(found, "decisions")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (conv, place, final, start, end, kinds, twice, turns) -> (conv, place, final, edits)."""
    entry = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        out = []
        for row in batch.select(["start", "end", "final", "kinds", "twice", "turns"]).to_pylist():
            own, turns = [], iter(row["turns"])
            for edit, state in edits(_marked(row["kinds"], row["twice"]), row["start"], row["end"], row["final"]):
                turn = None if edit == "I" else next(turns)
                own.append({"edit": edit, "role": None if edit == "D" else turn["role"] if edit == "K" else ROLES[state], "text": "" if edit == "I" else None if edit == "D" else turn["text"]})
            out.append(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "place", "final")), pa.array(out, entry)], ["conv", "place", "final", "edits"])
    give_back()


def repaired(cut: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv, place, final, edits): of each block, in order of ``place``, its edits (edit, role, text): what the repaired
    conversation has there; role and text are null where a turn is deleted."""
    conv = "bigint" if cut.schema["conv"].dataType.simpleString() == "bigint" else "string"
    both = cut.drop("conv").join(decided.select("conv", "part", "seq", "place", "start", "end", "final"), ["part", "seq"])
    both = both.select("conv", "place", "final", "start", "end", "kinds", "twice", "turns")
    return both.mapInArrow(_repaired, f"conv {conv}, place bigint, final boolean, edits array<struct<edit:string,role:string,text:string>>")


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation: (counts, edits).

    ``counts`` has a row for each conversation with gaps in its turns, faults by kind (a turn counts under its
    first: blank, duplicate, truncated), illegal neighbours, and the repair's cost. ``edits`` has
    its edits by blocks (``repaired``). Keep costs 0, a new role 2, delete 3 (blank and duplicate turns must go), an empty
    inserted turn 2, and each truncated turn that stays 1; roles then read ``(s?(ua)+)?`` by their initials. Of equally cheap
    repairs the one with the ASCII-least audit wins.

    Turns are layers of a dynamic program with four states. A turn's macro edits have prefix-free codes, so a
    state's audit is its rank in its layer, and edits are found again by parent pointers. Blocks of turns run apart: a
    block is a table from states to states, and only these meet in one task for a conversation.

    Null roles and texts are one space; null turns come first; a null key is a conversation. Turns that agree in
    number are ordered by role and a hash of their text; repeated rows are duplicates. Empty input gives no rows.
    Other columns are ignored. Very long texts make blocks of their own.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    cut = blocks(rows.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text")))
    decided = decisions(cut)
    counts = decided.where("final").select(F.col("conv").alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return counts, repaired(cut, decided).withColumnRenamed("conv", key)


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (key, turn, role, text) with faults of known places, for tests of a repair: by the crc32 of ``key:turn`` modulo 20,
    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role ``user``. Nulls
    of role and text, and in the hashed name, are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(key), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = rows.select(F.col(key), F.col(turn), space(role).alias(role), space(text).alias(text), fault.alias("__tf_fault")).where("__tf_fault <> 0")
    fresh = F.when(F.col("__tf_fault") == 1, "").when(F.col("__tf_fault") == 2, F.regexp_replace(F.col(text), "[.!?]", "")).otherwise(F.col(text))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("__tf_fault") == 3, 2).otherwise(1)))
    rows = rows.select(key, turn, F.when(F.col("__tf_fault") == 4, "user").otherwise(F.col(role)).alias(role), fresh.alias(text), copies.alias("__tf_copy"))
    return rows.drop("__tf_copy")


def _joined(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces (conv, audit, lines, some) in order -> (conv, audit, sha256); texts go by, one piece at a time."""
    import hashlib

    schema = pa.schema([("conv", kind), ("audit", pa.string()), ("sha256", pa.string())])
    row = lambda: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, "".join(audit), digest.hexdigest()), schema, strict=True)], schema=schema)
    audit: list[str] = []
    for batch in batches:
        for name, more, lines, some in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            if audit and name != conv:
                yield row()
                audit = []
            if not audit:
                conv, digest, any_before = name, hashlib.sha256(), False
            audit.append(more)
            if some:
                digest.update((b"\n" if any_before else b"") + lines.encode("utf-8", "replace"))
                any_before = True
    if audit:
        yield row()


def digests(found: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, audit, sha256) of the edits of ``repaired``: their initials, and the digest of the repaired ``role:text`` lines.

    Conversations of one block stay in their tasks. The blocks of a longer one go by in one task, as a digest
    reads its text in order; none is held."""
    spark = found.sparkSession
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    lines, single = F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n"), (F.col("place") == 0) & F.col("final")
    pieces = found.select(
        F.col(key).alias("conv"), "place", F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"),
        F.when(single, F.sha2(lines, 256)).alias("sha256"), F.when(~single, lines).alias("lines"), (F.size(kept) > 0).alias("some"),
    )
    pieces = written(pieces, "pieces")
    kind = pa.int64() if found.schema[key].dataType.simpleString() == "bigint" else pa.string()
    more = pieces.where("sha256 is null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "place").select("conv", "audit", "lines", "some")
    more = more.mapInArrow(lambda b: _joined(b, kind), f"conv {'bigint' if kind == pa.int64() else 'string'}, audit string, sha256 string")
    return pieces.where("sha256 is not null").select("conv", "audit", "sha256").unionByName(more).withColumnRenamed("conv", key)
