"""Fingerprints, conversation repair and Merkle manifests against plain versions, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailforge.llm import conversations, fingerprints, merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, group string, pos int, digest string, steps int, fp binary, row int, h int, n int, part int"
MORE = ("k", "g", 1, "d", 2, b"f", 3, 4, 5, 6)
LONG = "Word and " * 40_000
TEXTS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, LONG, None, "a"), (4, "A b c d e f g", "en", "b"), (4, "A b c d e f g", "en", "b"), (4, "other", "en", "b"),
    (None, "A b c d e f g", "en", "b"), (None, "x", "en", "b"), (5, " \t\n ", "en", "c"), (6, "é" * 9, "de", "ü"), (7, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, len(t[1] or ""), *MORE) for t in TEXTS], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- fingerprints ----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = Counter(w.encode() for w in words)
    found.update(" ".join(words[i : i + 5]).encode() for i in range(len(words) - 4))
    votes = [0] * 128
    for term, n in found.items():
        h, weight = xxhash.xxh3_128_intdigest(term), round(16 + 16 * math.log(n))
        for b in range(128):
            votes[b] += weight if h >> (127 - b) & 1 else -weight
    return int("".join("1" if v > 0 else "0" for v in votes), 2)


def plain_edited(rows):
    out = []
    for (key, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        n = len(text)
        changed = text[: n - n // 2] + after[: n // 2]
        own, other, following = map(plain_fingerprint, (text, changed, after))
        near = lambda a, b: max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 128))
        out.append((key, n, hashlib.sha256(changed.encode()).hexdigest(), f"{own:032x}", f"{other:032x}", round(near(own, other), 9), round(near(own, following), 9)))
    return sorted(out, key=str)


def edited_rows(found):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fp).hex(), bytes(r.edited_fp).hex(), round(r.near_edited, 9), round(r.near_next, 9)) for r in found.collect()), key=str)


def test_edited_documents_equal_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = plain_edited([(r.doc_id, r.text or "") for r in rows])
    got = queries.op11_fingerprints(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == want
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    near = {k: sum((prints[k] ^ x).bit_count() <= 6 for x in prints.values()) - 1 for k in prints}
    assert all(r.n_near == (near[r.doc_id] if r.doc_id % 100 == 0 else None) for r in got)
    assert sum(r.near_edited > r.near_next for r in got if r.n_chars > 40) > 0.97 * sum(r.n_chars > 40 for r in got)


def test_edited_documents_edges(spark, docs, none):
    for parts in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id", F.xxhash64("text")).collect()
            assert edited_rows(fingerprints.edited(docs)) == plain_edited([tuple(r) for r in order])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert fingerprints.edited(none).count() == 0
    lone = fingerprints.edited(docs.where("doc_id = 6")).first()
    assert lone.near_next == 1.0 and lone.near_edited == 1.0 and lone.edited_sha256 == hashlib.sha256(("é" * 9).encode()).hexdigest()
    rows = {(r.doc_id, r.fp) for r in fingerprints.fingerprints(docs).collect()}
    assert len({p for k, p in rows if k in (1, 2, 5, 7)}) == 1 and {bytes(p) for k, p in rows if k == 1} == {bytes(16)}


@pytest.mark.parametrize(("radius", "chunk"), [(6, 4096), (6, 7), (3, 20), (0, 5)])
def test_search_within_a_radius_misses_nothing(spark, radius, chunk):
    rng = np.random.default_rng(radius + chunk)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    rows = []
    for _ in range(700):  # one crowded neighbourhood, others small
        bits = np.unpackbits(base[min(39, int(rng.exponential(6)))])
        bits[rng.choice(128, rng.integers(0, 9), replace=False)] ^= 1
        rows.append((len(rows), np.packbits(bits).tobytes()))
    rows += [(len(rows) + i, rows[i][1]) for i in range(50)] + [(None, rows[0][1]), (9999, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, fp binary").repartition(5)
    numbers = [(k, int.from_bytes(p, "big")) for k, p in rows if p is not None]
    asked = {x for k, x in numbers if k is not None and k % 10 == 0}
    want = {x: sum((x ^ y).bit_count() <= radius for _, y in numbers) for x in asked}
    got = {int.from_bytes(r.fp, "big"): r.n for r in fingerprints.within(table, F.col("doc_id") % 10 == 0, radius, chunk=chunk).collect()}
    assert got == want and max(want.values()) > 5
    pairs = fingerprints.within(table, F.col("doc_id") % 10 == 0, radius, pairs=True, chunk=chunk).collect()
    assert len(pairs) == len({(r.fp, r.other) for r in pairs})
    assert {(int.from_bytes(r.fp, "big"), int.from_bytes(r.other, "big")) for r in pairs} == {(x, y) for x in asked for _, y in numbers if (x ^ y).bit_count() <= radius}


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, fp binary")
    assert fingerprints.within(empty, F.col("doc_id") % 10 == 0).count() == 0
    some = spark.createDataFrame([(1, bytes(16))], "doc_id bigint, fp binary")
    assert fingerprints.within(some, F.col("doc_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("n", [0, 1, 10**4, 10**7, 10**10, 10**12])
def test_blocks_cover_every_choice(n):
    edges, choices = fingerprints.block_choices(n, 6)
    blocks = len(edges) - 1
    assert edges[0] == 0 and edges[-1] == 128 and len(choices) == math.comb(blocks, 6)
    for touched in itertools.combinations(range(blocks), 6):
        assert any(not set(c) & set(touched) for c in choices)


# --- conversation repair ------------------------------------------------------------------------

SPACE = " \t\n\v\f\r"
LEGAL = re.compile("(s?(ua)+)?")


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        core = text.strip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(turns):
    """The cheapest repair out of every edit sequence with at most two inserts between turns."""
    found = faults(turns)
    best = None
    per_turn = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    runs = ["", "u", "a", "ua", "au", "uu", "aa"]
    for acts in itertools.product(*per_turn):
        for gaps in itertools.product(runs, repeat=len(turns) + 1):
            cost, audit, initials, lines = 0, "", "", []
            for k, gap in enumerate(gaps):
                for x in gap:
                    cost, audit, initials = cost + 2, audit + "I", initials + x
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if k == len(turns):
                    break
                role, text = turns[k]
                audit += acts[k][0]
                if acts[k] == "D":
                    cost += 3
                    continue
                if acts[k] != "K":
                    cost, role = cost + 2, {"u": "user", "a": "assistant"}[acts[k][1]]
                cost += found[k] == "truncated"
                initials += role[:1] or "?"
                lines.append(f"{role}:{text}")
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def solved(turns, block):
    kinds, seen, twice = bytes(conversations._kind(r, t) for r, t in turns), set(), []
    for i, turn in enumerate(turns):
        twice += [i] * (turn in seen)
        seen.add(turn)
    kinds = conversations._marked(kinds, twice)
    parts = [kinds[i : i + block] for i in range(0, len(kinds), block)]
    layer, parents = list(conversations.begun(conversations.NONE)), []
    for part in parts:
        layer, back = conversations.through(layer, conversations.transfer(part))
        parents.append(back)
    cost, state = conversations.chosen(layer)
    states = [state]
    for back in reversed(parents):
        states.append(back[states[-1]])
    states.reverse()
    edits = [e for k, part in enumerate(parts) for e in conversations.edits(part, states[k], states[k + 1], k == len(parts) - 1)]
    rows, lines = iter(turns), []
    for edit, to in edits:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit != "D":
            lines.append(f"{role if edit == 'K' else conversations.ROLES[to]}:{text}")
    return cost, "".join(e for e, _ in edits), "\n".join(lines)


def test_repair_equals_enumeration():
    rng = random.Random(3)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randint(1, 3))]
        want = enumerated(turns)
        for block in (1, 2, 9):
            assert solved(turns, block) == want, turns


def test_layers_are_few():
    conversations.step.cache_clear()
    rng = random.Random(5)
    conversations.transfer(bytes(rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 10, 12]) for _ in range(50_000)))
    assert conversations.step.cache_info().currsize < 5000


def plain_repair(rows):
    """{conv: counts, cost, audit, digest} of rows (conv, turn, role, text) before damage; long conversations by ``solved``."""
    out, groups = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]  # every conversation
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            groups[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        pairs, numbers = [t[1:] for t in turns], {t[0] for t in turns if t[0] is not None}
        kinds = Counter(faults(pairs))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, lines = solved(pairs, 10**9) if pairs else (0, "", "")
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def test_repair_of_whole_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = queries.op12_conversation_repair(spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_repair([(r.conv_id, r.turn, r.role, r.text) for r in rows])


def made_conversations():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No", "", None, " \t", f"Well {t}!", "é" * 3])) for c in (1, 2, 3) for t in range((300, 7, 1)[c - 1])]
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (4, None, "user", "C."), (4, 2, "assistant", "D."), (5, None, None, None), (6, 1, "user", LONG), (6, 2, "assistant", LONG + "."), (6, 2, "assistant", LONG + ".")]
    return rows + [(7, k, "user", "x.") for k in range(400) if zlib.crc32(f"7:{k}".encode()) % 20 == 0][:2] + [(8, 10**12, "assistant", "y."), (8, -5, "", "z.")]


@pytest.mark.parametrize("most_turns", [4096, 3, 50])
def test_repair_edges(spark, monkeypatch, most_turns):
    rows = made_conversations()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, conv string, place int").repartition(3)
    cut = conversations.blocks
    monkeypatch.setattr(conversations, "blocks", lambda r: cut(r, most_turns=most_turns))
    counts, edits = conversations.repair(conversations.damaged(table))
    digests = {r.conv_id: (r.audit, r.sha256) for r in conversations.digests(edits).collect()}
    got = {r.conv_id: (*tuple(r)[1:], *digests[r.conv_id]) for r in counts.collect()}
    want = plain_repair(rows)
    assert want[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and 7 not in got
    assert got == {k: v for k, v in want.items() if k != 7}
    kept = [e for r in edits.orderBy("conv_id", "place").collect() if r.conv_id == 1 for e in r.edits if e.edit != "D"]
    assert LEGAL.fullmatch("".join(e.role[0] for e in kept))


def test_repair_of_nothing(spark):
    counts, edits = conversations.repair(conversations.damaged(spark.createDataFrame([], "conv_id string, turn int, role string, text string")))
    assert counts.count() == 0 and conversations.digests(edits).count() == 0


# --- Merkle manifests ----------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, low=False):
    out = ""
    for name in merkle.DOCUMENT_FIELDS:
        value = row[name]
        if low and name == "text" and value is not None:
            value = re.sub("[A-Z]", lambda m: m[0].lower(), value)
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return digest(out)


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_proofs(rows, fanout=16):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r["source"]].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = [plain_tree([plain_leaf(r) for r in groups[s]], fanout) for s in sources]
    top = plain_tree([t[-1][0] for t in trees], fanout)
    for g, s in enumerate(sources):
        for i, r in enumerate(groups[s]):
            steps = []
            for levels, k in ((trees[g], i), (top, g)):
                for level in levels[:-1]:
                    first = k // fanout * fanout
                    steps.append(("".join(level[first:k]), "".join(level[k + 1 : first + fanout])))
                    k //= fanout
            key = r["doc_id"]
            now = plain_leaf(r, key is not None and zlib.crc32(str(key).encode()) % 5 == 0)
            for left, right in steps:
                now = digest(left, now, right)
            out.append((key, plain_leaf(r), trees[g][-1][0], top[-1][0], digest(*[a + b for a, b in steps]), now, now == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_equals_a_plain_version(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_merkle_manifest(spark, SF).collect()), key=str)
    assert got == plain_proofs(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_edges(docs, none):
    rows = [r.asDict() for r in docs.collect()]
    assert sorted(map(tuple, merkle.document_proofs(docs).collect()), key=str) == plain_proofs(rows)
    assert merkle.document_proofs(none).count() == 0
    lone = merkle.document_proofs(docs.where("doc_id = 6")).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.verified and lone.proof_sha256 == digest("")


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 2), (16, 1)])
def test_manifest_in_many_rounds(spark, fanout, levels):
    """A hot group, many small ones, and several rounds of blocks; other columns come back."""
    rng = random.Random(fanout)
    rows = [(i, f"s{rng.choice([0] * 60 + list(range(40)))}", digest(str(i % 150)), "kept") for i in range(400)]
    table = spark.createDataFrame(rows, "id int, source string, hash string, steps_of string").repartition(3)
    found = merkle.manifest(table, "source", "id", "hash", fanout, levels)
    assert found.columns == ["id", "source", "hash", "steps_of", "subroot", "root", "steps"]
    got = {r.id: r for r in found.collect()}
    groups = defaultdict(list)
    for i, s, h, _ in rows:
        groups[s].append(h)
    trees = {s: plain_tree(groups[s], fanout) for s in groups}
    root = plain_tree([trees[s][-1][0] for s in sorted(groups)], fanout)[-1][0]
    for i, s, h, more in rows:
        r = got[i]
        assert (r.subroot, r.root, r.steps_of) == (trees[s][-1][0], root, more)
        for left, right in r.steps:
            h = digest(left, h, right)
        assert h == root and all((len(a) + len(b)) // 64 < fanout for a, b in r.steps)
