"""Synthetic scenarios and the statistics over them."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.functions.ranges import numbered
from trailforge.operators.boundary import detect
from trailforge.operators.classify import chains, mode_break, reports, unit_actor_counts
from trailforge.operators.ordering import order_fragments
from trailforge.schema import AGENTIC, CATEGORIES, PROPERTIES
from trailforge.sources.manifests import promoted
from trailforge.sources.scratch import written

# Fixed values of the synthetic matrix.
START, SEED_STEP = 1_700_000_000.0, 100.0
TOOLS = ("search", "write", "exec", "query", "fetch")
MODELS = ("gpt-4o", "claude-3-5", "llama-70b")

_RAW = "scenario_id string, architecture string, stack_tier string, seed int, truth array<int>, seq bigint, fragment_id string, timestamp double, kind string, fragment_tier string, actor_id string, payload string"


def stable_seed(*names: Column) -> Column:
    """The first 31 bits of the digest of the names, joined by ``|``."""
    digest = F.sha2(F.concat_ws("|", *[n.cast("string") for n in names]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def seeds(spark: SparkSession, per_cell: int) -> DataFrame:
    """(cell, k, architecture, tier, seed): a row for each scenario of the matrix."""
    cells = [(i, a, t) for i, (a, t) in enumerate([(a, t) for a in AGENTIC for t in ("within_stack", "cross_stack")] + [("non_agentic", "baseline")])]
    dims = spark.createDataFrame(cells, "cell int, architecture string, tier string")
    seed = stable_seed(F.col("architecture"), F.col("tier"), F.col("k"))
    return spark.range(per_cell).select(F.col("id").cast("int").alias("k")).crossJoin(F.broadcast(dims)).withColumn("seed", seed)


class _Draws:
    """One scenario's fragments; the order of the draws is what makes two runs agree."""

    def __init__(self, architecture: str, tier: str, seed: int) -> None:
        self.rng, self.architecture, self.tier, self.seed = random.Random(seed), architecture, tier, seed
        self.rows: list[tuple] = []
        self.truth: list[int] = []

    def agentic(self) -> None:
        rng, human = self.rng, self.architecture == "human_in_the_loop"
        multi, within = self.architecture == "multi_agent", self.tier == "within_stack"
        steps = rng.randint(5, 12)
        names = [f"agent_{rng.randint(1000, 9999)}" for _ in range(rng.randint(3, 5) if multi else 1)]
        if human:
            names.append(f"operator_{rng.randint(100, 999)}")
        now = START + self.seed * SEED_STEP
        for step in range(steps):
            turn = human and step % 3 == 2
            actor = rng.choice(names) if multi else names[-1 if turn else 0]
            kinds = ["config_snapshot", "policy_snapshot"] * (step == 0) + ["agent_message"] * multi + ["model_generation"]
            kinds += ["tool_call"] * (within or rng.random() < 0.7)
            kinds += ["retrieval_result"] * (within or rng.random() < 0.4)
            kinds += ["state_mutation"] * (rng.random() < 0.3)
            if turn:
                kinds.append("human_approval" if rng.random() < 0.8 else "human_rejection")
            for kind in kinds:
                now += rng.uniform(0.1, 2.0)
                body = {"step": step, "primary_actor": names[0]} | self._extra(kind)
                self.rows.append((now, kind, "human" if kind == "human_approval" else self.tier, actor, body))
            if step + 1 < steps:
                self.truth.append(len(self.rows) - 1)

    def _extra(self, kind: str) -> dict:
        rng = self.rng
        if kind == "state_mutation":
            return {"state_change_magnitude": rng.uniform(0.2, 1.0)}
        if kind == "policy_snapshot":
            return {"constraint_activated": rng.random() < 0.3, "policy_id": f"pol_{rng.randint(1, 20)}"}
        if kind == "tool_call":
            return {"tool_name": rng.choice(TOOLS), "args": {"key": rng.randint(0, 99)}}
        if kind == "model_generation":
            return {"model_id": rng.choice(MODELS), "token_count": rng.randint(50, 2000)}
        return {}

    def baseline(self) -> None:
        """A rule engine's single decision: eight fragments, half a second apart."""
        rng, self.truth = self.rng, [3]
        engine = f"rule_engine_{rng.randint(1, 9)}"
        bodies = [
            ("config_snapshot", {"config_version": f"v{rng.randint(1, 30)}"}),
            ("policy_snapshot", {"policy_id": f"pol_{rng.randint(1, 20)}", "constraint_activated": True}),
            ("retrieval_result", {"row_id": rng.randint(1000, 9999)}),
            ("tool_call", {"tool_name": "decision_engine", "args": {}}),
            ("state_mutation", {"state_change_magnitude": 1.0, "decision": "approve"}),
        ]
        operator = f"operator_{rng.randint(100, 999)}"
        bodies.append(("human_approval", {"approved_by": f"operator_{rng.randint(100, 999)}"}))
        bodies += [("model_generation", {"model_id": "rule_engine", "deterministic": True}), ("agent_message", {"content": "input received"})]
        for i, (kind, body) in enumerate(bodies):
            human = kind == "human_approval"
            self.rows.append((START + self.seed * SEED_STEP + 0.5 * i, kind, "human" if human else "within_stack", operator if human else engine, body))


def _generated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for architecture, tier, seed in batch[["architecture", "tier", "seed"]].itertuples(index=False):
            made = _Draws(architecture, tier, seed)
            made.baseline() if architecture == "non_agentic" else made.agentic()
            wire = "within_stack" if tier == "baseline" else tier
            for seq, (ts, kind, own, actor, body) in enumerate(made.rows):
                out.append((f"{architecture}_{tier}_seed{seed}", architecture, wire, seed, made.truth, seq, f"s{seed}_f{seq:03d}", ts, kind, own, actor, json.dumps(body)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RAW.split(", ")])


def matrix(spark: SparkSession, per_cell: int = 20) -> tuple[DataFrame, DataFrame]:
    """(scenarios with seed, truth and position, fragments) of the synthetic matrix."""
    keys = seeds(spark, per_cell)
    raw = keys.repartition("seed").mapInPandas(_generated, _RAW)
    first = raw.where("seq = 0").select("scenario_id", "architecture", "stack_tier", "seed", "truth")
    order = keys.select(F.concat("architecture", F.lit("_"), "tier", F.lit("_seed"), F.col("seed").cast("string")).alias("scenario_id"), (F.col("cell") * per_cell + F.col("k")).alias("position"))
    fragments = raw.select("scenario_id", "seq", "fragment_id", "timestamp", "kind", F.col("fragment_tier").alias("stack_tier"), "actor_id", "payload", F.lit(None).cast("string").alias("parent_trace_id"), F.lit(None).cast("string").alias("decision_id_hint"))
    return first.join(order, "scenario_id"), promoted(fragments)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def in_set_order(positions: pd.Series) -> pd.Series:
    """The distinct positions of each list in the order of a Python set, in which the recorded results took them."""
    return positions.map(lambda p: list({int(x) for x in p}))


def matched(found: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """(scenario_id, hits): how many found boundaries (scenario_id, pos) have a true one (scenario_id, pos, place) of
    their own, at most ``tolerance`` fragments off.

    In order of position each found boundary takes, of the free true ones in reach, the one with the least
    ``place``. Positions in reach meet by an equi-join on each offset. Found boundaries that share no true
    one with an earlier one begin a run; runs decide nothing about each other, and each is settled by one
    fold over its own rows, which remembers only the true ones still in reach. Repeated positions are one.
    """
    truth = truth.groupBy("scenario_id", F.col("pos").alias("t")).agg(F.min("place").alias("place"))
    reach = F.explode(F.sequence(F.col("pos") - tolerance, F.col("pos") + tolerance)).alias("t")
    near = found.select("scenario_id", "pos").distinct().select("scenario_id", "pos", reach).join(truth, ["scenario_id", "t"])
    near = near.groupBy("scenario_id", "pos").agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias("near"))
    by = Window.partitionBy("scenario_id").orderBy("pos")
    begins = F.when(F.col("pos") - F.lag("pos").over(by) <= 2 * tolerance, 0).otherwise(1)
    runs = near.withColumn("_begins", begins).withColumn("run", F.sum("_begins").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("scenario_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "near"))).alias("rows"))

    def step(done, row):
        mine = F.slice(F.filter(F.transform(row["near"], lambda x: x["t"]), lambda t: ~F.array_contains(done["taken"], t)), 1, 1)
        still = F.filter(done["taken"], lambda t: t > row["pos"] - tolerance)
        return F.struct((done["hits"] + F.size(mine)).cast("long").alias("hits"), F.concat(still, mine).alias("taken"))

    start = F.struct(F.lit(0).cast("long").alias("hits"), F.array().cast("array<int>").alias("taken"))
    settled = runs.select("scenario_id", F.aggregate("rows", start, step)["hits"].alias("hits"))
    return settled.groupBy("scenario_id").agg(F.sum("hits").alias("hits"))


def boundary_f1(scenarios: DataFrame, found: DataFrame, truth: DataFrame, tolerance: int = 1) -> DataFrame:
    """(scenario_id, found, truth, hits, boundary_f1) of each scenario: F1 of the found boundaries (scenario_id, pos)
    against the true ones (scenario_id, pos, place), matched one to one. Two empty sides agree fully, one alone not at all."""
    count = lambda rows, name: rows.groupBy("scenario_id").agg(F.count(F.lit(1)).alias(name))
    rows = scenarios.select("scenario_id").join(count(found, "found"), "scenario_id", "left").join(count(truth, "truth"), "scenario_id", "left")
    rows = rows.join(matched(found, truth, tolerance), "scenario_id", "left").fillna(0, ["found", "truth", "hits"])
    precision, recall = F.col("hits") / F.col("found"), F.col("hits") / F.col("truth")
    empty = (F.col("found") == 0) | (F.col("truth") == 0)
    f1 = F.when(empty, (F.col("found") == F.col("truth")).cast("double")).when(F.col("hits") == 0, 0.0).otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    return rows.withColumn("boundary_f1", f1)


def detected_positions(detected: DataFrame) -> DataFrame:
    """(scenario_id, pos): the places, from 0, of the last fragments of all units but the last."""
    return detected.where("reason is not null and rn > 1").select("scenario_id", (F.col("rn") - 2).cast("int").alias("pos"))


def evaluate(scenarios: DataFrame, fragments: DataFrame) -> DataFrame:
    """A row for each scenario: the report, and F1 against the true boundaries (an array of positions).

    The fragments are ordered and cut once, into a written table."""
    detected = written(detect(order_fragments(fragments)).select("scenario_id", "rn", "kind", "actor_id", "reason", "unit_idx"), "detected")
    truth = scenarios.select("scenario_id", F.posexplode(in_set_order("truth")).alias("place", "pos"))
    scored = boundary_f1(scenarios, detected_positions(detected), truth).select("scenario_id", "boundary_f1")
    report = reports(chains(scenarios, unit_actor_counts(detected)))
    return report.join(scenarios.select("scenario_id", "seed", "truth", "position"), "scenario_id").join(scored, "scenario_id")


def _drawn(bits: np.random.MT19937, n: int, want: int) -> Iterator[np.ndarray]:
    """``want`` numbers below ``n``, in pieces, as Python's ``randrange`` draws them: the top bits of a 32-bit word,
    thrown away where they reach ``n``. Never a word more than that takes, so the generator stands where Python's would."""
    shift = np.uint64(32 - n.bit_length())
    while want:
        words = bits.random_raw(min(want, 1 << 20)) >> shift
        words = words[words < n]
        want -= len(words)
        yield words.astype(np.int64)


def _generator(state: bytes) -> np.random.MT19937:
    words = np.frombuffer(state, np.uint32)
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": words[:-1], "pos": int(words[-1])}}
    return bits


def _state(bits: np.random.MT19937) -> bytes:
    at = bits.state["state"]
    return np.append(at["key"], at["pos"]).astype(np.uint32).tobytes()


def bootstrap_ci(values: DataFrame, group: list[str], value: str, order: str, rounds: int = 1000, alpha: float = 0.05, seed: int = 42, rounds_at_once: int = 25, chunk: int = 1 << 17) -> DataFrame:
    """(group, ci_low, ci_high): the percentile bootstrap interval of a mean by group, with the draws of Python's
    ``random.Random(seed)``, which the recorded results used.

    The draws depend on a group's size alone. For each size that occurs one walk over the generator saves its
    state before every ``rounds_at_once`` rounds (2.5 KB each). A group's values are numbered in ``order`` by
    ranges and cut into chunks of at most ``chunk``; a row is a chunk and a block of rounds, which starts from its saved state and
    sums up, for each round, the picks that fall into its chunk. The sums are added over chunks, and the
    interval's ends are picked from the ``rounds`` means of a group. No list holds a group's values.

    Null values count as missing and are left out; a group without values has no row; ``value`` is cast to
    double. Rows that tie in ``order`` are ordered by value. Null keys are a group.
    """
    keys = [f"_k{i}" for i in range(len(group))]
    named = values.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    placed = written(numbered(written(named, "values"), keys, ["_o", "_v"], "_i", "_n"), "placed")

    def saved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in batch["_n"].tolist():
                internal = random.Random(seed).getstate()[1]
                bits = _generator(np.array(internal, np.uint32).tobytes())
                for block in range(-(-rounds // rounds_at_once)):
                    yield pd.DataFrame({"_n": [n], "_block": [block], "_state": [_state(bits)]})
                    for _ in _drawn(bits, n, n * rounds_at_once):
                        pass

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def picked(sizes: pd.Series, blocks: pd.Series, states: pd.Series, firsts: pd.Series, chunks: pd.Series) -> pd.Series:
        out = []
        for n, block, state, first, part in zip(sizes, blocks, states, firsts, chunks, strict=True):
            bits, exact = _generator(state), np.asarray(part, np.longdouble)
            sums = []
            for _ in range(min(rounds_at_once, rounds - block * rounds_at_once)):
                total = np.longdouble(0)
                for picks in _drawn(bits, n, n):
                    here = picks - first
                    total += exact[here[(here >= 0) & (here < len(exact))]].sum()
                sums.append(float(total))
            out.append(sums)
        return pd.Series(out)

    sizes = placed.select("_n").distinct().repartition("_n")
    states = written(sizes.mapInPandas(saved, "_n bigint, _block int, _state binary"), "states")
    chunks = placed.groupBy(*keys, "_n", F.floor(F.col("_i") / chunk).alias("_chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_part"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // rounds_at_once) - 1))).alias("_block")
    work = chunks.select("*", blocks).join(states, ["_n", "_block"])
    sums = work.select(*keys, "_n", "_chunk", "_block", F.posexplode(picked("_n", "_block", "_state", F.col("_chunk") * chunk, "_part")).alias("_r", "_sum"))
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("_chunk", "_sum"))), F.lit(0.0), lambda a, x: a + x["_sum"])  # a sum a chunk, always in one order
    means = sums.groupBy(*keys, "_n", "_block", "_r").agg((added / F.col("_n")).alias("_mean"))
    ends = [F.get(F.col("_means"), F.lit(int(rounds * a))).alias(name) for a, name in ((alpha / 2, "ci_low"), (1 - alpha / 2, "ci_high"))]
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list("_mean")).alias("_means")).select(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], *ends)


def cells(evaluated: DataFrame, intervals: bool = True) -> DataFrame:
    """Mean completeness with its interval (unless ``intervals`` is false: null), mean F1 and the modal failure mode of
    each architecture and tier; of equally frequent modes the one seen first. Means are of sums of decimals, the same in any order."""
    group = ["architecture", "stack_tier"]
    evaluated = written(evaluated.select(*group, "position", "completeness", "boundary_f1", "per_property"), "evaluated")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,18)")).cast("double")
    means = evaluated.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"), exact("completeness").alias("total"), exact("boundary_f1").alias("f1"))
    modes = evaluated.select(*group, "position", F.explode("per_property").alias("p")).where("p.mode is not null").groupBy(*group, F.col("p.mode").alias("mode"))
    modes = modes.agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("position", "p.ord")).alias("seen"))
    modal = modes.groupBy(*group).agg(F.max_by("mode", F.struct("k", -F.col("seen.position"), -F.col("seen.ord"))).alias("modal_mode"), (F.max("k") / F.sum("k")).alias("share"))
    out = means.join(modal, group, "left")
    if intervals:
        out = out.join(bootstrap_ci(evaluated, group, "completeness", "position"), group)
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("ci_low", "ci_high")})
    pct = lambda c: F.bround(c * 100, 1)
    return out.select(
        *group, F.col("n").cast("int").alias("n"), pct(F.col("total") / F.col("n")).alias("completeness_pct"), pct(F.col("ci_low")).alias("completeness_ci_low"), pct(F.col("ci_high")).alias("completeness_ci_high"),
        F.bround(F.col("f1") / F.col("n"), 3).alias("boundary_f1"), "modal_mode", F.bround(F.coalesce("share", F.lit(0.0)), 3).alias("modal_mode_share"), mode_break(F.col("modal_mode")).alias("dominant_break"), "position",
    )


def per_property(evaluated: DataFrame) -> DataFrame:
    """The share of each category for each property, in per cent."""
    rows = evaluated.select(F.explode("per_property").alias("p")).select("p.*")
    share = [F.bround(F.count_if(F.col("category") == c) / F.count(F.lit(1)) * 100, 1).alias(c) for c in CATEGORIES]
    return rows.groupBy("ord", "property").agg(*share)


__all__ = ["PROPERTIES", "bootstrap_ci", "boundary_f1", "cells", "evaluate", "matched", "matrix", "per_property", "seeds"]
