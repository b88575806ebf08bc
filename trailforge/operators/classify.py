"""Which of the seven decision properties are evidenced, by unit and by chain, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.operators.boundary import BoundaryConfig, detect
from trailforge.operators.ordering import order_fragments
from trailforge.schema import BREAKS, CATEGORIES, FILLERS, PROPERTIES

FULL, PARTIAL, MISSING, OPAQUE = CATEGORIES
_RANK = {MISSING: 1, PARTIAL: 2, OPAQUE: 3, FULL: 4}


def _finding(category: str, confidence: float, gap: Column | None = None) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(float(confidence)).alias("confidence"), (F.lit(None).cast("string") if gap is None else gap).alias("gap"))


def _by_value(col: Column, pairs: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for key, value in pairs.items():
        out = F.when(col == key, value).otherwise(out)
    return out


def _with_scenarios(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    return rows.join(scenarios.select("scenario_id", "architecture", F.col("stack_tier").alias("tier")), "scenario_id")


def unit_actor_counts(detected: DataFrame) -> DataFrame:
    """For each unit and actor, how many fragments could fill each property, and how many there are.

    Everything below starts from these partial sums."""
    fills = [F.count_if(F.col("kind").isin(*kinds)).alias(f"m{i}") for i, kinds in enumerate(FILLERS.values())]
    return detected.groupBy("scenario_id", "unit_idx", "actor_id").agg(*fills, F.count(F.lit(1)).alias("n"))


def _unit_finding(prop: str, m: Column) -> Column:
    """What a unit says about a property of which it has ``m`` fillers. Rules apply in order, the
    first that holds decides; columns actors, architecture and tier are the unit's."""
    actors, multi, crossing = F.col("actors"), F.col("architecture") == "multi_agent", F.col("tier") == "cross_stack"
    count, rules = actors.cast("string"), []
    if prop == "reasoning_trace":
        rules.append((m > 0, _finding(OPAQUE, 0.9)))
    if prop in ("inputs", "post_condition_state"):
        rules.append((crossing & (m == 0), _finding(MISSING, 0, F.lit(f"cross-stack boundary discards {prop}"))))
        rules.append((crossing, _finding(PARTIAL, 0.5, F.lit("cross-stack evidence partial"))))
    if prop == "operator_identity":
        rules.append((multi & (actors > 2), _finding(PARTIAL, 0.5, F.concat(count, F.lit(" actors -- single operator identity ambiguous")))))
    if prop == "output_action":
        rules.append((multi & (actors >= 2) & (m > 0), _finding(PARTIAL, 0.6, F.concat(F.lit("output action delegated across "), count, F.lit(" agents")))))
    if prop == "policy_basis":
        rules.append((multi & (m == 0), _finding(MISSING, 0, F.lit("policy invoked implicitly across agents (mode 6)"))))
    rules.append((m == 0, _finding(MISSING, 0, F.lit(f"no {prop} fragment in unit"))))
    out = _finding(FULL, 1.0)
    for condition, finding in reversed(rules):
        out = F.when(condition, finding).otherwise(out)
    return out


def _units(counts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row a unit: sums by property, its actors, those that no earlier unit had, and for each
    property the finding f0 to f6. Every key starts with scenario_id: no exchange of its own."""
    earlier = Window.partitionBy("scenario_id", "actor_id").orderBy("unit_idx")
    marked = counts.withColumn("new", F.when(F.row_number().over(earlier) == 1, 1).otherwise(0))
    sums = [F.sum(f"m{i}").alias(f"m{i}") for i in range(len(PROPERTIES))]
    unit = marked.groupBy("scenario_id", "unit_idx").agg(*sums, F.count(F.lit(1)).alias("actors"), F.sum("new").alias("new_actors"), F.sum("n").alias("n"))
    return _with_scenarios(unit, scenarios).withColumns({f"f{i}": _unit_finding(p, F.col(f"m{i}")) for i, p in enumerate(PROPERTIES)})


def unit_feasibility(counts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario_id, unit_idx, ord, property, matches, actors, category, confidence, gap): seven rows
    for each unit."""
    seven = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("property"), F.col(f"m{i}").alias("matches"), F.col(f"f{i}").alias("f")) for i, p in enumerate(PROPERTIES)]))
    rows = _units(counts, scenarios).select("scenario_id", "unit_idx", "actors", seven.alias("p"))
    return rows.select("scenario_id", "unit_idx", "p.ord", "p.property", "p.matches", "actors", "p.f.category", "p.f.confidence", "p.f.gap")


def _chain_finding(prop: str, best: Column) -> Column:
    """What the whole chain says: its best unit's finding, adjusted by the architecture."""
    arch, actors = F.col("architecture"), F.col("actors")
    multi, count = arch == "multi_agent", actors.cast("string")
    out = best
    if prop == "output_action":
        out = F.when(multi & (actors >= 3), _finding(MISSING, 0, F.concat(F.lit("decision diffused across "), count, F.lit(" agents -- no single authoritative output (mode 1/5)")))).otherwise(out)
    if prop == "policy_basis":
        sparse = F.col("policy_units") < F.greatest(F.lit(1), F.expr("units_detected div 3"))
        out = F.when(multi & sparse, _finding(MISSING, 0, F.lit("policy invoked implicitly across agents (mode 6)"))).otherwise(out)
    if prop == "operator_identity":
        shared = (arch == "human_in_the_loop") & best["category"].isin(FULL, PARTIAL)
        out = F.when(shared, _finding(PARTIAL, 0.6, F.lit("shared authorship agent + operator (mode 7)"))).otherwise(out)
        out = F.when(multi & (actors >= 3), _finding(PARTIAL, 0.5, F.concat(count, F.lit(" distinct actors across chain -- no single operator identity (delegation, mode 5)")))).otherwise(out)
    return F.when(best.isNull(), _finding(MISSING, 0)).otherwise(out)


def failure_mode(prop: str, category: Column) -> Column:
    """The failure mode (1 to 7) behind a missing property; null for any other category."""
    multi = {"policy_basis": 6, "inputs": 5, "output_action": 5}.get(prop, 1)
    mode = F.when(F.col("tier") == "cross_stack", 3).when(F.col("architecture") == "multi_agent", multi).when(F.col("architecture") == "human_in_the_loop", 7).otherwise(2 if prop == "reasoning_trace" else 4)
    return F.when(category == MISSING, mode)


def mode_break(mode: Column) -> Column:
    return _by_value(mode, {k: F.lit(v) for k, v in BREAKS.items()}, "string")


def chains(scenarios: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each scenario, those without fragments included: counts of fragments, units and
    actors, and ``per_property``, seven structs (ord, property, category, confidence, gap, weight, mode, and
    unit_idx and matches of the unit that the finding comes from).

    A property is as good as in its best unit (category, then confidence, then the earlier unit).
    The seven are columns of one aggregation, so no row is multiplied and nothing is regrouped."""
    unit = _units(counts, scenarios)
    rank = lambda f: _by_value(f["category"], {k: F.lit(v) for k, v in _RANK.items()}, "int")
    own = lambda i: F.struct(F.col(f"f{i}").alias("f"), "unit_idx", F.col(f"m{i}").alias("matches"))
    best = [F.max_by(own(i), F.struct(rank(F.col(f"f{i}")), F.col(f"f{i}.confidence"), -F.col("unit_idx"))).alias(f"b{i}") for i in range(len(PROPERTIES))]
    policy = F.col(f"m{PROPERTIES.index('policy_basis')}") > 0
    chain = unit.groupBy("scenario_id").agg(*best, F.sum("new_actors").alias("actors"), F.count_if(policy).alias("policy_units"), F.count(F.lit(1)).cast("int").alias("units_detected"), F.sum("n").cast("int").alias("fragments"))
    rows = scenarios.select("scenario_id", "architecture", F.col("stack_tier").alias("tier")).join(chain, "scenario_id", "left")
    rows = rows.withColumns({f"c{i}": _chain_finding(p, F.col(f"b{i}.f")) for i, p in enumerate(PROPERTIES)})

    def one(i: int, p: str) -> Column:
        f = F.col(f"c{i}")
        weight = F.when(f["category"].isin(FULL, OPAQUE), 1.0).when(f["category"] == PARTIAL, f["confidence"]).otherwise(0.0)
        return F.struct(F.lit(i).alias("ord"), F.lit(p).alias("property"), f["category"].alias("category"), f["confidence"].alias("confidence"), f["gap"].alias("gap"), weight.alias("weight"), failure_mode(p, f["category"]).alias("mode"), F.col(f"b{i}.unit_idx").alias("unit_idx"), F.col(f"b{i}.matches").alias("matches"))

    per = F.array(*[one(i, p) for i, p in enumerate(PROPERTIES)])
    none = {c: F.coalesce(c, F.lit(0)) for c in ("fragments", "units_detected", "actors")}
    return rows.withColumns(none).select("scenario_id", "architecture", "tier", *none, per.alias("per_property"))


def chain_feasibility(chain_rows: DataFrame) -> DataFrame:
    """(scenario_id, architecture, tier, ord, property, category, confidence, gap, weight, mode, unit_idx, matches):
    seven rows for each scenario."""
    return chain_rows.select("scenario_id", "architecture", "tier", F.explode("per_property").alias("p")).select("scenario_id", "architecture", "tier", "p.*")


def reports(chain_rows: DataFrame) -> DataFrame:
    """One row for each scenario: completeness (the mean weight, added up in the properties'
    order), counts by category, modes, and the most frequent mode (of equals the first in the
    properties' order) with its break."""
    modes = F.filter(F.transform("per_property", lambda p: p["mode"]), lambda m: m.isNotNull())
    rows = chain_rows.withColumn("modes", modes)
    ranked = F.transform("modes", lambda m, i: F.struct(F.size(F.filter("modes", lambda x: x == m)).alias("n"), (-i).alias("first"), m.alias("mode")))
    total = F.aggregate("per_property", F.lit(0.0), lambda acc, p: acc + p["weight"])

    def having(category: str) -> Column:
        return F.size(F.filter("per_property", lambda p: p["category"] == category))

    per = {c: having(c) for c in CATEGORIES}
    rows = rows.withColumns(per | {"completeness": total / len(PROPERTIES), "dominant_mode": F.array_max(ranked)["mode"], "unrecoverable_mode_count": F.size("modes").cast("long")})
    return rows.drop("modes").withColumnRenamed("tier", "stack_tier").withColumn("dominant_break", mode_break(F.col("dominant_mode")))


def reconstruct(scenarios: DataFrame, fragments: DataFrame, config: BoundaryConfig = BoundaryConfig(), parents: bool = True) -> DataFrame:
    """All scenarios' reports at once, with counts of fragments and units.

    One exchange of the fragments by scenario_id carries the ordering, the boundaries and every sum;
    the scenarios are brought to the same partitioning once for the units and once for the chains."""
    return reports(chains(scenarios, unit_actor_counts(detect(order_fragments(fragments, parents), config))))


def feasibility_json(report_rows: DataFrame) -> DataFrame:
    """(scenario_id, report): the feasibility document of each scenario, as JSON text."""
    listed = F.transform("per_property", lambda p: F.struct(p["property"].alias("property"), p["category"].alias("category"), p["gap"].alias("gap")))
    body = F.struct(
        "scenario_id", "architecture", "stack_tier", "fragments", "units_detected",
        F.bround(F.col("completeness") * 100, 1).alias("completeness_pct"), "dominant_mode", "dominant_break",
        F.struct(*CATEGORIES).alias("feasibility_counts"), listed.alias("per_property"),
    )
    return report_rows.select("scenario_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))
