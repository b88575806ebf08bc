"""The queries that run adapters and statistics, against their SQL."""

import random

import duckdb
import pytest

from trailforge.plans import adapter_queries, vendor_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = adapter_queries.QUERIES | vendor_queries.QUERIES, adapter_queries.ORACLES | vendor_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_intervals_of_the_cells(spark):
    """Each cell's interval against the generator's draws in a plain loop."""
    values = {}
    for r in adapter_queries._cell_rows(spark, SF).orderBy("position").collect():
        values.setdefault((r.architecture, r.stack_tier), []).append(r.completeness)
    got = {(r.architecture, r.stack_tier): (r.ci_low, r.ci_high) for r in adapter_queries.completeness_intervals(spark, SF).collect()}
    assert set(got) == set(values)
    for cell, v in values.items():
        draw, n = random.Random(42), len(v)
        means = sorted(sum(v[draw.randint(0, n - 1)] for _ in range(n)) / n for _ in range(1000))
        assert got[cell] == pytest.approx((means[25], means[975]), abs=1e-12)


@pytest.mark.parametrize("name", ["pydantic_ai_fragments", "anthropic_fragments", "otlp_fragments", "mcp_fragments", "crewai_fragments", "agentframework_fragments"])
def test_payloads_that_nobody_reads_are_not_made(spark, name):
    """A fragment's columns are chosen one by one, so a query without payloads works none out."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "internal_reasoning" not in plan and "state_change_magnitude" not in plan
