"""The streams against the batch operators on the same rows."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.operators import boundary, ordering, pairing
from trailforge.schema import FRAGMENT
from trailforge.streaming import pairs, sessions


def stream(spark, tmp_path, table, parts):
    """A stream of files, one part a batch; a last row far in the future lets the watermark pass all others."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(parts):
        table.sparkSession.createDataFrame(rows, table.schema).coalesce(1).write.parquet(f"{tmp_path}/p{k}")
        for f in (tmp_path / f"p{k}").glob("*.parquet"):
            f.rename(folder / f"{k:03d}-{f.name}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ran(query_of, name):
    query = query_of.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return query_of.sparkSession.table(name)


@pytest.fixture
def one_partition(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_boundaries(spark, tmp_path, one_partition):
    rng = np.random.default_rng(0)
    kinds = ["tool_call", "agent_message", "state_mutation", "human_approval", "error"]
    rows = [(f"s{i % 3}", i, f"f{i:03d}", 1000.0 + i + float(rng.integers(-30, 30)), kinds[int(rng.integers(5))], "within_stack", "a", "{}", None, None, float(rng.random()), False) for i in range(90)]
    last = ("end", 0, "end", 10_000.0, "error", "within_stack", "a", "{}", None, None, 0.0, False)
    table = spark.createDataFrame(rows, FRAGMENT)
    source = stream(spark, tmp_path, table, [rows[:30], rows[30:60], rows[60:], [last], [last]])
    got = ran(sessions.boundaries(source, "2 minutes"), "found_boundaries").where("scenario_id <> 'end'")
    want = boundary.detect(ordering.order_fragments(table, parents=False))
    columns = ["scenario_id", "fragment_id", "reason", "rn", "unit_idx"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)


def test_pairing(spark, tmp_path, one_partition):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), f"{i:03d}", 1000.0 + i, bool(rng.random() < 0.5)) for i in range(60)]
    table = spark.createDataFrame(rows, "k int, id string, timestamp double, opens boolean")
    end = (9, "end", 10_000.0, True)
    source = stream(spark, tmp_path, table, [rows[30:], rows[:30], [end], [end]])
    got = {tuple(r) for r in ran(sessions.fifo(source, "k", "id", "opens", "5 minutes"), "found_pairs").collect()}
    batch = pairing.fifo(table.withColumn("k", table.k.cast("string")), ["k"], ["timestamp", "id"], "id", "opens").where("close_id is not null")
    assert got == {tuple(r) for r in batch.collect()}


@pytest.fixture
def rocks(spark, one_partition):
    """The state store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, was)


def plain_pairs(rows, expiry):
    """One queue a key, over all rows in order."""
    out, queues = [], {}
    for k, name, at, opens in sorted(rows, key=lambda r: (r[2], r[1])):
        queue = queues.setdefault(k, [])
        while queue and queue[0][0] + expiry <= at:
            out.append((k, queue.pop(0)[1], None))
        if opens:
            queue.append((at, name))
        else:
            out.append((k, queue.pop(0)[1] if queue else None, name))
    return out + [(k, name, None) for k, queue in queues.items() for _, name in queue]


def test_pairs_expire(spark, tmp_path, rocks):
    """Unordered batches, open rows that nobody closes, closes that find none, a null key, a null time; one row comes too late."""
    rng = np.random.default_rng(7)
    rows = [(str(rng.integers(3)), f"{i:03d}", 1000.0 + float(rng.integers(0, 400)), bool(rng.random() < 0.6)) for i in range(120)]
    rows += [(None, "n1", 1100.0, True), (None, "n2", 1101.5, None)]
    lost, late, end = ("0", "x", None, True), ("0", "late", 1001.0, False), ("end", "end", 50_000.0, True)
    table = spark.createDataFrame(rows, "k string, id string, timestamp double, opens boolean")
    source = stream(spark, tmp_path, table, [rows[60:], [*rows[:60], lost], [end], [("end", "end2", 50_001.0, True)], [("end", "end3", 50_002.0, True), late]])
    counter = pairs.LateRows()
    spark.streams.addListener(counter)
    query = pairs.pairs(source, "k", "id", "opens", "10 minutes", expiry=40.0)
    running = query.writeStream.format("memory").queryName("found_expiring").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination(180)
    assert running.exception() is None
    got = [tuple(r) for r in spark.table("found_expiring").where("key is null or key <> 'end'").collect()]
    assert sorted(got, key=str) == sorted(plain_pairs([(k, i, t, bool(o)) for k, i, t, o in rows], 40.0), key=str)
    assert any(c is None for _, _, c in got) and any(o is None for _, o, _ in got)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    deadline = time.time() + 20
    while counter.dropped.get("found_expiring") != 1 and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(counter)
    assert counter.dropped["found_expiring"] == 1
    kept = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state").count()
    assert kept("queue") == 0  # open rows have left; those of "end" wait in their slots
    assert kept("waiting") == 3


def test_absorption(spark, tmp_path, one_partition):
    """The last value of a parent's follow-ups; parents without any; follow-ups too late or of nobody."""
    rng = np.random.default_rng(3)
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC)
    parents = [(f"p{i:02d}", f"k{i % 7}" if i else None, at(200.0 * (i // 7))) for i in range(35)]
    follows = [(f"k{int(rng.integers(9))}", at(float(rng.integers(0, 1200))), f"v{i}") for i in range(90)]
    one = spark.createDataFrame(parents, "id string, k string, at timestamp")
    two = spark.createDataFrame(follows, "k string, then timestamp, v string")
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    far = at(90_000.0)
    left = stream(spark, tmp_path / "one", one, [parents[:20], parents[20:], [("end", "e", far)], [("end", "e", far)]])
    right = stream(spark, tmp_path / "two", two, [follows[:50], follows[50:], [("e", far, "x")], [("e", far, "x")]])
    got = ran(pairs.absorb(left, "id", "k", "at", right, "k", "then", F.col("v"), "100 seconds", "30 minutes"), "found_absorbed")
    want = {}
    for i, k, t in parents:
        mine = [(then, v) for key, then, v in follows if key == k and t <= then <= t + datetime.timedelta(seconds=100)]
        want[i] = max(mine)[1] if mine else None
    found = {r.id: r.absorbed for r in got.where("id <> 'end'").collect()}
    assert found == want and None in want.values()
    assert got.where("id <> 'end'").count() == len(parents)
