"""Plans at scale: what is exchanged, what is read, what stays in the JVM."""

from pyspark.sql import functions as F

from trailforge.operators import boundary, classify, ordering
from trailforge.plans import queries, traces

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fragments_are_exchanged_once(spark):
    fragments = traces.events_as_fragments(spark, SF)
    counts = classify.unit_actor_counts(boundary.detect(ordering.order_fragments(fragments, parents=False)))
    chain = classify.chains(traces.events_as_scenarios(spark, SF), counts)
    text = plan_of(chain)
    # one for the fragments; the scenarios are a distinct and come to the units and to the chains
    assert text.count("Exchange hashpartitioning") <= 5
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_scans_read_what_is_used(spark):
    text = plan_of(queries.rate_limited(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    text = plan_of(queries.fifo_pairing(spark, SF))
    assert "PushedFilters: [In(event_type" in text and "value" not in text.split("ReadSchema")[1].split(">")[0]


def test_python_is_left_out_where_sql_has_words(spark):
    for name in ("order_fragments", "boundary_flags", "units", "reconstruct", "fifo_pairing", "follow_ups", "last_known_actor", "epoch_coercion"):
        text = plan_of(queries.QUERIES[name](spark, SF))
        assert "Python" not in text and "Arrow" not in text, name


def bytes_moved(spark, run):
    """Bytes that the stages of ``run`` shuffled, spilled and wrote."""
    jsc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0)

    def stages():
        jsc.listenerBus().waitUntilEmpty()
        return list(gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(jsc.statusStore().stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())))

    before = max((x.stageId() for x in stages()), default=-1)
    run()
    return sum(x.shuffleWriteBytes() + x.memoryBytesSpilled() + x.diskBytesSpilled() + x.outputBytes() for x in stages() if x.stageId() > before)


def test_causal_order_moves_bytes_in_proportion(spark, tmp_path):
    """Users with ten times the events, in longer chains and cycles: the bytes an event do not grow with the rounds or the paths."""
    events, per_event = spark.read.parquet(f"{SF}/events.parquet"), []
    for copies in (4, 40):
        copied = events.crossJoin(spark.range(copies).withColumnRenamed("id", "r")).withColumn("event_id", F.col("event_id") + F.col("r") * 1_000_000).drop("r")
        copied.coalesce(1).write.parquet(f"{tmp_path}/{copies}/events.parquet")
        moved = bytes_moved(spark, lambda: queries.causal_order(spark, f"{tmp_path}/{copies}").write.format("noop").mode("overwrite").save())  # noqa: B023
        per_event.append(moved / copied.count())
    assert 0 < per_event[1] < 160 and per_event[1] < per_event[0], per_event
