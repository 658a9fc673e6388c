"""Streaming forms against their batch forms."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_CHECK

QUERIES = E.queries()


def test_stream_wait_agrees_with_batch(spark):
    """The stream emits every request exactly once, timed out exactly when the batch as-of lookup
    finds no notification in time."""
    stream = QUERIES["stream_match_notifications"](spark, SF_CHECK)
    batch = QUERIES["match_notifications"](spark, SF_CHECK)
    s = [(r["request_event_id"], r["timed_out"]) for r in stream.collect()]
    b = {r["request_event_id"]: r["timed_out"] for r in batch.collect()}
    assert len(s) == len(dict(s)) == len(b)
    assert dict(s) == b


def test_stream_classify_equals_batch(spark):
    a = QUERIES["stream_classify"](spark, SF_CHECK)
    b = QUERIES["classify_message"](spark, SF_CHECK)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_stream_carry_equals_batch(spark):
    a = QUERIES["stream_carry_provider"](spark, SF_CHECK)
    b = QUERIES["carry_provider"](spark, SF_CHECK)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert a.where(F.col("current_provider").isNull()).count() < a.count()


def test_stream_carry_keeps_state_across_triggers(spark, tmp_dir):
    """The provider found in the first trigger is carried into rows of the second one."""
    from tickwise.operators.windows import carry_forward
    from tickwise.streaming.carry import stream_carry_provider
    from tickwise.streaming.sources import run_available_now
    schema = "event_id long, user_id long, ts timestamp_ntz, provider string"
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    first = [(1, 1, t0, "Filings"), (2, 1, t0 + dt.timedelta(minutes=1), None), (3, 2, t0, None)]
    second = [(4, 1, t0 + dt.timedelta(hours=1), None), (5, 2, t0 + dt.timedelta(hours=1), "Market"),
              (6, 2, t0 + dt.timedelta(hours=2), None), (7, 1, t0 + dt.timedelta(hours=3), "Portfolio")]
    spark.createDataFrame(first, schema).write.parquet(f"{tmp_dir}/in/0001")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_dir}/in/*")
        run_available_now(stream_carry_provider(stream, "user_id", ["ts", "event_id"]),
                          f"{tmp_dir}/out", f"{tmp_dir}/ckpt")

    run()
    spark.createDataFrame(second, schema).write.parquet(f"{tmp_dir}/in/0002")
    run()
    got = {r["event_id"]: r["current_provider"] for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    everything = spark.createDataFrame(first + second, schema)
    want = {r["event_id"]: r["c"] for r in
            carry_forward(everything, "user_id", ["ts", "event_id"], "provider", F.to_date("ts"), "c").collect()}
    assert got == want and got[4] == "Filings" and got[6] == "Market"


def test_streams_read_tables_stored_as_directories(spark, tmp_dir):
    from tickwise.streaming.sources import run_available_now, stream_table
    table = spark.range(100).repartition(5)
    table.write.parquet(f"{tmp_dir}/t.parquet")
    run_available_now(stream_table(spark, tmp_dir, "t.parquet", 2), f"{tmp_dir}/dir_out", f"{tmp_dir}/dir_ckpt")
    assert spark.read.parquet(f"{tmp_dir}/dir_out").count() == 100


def test_late_rows_do_not_displace_a_newer_provider(spark, tmp_dir):
    import datetime as dt

    from tickwise.streaming.carry import stream_carry_provider
    from tickwise.streaming.sources import run_available_now
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, user_id long, ts timestamp_ntz, provider string"
    at = lambda m: t0 + dt.timedelta(minutes=m)
    spark.createDataFrame([(1, 1, at(20), "B")], schema).write.parquet(f"{tmp_dir}/late/0001")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_dir}/late/*")
        run_available_now(stream_carry_provider(stream, "user_id", ["ts", "event_id"]), f"{tmp_dir}/lo", f"{tmp_dir}/lc")

    run()
    spark.createDataFrame([(2, 1, at(10), "A"), (3, 1, at(50), None)], schema).write.parquet(f"{tmp_dir}/late/0002")
    run()
    got = {r["event_id"]: r["current_provider"] for r in spark.read.parquet(f"{tmp_dir}/lo").collect()}
    assert got == {1: "B", 2: "A", 3: "B"}
