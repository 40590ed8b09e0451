"""Streams against the batch results of the same rows."""

from pyspark.sql import functions as F

from riskloom.operators import state as st
from riskloom.sources.tables import events, table
from riskloom.streaming import history as hs

SF = "/root/testdata/sf0.001"


def test_history_in_complete_mode_equals_batch(spark, tmp_path):
    schema = table(spark, SF, "events").schema
    stream = hs.history_stream(hs.event_stream(spark, f"{SF}/events.parquet*", schema), "user_id")
    got = hs.run_to_memory(stream, spark, f"file://{tmp_path}", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.history(events(spark, SF), "user_id").collect()))


def test_windows_in_complete_mode_equal_batch(spark, tmp_path):
    schema = table(spark, SF, "events").schema
    stream = hs.windowed_counts(hs.event_stream(spark, f"{SF}/events.parquet*", schema), "event_type")
    got = hs.run_to_memory(stream, spark, f"file://{tmp_path}", "complete").collect()
    want = events(spark, SF).groupBy(F.window("ts", "1 hour").start.alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
