from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quillspark.streaming import telemetry

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, key string, ts timestamp, value double"


def event(i, key, seconds, value=1.0):
    return i, key, START + timedelta(seconds=seconds), value


def test_sliding_log_forgets_rejected_calls(spark):
    rows = [event(i, "a", s) for i, s in enumerate((0, 1, 2, 60, 61, 61.5))] + [event(9, "b", 5)]
    got = {r.event_id: r.admitted for r in telemetry.sliding_exact(spark.createDataFrame(rows, SCHEMA), 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 9: True}
    assert telemetry.admit([0.0, 1.0], [2.0, 60.0], 2, 60) == ([1.0, 60.0], [False, True])


def test_slo_percentiles(spark):
    rows = [event(i, "a", i, float(i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = telemetry.slo(df, last=4, failed=F.col("value") > 9).first()
    assert tuple(got) == (4, 10.0, 10.0, 0.25)


def run(spark, tmp_path, batches, build, name):
    """Feed batches of events through a stream, one file a batch, and return the sink's rows."""
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"b={n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_of_tumbling_windows(spark, tmp_path):
    batches = [[event(1, "a", 1), event(2, "a", 2), event(3, "a", 3)], [event(4, "a", 65)], [event(5, "a", 400)], [event(6, "a", 800)]]
    rows = run(spark, tmp_path, batches, lambda s: telemetry.stream_tumbling(s, 2), "tumbling")
    assert {(r.calls, r.rejected) for r in rows if r.calls == 3} == {(3, 1)} and len(rows) >= 2


def test_stream_of_sliding_logs(spark, tmp_path):
    rows = run(spark, tmp_path, [[event(i, "a", i) for i in range(4)] + [event(9, "b", 1)]], lambda s: telemetry.stream_sliding(s, 2), "sliding")
    assert sorted((r.key, r.admitted, r.rejected) for r in rows) == [("a", 2, 2), ("b", 1, 0)]
