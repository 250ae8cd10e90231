from pyspark.sql import functions as F

from motionframe.operators import sequence
from motionframe.streaming import frames, sessions


def test_velocity_continues_across_batches_and_restarts(spark, tmp_path):
    rows = [(r, i, 100.0 * i, float((i * 7 + r) % 5)) for r in (1, 2) for i in range(12)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for first, stop in ((0, 5), (5, 9), (9, 12)):
        part = [x for x in rows if first <= x[1] < stop]
        spark.createDataFrame(part, frames.FRAME_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        frames.append_available(frames.running_velocity(frames.frame_source(spark, folder)), out, checkpoint).awaitTermination()
    want = sequence.velocity(spark.createDataFrame(rows, frames.FRAME_SCHEMA)).select("run", "idx", F.round("velocity", 9).alias("velocity"))
    got = spark.read.parquet(out).select("run", "idx", F.round("velocity", 9).alias("velocity"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_closed_sessions_of_a_stream(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "user_id long, ts timestamp, value double"
    events = lambda *t: spark.createDataFrame([(1, s, 9.0) for s in t], "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (events("2024-01-01 00:00:00", "2024-01-01 01:00:00"), events("2024-01-03 00:00:00"), events("2024-01-09 00:00:00")):
        part.coalesce(1).write.mode("append").parquet(folder)
        frames.append_available(sessions.active_sessions(frames.frame_source(spark, folder, schema), 5.0), out, checkpoint).awaitTermination()
    # the last one is open until the watermark passes it
    assert sorted((r.n, str(r.start)) for r in spark.read.parquet(out).collect()) == [(1, "2024-01-03 00:00:00"), (2, "2024-01-01 00:00:00")]
