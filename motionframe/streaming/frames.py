"""Frames as an unbounded table: a source, velocities that continue across batches, and a sink that resumes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME_SCHEMA = "run long, idx long, t_ms double, v double"


def frame_source(spark: SparkSession, folder: str, schema: str = FRAME_SCHEMA, files_a_batch: int = 8) -> DataFrame:
    """The frames in the Parquet files of ``folder``, those that come later too."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def running_velocity(frames: DataFrame) -> DataFrame:
    """run, idx, velocity of every frame, as a batch job has it; a run's last frame and time are its state.

    Frames of a run have to arrive in order from batch to batch; within a batch they are sorted.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, v = state.get if state.exists else (None, None)
        rows = pd.concat(parts).sort_values("idx")
        before_t, before_v = rows["t_ms"].shift(), rows["v"].shift()
        if t is not None:
            before_t.iloc[0], before_v.iloc[0] = t, v
        seconds = (rows["t_ms"] - before_t) / 1000
        velocity = ((rows["v"] - before_v) / seconds).where(seconds > 0, 0.0)
        state.update((float(rows["t_ms"].iloc[-1]), float(rows["v"].iloc[-1])))
        yield pd.DataFrame({"run": key[0], "idx": rows["idx"], "velocity": velocity.astype(float)})

    return frames.groupBy("run").applyInPandasWithState(run, "run long, idx long, velocity double", "t_ms double, v double", "append", GroupStateTimeout.NoTimeout)


def append_available(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there to ``folder`` and stop; the next call goes on after what ``checkpoint`` records."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
