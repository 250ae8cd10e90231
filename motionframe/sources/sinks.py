"""What a run leaves behind: append-only tables of runs, detections and audit entries, with views of the latest state.

Nothing is updated in place: a status is a new row, and the view takes each key's last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_STATES = ("pending", "processing", "completed", "failed")
DETECTION_COLUMNS = ["run", "detection_id", "trick_id", "confidence", "start_ms", "end_ms", "is_top3"]


def append(rows: DataFrame, folder: str, partition: str | None = None) -> None:
    """Add rows to the table in ``folder``; a task that is run again adds none twice, as files are committed with the job."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)


def latest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of every key by ``at``."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return log.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def with_top_flag(detections: DataFrame, top: DataFrame) -> DataFrame:
    """Adds is_top3: whether the detection's trick, not the detection itself, is among the run's best."""
    best = top.select("run", "trick_id").distinct().withColumn("is_top3", F.lit(True))
    return detections.join(best, ["run", "trick_id"], "left").withColumn("is_top3", F.coalesce("is_top3", F.lit(False)))


def clock(ms: Column) -> Column:
    """Milliseconds as mm:ss."""
    seconds = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def audit_entries(detections: DataFrame, totals: DataFrame) -> DataFrame:
    """run, nth, kind, message: an entry for every detection in the order of time, then one for the run's score."""
    found = detections.select("run", F.lit("detection").alias("kind"), F.col("start_ms").alias("at"), "detection_id", F.concat(clock(F.col("start_ms")), F.lit(" "), "trick_id", F.format_string(" (%.2f)", F.col("confidence"))).alias("message"))
    scored = totals.select("run", F.lit("score").alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("detection_id"), F.format_string("total %.2f", F.col("total")).alias("message"))
    order = Window.partitionBy("run").orderBy(F.col("at").asc_nulls_last(), "detection_id")
    return found.unionByName(scored).withColumn("nth", F.row_number().over(order).cast("long")).select("run", "nth", "kind", "message")


def run_report(runs: DataFrame, detections: DataFrame) -> DataFrame:
    """run and its detections as one JSON text, in the order of their ids."""
    item = F.struct("detection_id", "trick_id", "confidence")
    grouped = detections.groupBy("run").agg(F.array_sort(F.collect_list(item)).alias("detections"))
    return runs.join(grouped, "run", "left").select("run", F.to_json(F.struct("run", F.coalesce("detections", F.array().cast("array<struct<detection_id:bigint,trick_id:string,confidence:double>>")).alias("detections"))).alias("report"))


def manifest(samples: DataFrame) -> DataFrame:
    """One row: sorted classes, their counts and the number of samples, as a training manifest needs them."""
    counts = samples.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("c")).select(F.transform("c", lambda x: x["label"]).alias("classes"), F.map_from_entries("c").alias("class_counts"), F.coalesce(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long")).alias("samples"))


def with_reference_names(references: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ref, ref_001 and on, counting on from each trick's existing references, in the order of ``id``."""
    had = existing.groupBy("trick_id").agg(F.count("*").alias("had"))
    order = Window.partitionBy("trick_id").orderBy("id")
    numbered = references.withColumn("nth", F.row_number().over(order)).join(had, "trick_id", "left")
    return numbered.withColumn("ref", F.format_string("ref_%03d", F.col("nth") + F.coalesce("had", F.lit(0)))).drop("nth", "had")


def labels_of(events: DataFrame) -> DataFrame:
    """file, trick_id, start_ms of the labels that a log of events (seq, file, action, trick_id, start_ms) leaves: added and not deleted later."""
    state = latest(events.filter(F.col("action").isin("add", "delete")), ["file", "trick_id", "start_ms"], "seq")
    return state.filter("action = 'add'").select("file", "trick_id", "start_ms")


def absent(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The first row of every key that ``existing`` does not have, so that adding them twice adds nothing."""
    order = Window.partitionBy(key).orderBy("id")
    return wanted.join(existing.select(key), key, "left_anti").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
