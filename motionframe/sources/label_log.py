"""The label editor's files as a log of edits: replaying it, the files marked done, tricks that labelers add, and what is left to do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LABEL = ["trick_id", "start_ms", "end_ms"]
#: Labels handed on at once.
_AT_ONCE = 10_000


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Holds the labels that are left of one file at a time; its edits come in order."""
    columns = ["file", "nth", *_LABEL]
    live: list[tuple] = []
    done: list[tuple] = []
    current, begun = None, False

    def closed() -> None:
        done.extend((current, k, *label) for k, label in enumerate(live))
        live.clear()

    for frame in frames:
        nth = frame["nth"].to_numpy(dtype="float64", na_value=float("nan"))
        for file, action, at, *label in zip(frame["file"], frame["action"], nth, *(frame[c] for c in _LABEL), strict=True):
            if begun and file != current:
                closed()
            current, begun = file, True
            if action == "add":
                live.append(tuple(label))
            elif 0 <= at < len(live):
                del live[int(at)]
        if len(done) >= _AT_ONCE:
            yield pd.DataFrame(done, columns=columns)
            done.clear()
    closed()
    if done:
        yield pd.DataFrame(done, columns=columns)


def replayed(edits: DataFrame) -> DataFrame:
    """file, nth, trick_id, start_ms, end_ms of the labels that ``edits`` (seq, file, action, nth, trick_id, start_ms, end_ms) leave, numbered by file.

    Edits apply in the order of seq: add puts a label last, with start 0 where it has none; delete takes the file's nth of the labels
    there are then, from 0, and does nothing if there is none.  Spark sorts the edits by file and passes over each partition once, so
    memory holds the labels left of one file, not its edits.  Edits of a null file do nothing; other actions are left to
    :func:`done_files`.
    """
    kept = edits.filter(F.col("action").isin("add", "delete") & F.col("file").isNotNull())
    ordered = kept.select("file", "seq", "action", F.coalesce(F.col("nth").cast("long"), F.lit(-1).cast("long")).alias("nth"), "trick_id", F.coalesce(F.col("start_ms").cast("long"), F.lit(0).cast("long")).cast("string").alias("start_ms"), F.col("end_ms").cast("long").cast("string").alias("end_ms"))
    sorted_ = ordered.repartition("file").sortWithinPartitions("file", "seq").drop("seq")
    found = sorted_.mapInPandas(_replay, "file string, nth long, trick_id string, start_ms string, end_ms string")
    return found.select("file", "nth", "trick_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


def done_files(edits: DataFrame) -> DataFrame:
    """file, seq of the first time each file, not empty, was marked done."""
    return edits.filter("action = 'done' AND file <> ''").groupBy("file").agg(F.min("seq").alias("seq"))


def trick_key(name: Column) -> Column:
    """Lower case, trimmed, spaces and hyphens as underlines."""
    return F.translate(F.lower(F.trim(name)), " -", "__")


def added_tricks(requests: DataFrame, known: DataFrame) -> DataFrame:
    """id, name, category of the requests (seq, id, name, category) that add a trick: the first of each id that ``known`` (id) lacks.

    Requests whose id or name is missing or blank add none; a missing category is "other".
    """
    asked = requests.select("seq", trick_key(F.col("id")).alias("id"), F.trim("name").alias("name"), F.lower(F.trim(F.coalesce("category", F.lit("other")))).alias("category")).filter("id <> '' AND name <> ''")
    first = Window.partitionBy("id").orderBy("seq")
    return asked.join(known.select("id"), "id", "left_anti").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("id", "name", "category")


def work_queue(samples: DataFrame, relabels: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """pos, original, class, label, done of the ``samples`` (pos, original, class) of the coarse ``classes``; label is that of ``relabels`` (seq, original, label).

    A sample is done if it was relabelled, whatever the label; of several the last counts.
    """
    last = relabels.groupBy("original").agg(F.max_by(F.struct("label"), "seq").alias("r"))
    return samples.filter(F.col("class").isin(*classes)).join(last, "original", "left").select("pos", "original", "class", F.col("r.label").alias("label"), F.col("r").isNotNull().alias("done"))
