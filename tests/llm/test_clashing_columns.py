import pytest
from pyspark.sql import functions as F

from motionframe.llm import contamination, jaccard_join, line_dedup, toxicity, workspace

LINE = "the quick brown fox jumps over the lazy dog and runs away"
#: Columns whose names the stages use themselves, in several cases.
CLASHES = ["_removed", "_doc_id", "lost_removed", "lost_doc_id", "copy_t1", "N_Words", "spans", "Items", "h1", "key", "node", "bucket", "other_3", "doc", "place", "component_id", "removed"]


@pytest.fixture
def docs(spark):
    rows = [(1, LINE), (2, LINE), (3, LINE + "\nsomething else entirely stands here"), (None, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("doc_id", *(F.lit(c).alias(c) for c in CLASHES[:5]), "text", *(F.lit(c).alias(c) for c in CLASHES[5:]), F.length("text").alias("n_chars"))


def check(out, docs, texts):
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str(t) for t in texts)
    place = {c: docs.columns.index(c) for c in CLASHES}
    assert all(r[place[c]] == c for r in rows for c in CLASHES)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_line_dedup(docs):
    check(line_dedup.dedup(docs), docs, [(1, LINE), (3, "something else entirely stands here"), (None, None), (5, "")])


def test_one_of_each(docs):
    check(jaccard_join.one_of_each(docs), docs, [(1, LINE), (3, LINE + "\nsomething else entirely stands here"), (None, None), (5, "")])


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([("i", "something else entirely stands here")], "item_id string, text string")
    check(contamination.decontaminate(docs, items), docs, [(1, LINE), (2, LINE), (3, LINE + "\n"), (None, None), (5, "")])


def test_reject_toxic(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject(docs, toxicity.fit(docs, labels)).columns == docs.columns


def test_names_by_place(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "TEXT int, a int, A int")
    assert workspace.plainly_named(frame, "text", "doc_id").columns == ["text", "other_1", "other_2"]
