import os

import pytest
from pyspark.sql import functions as F

from motionframe.llm import label_model, quality, workspace

SMALL = "/root/testdata/sf0.01"


def test_abstaining_is_evidence_where_it_is_said_to_be():
    # two rules that vote for nearly all good rows and for no poor ones, and one that votes against some poor ones
    patterns = {(1, 1, -1): 800, (1, -1, -1): 60, (-1, 1, -1): 40, (-1, -1, 0): 60, (-1, -1, -1): 40}
    silent, heard = (label_model.fit(patterns, 3, silence_counts=s) for s in (False, True))
    assert heard.posterior((-1, -1, -1)) < 0.5 < heard.posterior((1, -1, -1)) < heard.posterior((1, 1, -1))
    assert heard.posterior((-1, -1, 0)) < heard.posterior((-1, -1, -1)) and silent.posterior((-1, -1, -1)) == pytest.approx(silent.prior)
    assert label_model.fit({}, 2, silence_counts=True).prior == 0.5


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_poor_documents_that_pass_the_base_rules_are_mostly_rejected(spark):
    judged = quality.verdicts(workspace.documents(spark, SMALL)).filter("NOT base_failed")
    labels = workspace.table(spark, SMALL, "labels").select("doc_id", F.col("quality").alias("label"))
    kept = {(r.label, r.kept): r.n for r in judged.join(labels, "doc_id").groupBy("label", "kept").agg(F.count("*").alias("n")).collect()}
    # 27 of 27 poor ones are rejected, and none of 335 good ones
    assert kept.get((0, False), 0) >= 0.9 * (kept.get((0, False), 0) + kept.get((0, True), 0))
    assert kept.get((1, True), 0) >= 0.99 * (kept.get((1, False), 0) + kept.get((1, True), 0)) > 300


def test_empty_and_very_long_texts(spark):
    none = quality.verdicts(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == []
    long_text = "Plain words make up this sentence, and it ends here. " * 60_000
    got = quality.verdicts(spark.createDataFrame([(1, long_text), (2, " ".join(f"w{k}" for k in range(400_000)))], "doc_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].n_words == 600_000 and rows[1].n_repeat_words == 600_000 and rows[1].base_failed and not rows[1].kept
    assert rows[2].n_words == 400_000 and rows[2].n_repeat_words == 0 and not rows[2].base_failed
