import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, path, docs):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_nulls_repeats_and_long_texts_without_labels_or_items(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(20_000))
    docs = [(1, None), (2, ""), (3, "one short line"), (3, "one short line"), (4, long), (None, "text without an id"), (5, long + " end")]
    got = run(spark, tmp_path, docs)
    # the near copy of the long text goes; rows equal in id and text stay together
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens > 0) for r in got) == [(False, 1, False), (False, 2, False), (False, 3, True), (False, 3, True), (False, 4, True), (True, 0, True)]
