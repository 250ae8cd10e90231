import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    base = [f"word{k}" for k in range(200)]
    passage = " ".join(f"test{k}" for k in range(30))
    line = lambda s: " ".join(base[s : s + 25])
    docs = [(k, f"alpha{k} beta{k} gamma{k} delta{k} " * 1 + " ".join(f"own{k}x{j}" for j in range(40))) for k in range(40)]
    docs += [(50, line(0) + "\n" + line(60)), (51, line(0) + "\n" + line(90)), (60, "unique start of sixty " + passage + " and " + " ".join(f"tail{j}" for j in range(60))), (70, None)]
    docs += [(80 + k, f"idiot scum moron {k} " + " ".join(f"bad{k}x{j}" for j in range(20))) for k in range(10)]
    frame = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(80 + k, 1, 1) for k in range(6)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {80 + k for k in range(10)} & set(got) and set(range(40)) <= set(got)
    encoding = corpus_pipeline.byte_bpe.tokenizer(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    text = lambda i: encoding.decode([int.from_bytes(got[i].ids[k : k + 4], "little") for k in range(0, len(got[i].ids), 4)])
    assert text(50) == docs[40][1] and line(0) not in text(51) and line(90) in text(51)
    assert "test5" not in text(60) and "tail5" in text(60)
