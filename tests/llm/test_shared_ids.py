from motionframe.llm import jaccard_join, line_dedup


def line(name):
    return " ".join(f"{name}{k}" for k in range(12))


def test_lines_of_rows_without_or_with_shared_doc_ids(spark):
    rows = [(1, line("a")), (None, line("a") + "\n" + line("b")), (None, line("c") + "\n" + line("d")), (2, line("a")), (2, line("e")), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text or "" for r in line_dedup.dedup(docs).collect())
    assert got == sorted(["", line("a"), line("b"), line("c") + "\n" + line("d"), line("e")])
    assert sorted((r.n_lines, r.n_removed, list(r.owners)) for r in line_dedup.report(docs).collect()) == [(0, 0, []), (1, 0, []), (1, 0, []), (1, 1, [1]), (2, 0, []), (2, 1, [1])]


def test_text_that_shares_its_id_with_a_copy_stays(spark):
    rows = [(1, line("a")), (2, line("a")), (2, line("b")), (None, line("a")), (3, None)]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(r) for r in (rows[0], rows[2], rows[3], rows[4]))
