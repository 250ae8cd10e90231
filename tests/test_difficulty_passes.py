from motionframe import queries
from motionframe.operators import catalog


def test_backward_pass_lowers_tricks_above_their_subsequents(spark):
    tricks = spark.createDataFrame([(1, 6.0), (2, 5.0), (3, 4.0), (4, 10.0), (5, None)], "id long, difficulty double")
    edges = spark.createDataFrame([(3, 9)], "id long, prerequisite long")
    after = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "id long, subsequent long")
    got = {r.id: r.difficulty for r in catalog.propagate_difficulty(tricks, edges, subsequents=after).collect()}
    assert got == {1: 3.0, 2: 3.5, 3: 4.0, 4: 10.0, 5: None}


def test_passes_on_inverse_edges(spark):
    tricks = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 3.2)], "id long, difficulty double")
    edges = spark.createDataFrame([(2, 1), (3, 2)], "id long, prerequisite long")
    assert {r.id: r.difficulty for r in catalog.propagate_difficulty(tricks, edges).collect()} == {1: 3.0, 2: 3.5, 3: 4.0}


def test_registered_query_has_every_part(spark):
    d = "/root/testdata/sf0.001"
    assert queries.queries()["difficulty_fixpoint"](spark, d).count() == spark.read.parquet(f"{d}/part.parquet").count()
