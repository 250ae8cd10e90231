from pyspark.sql import functions as F

from motionframe import queries
from motionframe.operators import matching


def test_best_matches_equal_all_pairs_and_meet_combinations_only(spark):
    catalog = spark.range(900).select(
        F.col("id").alias("trick_id"),
        F.concat(F.lit("n"), F.col("id") % 11).alias("name"),
        ((F.col("id") % 3) / 2).alias("flips"),
        ((F.col("id") % 2) / 2).alias("twists"),
        F.when(F.col("id") % 4 < 2, "lateral").otherwise("sagittal").alias("axis"),
        F.lit("forward").alias("direction"),
        F.lit("tuck").alias("shape"),
        F.lit("standing").alias("entry"),
        F.when(F.col("id") % 5 == 0, "wall").otherwise("ground").alias("context"),
        (F.col("id") * 37 % 13 / 10).alias("score"),
    )
    signatures = spark.range(40).select(
        F.col("id").alias("sig_id"), F.sin("id").alias("ax"), F.cos("id").alias("ay"), F.sin(F.col("id") * 2).alias("az"), (F.col("id") * 17.0).alias("flip_deg"), (F.col("id") * 9.0).alias("twist_deg"),
        F.lit("forward").alias("sig_direction"), F.lit("pike").alias("sig_shape"), F.lit("running").alias("sig_entry"),
    )
    met = matching.combinations(catalog, 5)
    assert met.count() == catalog.select(*matching.PHYSICS).distinct().count() <= 24
    assert met.agg(F.max(F.size("members"))).first()[0] == 5
    for k, context in ((5, None), (3, "wall")):
        want = matching.top_matches(matching.distances(signatures, catalog), k=k, context=context)
        assert sorted(matching.best_matches(signatures, catalog, k=k, context=context).collect()) == sorted(want.collect())


def test_registered_queries_keep_their_rows(spark):
    d = "/root/testdata/sf0.001"
    want = matching.top_matches(matching.distances(queries._signatures(spark, d), queries._catalog(spark, d)))
    assert sorted(queries.physics_match_topk(spark, d).collect()) == sorted(want.collect())
