import random

from motionframe.llm import buckets, components, jaccard_join, workspace
from tests.llm.test_jaccard_join import brute


def test_only_links_between_components_are_gone_through(spark, monkeypatch):
    rng, seen, whole = random.Random(7), [], components.components
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    nodes = spark.createDataFrame(edges, "a long, b long")
    known = workspace.cut(whole(nodes.limit(120)))

    def counted(links):
        seen.append(links.filter("a != b").distinct().count())
        return whole(links)

    monkeypatch.setattr(components, "components", counted)
    got = components.merged(known, spark.createDataFrame(edges[120:], "a long, b long")).collect()
    assert seen[0] <= 30
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole(nodes).collect()))
    # a link inside of a component changes nothing
    one = known.filter("node != component").first()
    inside = components.merged(known, spark.createDataFrame([(one.node, one.component)], "a long, b long")).collect()
    assert sorted(map(tuple, inside)) == sorted(map(tuple, known.collect()))


def test_small_regions_are_done_in_one_turn(spark, monkeypatch):
    # chains of texts of which only neighbours link
    rows = [(chain * 100 + k, " ".join(f"c{chain}w{j}" for j in range(8 * k, 8 * k + 120))) for chain in range(6) for k in range(10)]
    opened, whole = [], buckets.open_rows
    monkeypatch.setattr(buckets, "open_rows", lambda *a: opened.append(1) or whole(*a))
    got = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert len(opened) <= 2


def test_the_screen_is_wider_than_what_linked_texts_may_miss(spark):
    passage = " ".join(f"p{k}" for k in range(10))
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(390)) + " " + passage) for i in range(60)]
    sketched = jaccard_join.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert jaccard_join._screened(sketched, 80).count() <= 3
