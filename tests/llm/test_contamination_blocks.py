import random

from pyspark.core.broadcast import Broadcast

from motionframe.llm import contamination


def test_blocks_of_the_benchmark_are_held_one_at_a_time(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    items = [(f"i{k:02}", " ".join(rng.choice(words) for _ in range(rng.choice([4, 12, 20])))) for k in range(25)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(15)) + " " + " ".join(rng.choice(items)[1] for _ in range(k % 3))) for k in range(60)] + [(99, None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    live, most, sent = set(), [], spark.sparkContext.broadcast

    def broadcast(value):
        made = sent(value)
        live.add(id(made))
        most.append(len(live))
        return made

    whole_destroy = Broadcast.destroy
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **k: (live.discard(id(self)), whole_destroy(self, *a, **k))[1])
    found = {}
    for size in (10**9, 100):
        most.clear()
        live.clear()
        rows = contamination.matches(frame, bench, block_words=size).collect()
        found[size] = sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], sorted(r["items"])) for r in rows)
        assert max(most) == 1 and len(most) == (1 if size > 100 else len(most))
    assert len(most) >= 5 and found[100] == found[10**9] and any(r[3] for r in found[100])
