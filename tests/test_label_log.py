import random

from motionframe.sources import label_log

EDITS = "seq long, file string, action string, nth long, trick_id string, start_ms long, end_ms long"


def sequential(edits):
    live = {}
    for _, file, action, nth, trick, start, end in sorted(edits, key=lambda e: e[0]):
        if file is None or action not in ("add", "delete"):
            continue
        labels = live.setdefault(file, [])
        if action == "add":
            labels.append((trick, start or 0, end))
        elif nth is not None and 0 <= nth < len(labels):
            labels.pop(nth)
    return sorted((f, k, *map(str, label)) for f, labels in live.items() for k, label in enumerate(labels))


def test_replay_equals_a_sequential_one(spark, monkeypatch):
    rng = random.Random(1)
    edits = []
    for seq in range(3000):
        file = rng.choice(["hot", "hot", "a.mp4", "b.mp4", f"f{rng.randrange(40)}", None, ""])
        action = rng.choice(["add"] * 5 + ["delete"] * 4 + ["done", "other"])
        nth = rng.choice([None, -1, 0, 0, 1, 2, 7, 100]) if action == "delete" else None
        edits.append((seq, file, action, nth, rng.choice(["flip", "twist", None]), rng.choice([None, 0, 100 * seq]), rng.choice([None, seq])))
    rng.shuffle(edits)
    log = spark.createDataFrame(edits, EDITS).repartition(5)
    got = sorted((r.file, r.nth, *map(str, (r.trick_id, r.start_ms, r.end_ms))) for r in label_log.replayed(log).collect())
    assert got == sequential(edits) and len(got) > 300
    done = {}
    for seq, file, action, *_ in edits:
        if action == "done" and file:
            done[file] = min(seq, done.get(file, seq))
    assert {r.file: r.seq for r in label_log.done_files(log).collect()} == done


def test_nothing_left_and_nothing_there(spark):
    assert label_log.replayed(spark.createDataFrame([], EDITS)).collect() == []
    edits = [(1, "a", "delete", 0, None, None, None), (2, "a", "add", None, "x", None, None), (3, "a", "delete", 0, None, None, None)]
    assert label_log.replayed(spark.createDataFrame(edits, EDITS)).collect() == []


def test_added_tricks_and_queue(spark):
    requests = spark.createDataFrame([(3, "Back-Full ", "late", "x"), (1, " back full", "Back Full", None), (2, "known", "Known", "flip"), (4, "", "none", "flip"), (5, "b", "  ", "flip"), (6, None, "n", "flip"), (7, "c", "C", " Flip ")], "seq long, id string, name string, category string")
    known = spark.createDataFrame([("known",)], "id string")
    assert sorted(tuple(r) for r in label_log.added_tricks(requests, known).collect()) == [("back_full", "Back Full", "other"), ("c", "C", "flip")]
    samples = spark.createDataFrame([(1, "a", "flip"), (2, "b", "flip"), (3, "c", "vault"), (4, "d", "cartwheel")], "pos long, original string, class string")
    relabels = spark.createDataFrame([(1, "a", "gainer"), (2, "a", "webster"), (3, "d", None), (4, "zzz", "x")], "seq long, original string, label string")
    assert sorted(map(tuple, label_log.work_queue(samples, relabels, ("flip", "cartwheel")).collect()), key=str) == [(1, "a", "flip", "webster", True), (2, "b", "flip", None, False), (4, "d", "cartwheel", None, True)]
