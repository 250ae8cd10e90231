import json

from motionframe.sources import readers, sinks


def test_rule_catalog_falls_back_and_fills_defaults(spark, tmp_path):
    folder = tmp_path / "en"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"trick_id": "one", "difficulty": 3, "names": {"en": "One"}, "phases": [{"name": "p", "duration_range_ms": [100, 200]}]}, indent=1))
    row = readers.rule_catalog(spark, str(tmp_path), "fr").first()
    assert (row.trick_id, row.difficulty, row.tags, row.detection_method, row.names) == ("one", 3.0, [], "angle_threshold", {"en": "One"})
    assert readers.rule_catalog(spark, str(tmp_path / "none")).count() == 0


def test_physics_catalog_defaults(spark, tmp_path):
    path = tmp_path / "catalog.json"
    tricks = [{"name": "Wall Flip (A)", "flip": 1, "direction": "side", "takeoff": "gainer"}, {"name": "Step"}]
    path.write_text(json.dumps({"categories": {"wall": {"context": "wall", "tricks": tricks}, "odd": {"context": "moon", "tricks": [{"name": "Roll", "axis": "sagittal"}]}}}))
    got = {r.trick_id: (r.flips, r.axis, r.direction, r.entry, r.context) for r in readers.physics_catalog(spark, str(path)).collect()}
    assert got == {"wall_flip_a": (1.0, "lateral", "left", "running", "wall"), "step": (0.0, "lateral", "backward", "wall", "wall"), "roll": (0.0, "sagittal", "backward", "standing", "ground")}


def test_label_files_of_three_shapes(spark, tmp_path):
    shapes = [{"classes": [], "samples": [{"file": "a", "class": "x"}]}, {"labels": [{"file": "b", "trick_id": "y", "start_ms": 5}]}, [{"file": "c", "trick_id": "", "class": "z"}, {"file": "d"}]]
    got = []
    for k, shape in enumerate(shapes):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(shape))
        got += [(r.file, r.trick_id, r.start_ms) for r in readers.labels(spark, str(path)).collect()]
    assert sorted(got) == [("a", "x", None), ("b", "y", 5.0), ("c", "z", None), ("d", "", None)]


def test_labelled_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("label,youtube_id,time_start,time_end,split\nflip,u,1,11,train\nrun,v,2,12,train\n")
    assert [tuple(r)[:3] for r in readers.labelled_list(spark, str(path), ["flip"]).collect()] == [("flip", "u", 1)]


def test_appended_rows_and_their_latest_state(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "run long, seq long, status string")
    sinks.append(rows((1, 1, "pending"), (2, 1, "pending")), f"{tmp_path}/runs")
    sinks.append(rows((1, 2, "completed")), f"{tmp_path}/runs")
    log = spark.read.parquet(f"{tmp_path}/runs")
    assert log.count() == 3 and sorted((r.run, r.status) for r in sinks.latest(log, ["run"], "seq").collect()) == [(1, "completed"), (2, "pending")]
