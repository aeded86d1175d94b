"""Streams over real folders."""

from orbitile.streaming import live


def drained(stream, mode, folder, keys=None):
    return live.drain(stream, mode, f"file://{folder}", keys=keys)


def test_watched_folder(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "bbox_1.geojson").write_text("1,2,3,4")
    (inbox / "geometry_2.geojson").write_text('{"type":"Polygon","coordinates":[[[5,6],[7,6],[7,8],[5,6]]]}')
    (inbox / "notes.txt").write_text("9,9,9,9")
    got = {r.file_name: tuple(r.box) for r in drained(live.watch_boxes(spark, str(inbox)), "append", tmp_path / "c").collect()}
    assert got == {"bbox_1.geojson": (1, 2, 3, 4), "geometry_2.geojson": (5, 6, 7, 8)}


def test_state_over_batches(spark, tmp_path):
    schema = "grp long, completed_at double"
    for k in range(3):
        rows = [(g, float(10 * i + g)) for g in (1, 2) for i in range(20 * k, 20 * k + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = live.scene_stream(spark, str(tmp_path / "in"), schema)
    out = drained(live.throughput(events, 100), "update", tmp_path / "c", ["grp"])
    last = {r.grp: r for r in out.collect()}
    assert {g: (r.done, round(r.remaining, 6)) for g, r in last.items()} == {1: (60, 400.0), 2: (60, 400.0)}
    assert spark.read.parquet(str(tmp_path / "c" / "out")).count() == 6


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("A", 0.5), ("A", 0.7), ("B", 0.1)], "sensor string, score double").write.parquet(str(tmp_path / "in"))
    stream = live.scene_stream(spark, str(tmp_path / "in"), "sensor string, score double")
    assert {tuple(r) for r in drained(live.running_usage(stream), "complete", tmp_path / "c").collect()} == {("A", 2, 0.7), ("B", 1, 0.1)}


def test_a_file_is_taken_once_and_counts_go_on(spark, tmp_path):
    """A second run of the same stream goes on from its state and takes new files only."""
    schema = "sensor string, score double"
    spark.createDataFrame([("A", 0.5)], schema).write.parquet(str(tmp_path / "in"))
    for wanted, more in (({("A", 1, 0.5)}, [("A", 0.9), ("B", 0.2)]), ({("A", 2, 0.9), ("B", 1, 0.2)}, [])):
        stream = live.scene_stream(spark, str(tmp_path / "in"), schema)
        assert {tuple(r) for r in drained(live.running_usage(stream), "complete", tmp_path / "c").collect()} == wanted
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(str(tmp_path / "in"))


def test_an_empty_source_has_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for mode, keys in (("complete", None), ("update", ["sensor"])):
        stream = live.running_usage(live.scene_stream(spark, str(tmp_path / "in"), "sensor string, score double"))
        out = drained(stream, mode, tmp_path / mode, keys)
        assert out.collect() == [] and out.columns == ["sensor", "n", "best"]
