import datetime as dt
import json

from semdrift.sources.capture import read_capture_stream
from semdrift.streaming import ingest, metrics

BATCHES = [
    # (route, minute of the event) or a broken message
    [("/a", 50), ("/a", 10), ("/b", 50), "{broken"],
    [("/a", 20), ("/a", 30), (None, 10), ("/new", 1)],
    ["{broken", "[1]"],
    [("/b", 29), ("/b", 31)],
]
WINDOWS = [("/a", dt.datetime(2024, 1, 1, 0, 30)), ("/b", dt.datetime(2024, 1, 1, 0, 30))]


def test_late_rows_and_rejects_of_each_batch(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "metrics"), str(tmp_path / "cp")
    source.mkdir()
    windows = spark.createDataFrame(WINDOWS, "route string, window_end timestamp")
    for b, batch in enumerate(BATCHES):
        lines = []
        for i, row in enumerate(batch):
            value = row if isinstance(row, str) else json.dumps({"route": row[0], "frame_type": "request_body", "body": "b", "timestamp": f"2024-01-01T00:{row[1]:02}:00Z"})
            lines.append(json.dumps({"topic": "t", "partition": 0, "offset": 10 * b + i, "timestamp": "2024-01-01T01:00:00Z", "value": value}))
        (source / f"{b}.json").write_text("\n".join(lines))
        # One batch per run; every run goes on from the checkpoint.
        stream = read_capture_stream(spark, {"path": str(source)}, "json")
        ingest.run_ingest(
            stream, str(tmp_path / "out"), str(tmp_path / "bad"), checkpoint, embed=False, trigger={"availableNow": True},
            metrics=path, windows=lambda: windows,
        ).awaitTermination()
    run = ingest.run_name(checkpoint)
    told = metrics.read_metrics(spark, path)
    got = {(r["batch_id"], r["route"]): (r["received"], r["late"], r["rejected"]) for r in told.collect()}
    assert {r["run"] for r in told.collect()} == {run}
    assert got == {
        (0, "/a"): (2, 1, 0), (0, "/b"): (1, 0, 0), (0, None): (0, 0, 1),
        (1, "/a"): (2, 2, 0), (1, None): (1, 0, 0), (1, "/new"): (1, 0, 0),
        (2, None): (0, 0, 2), (3, "/b"): (2, 1, 0),
    }
    settled = lambda before, now: metrics.settled_since(told, run, before, now).first()["settled"]
    assert [settled(0, 1), settled(1, 2), settled(2, 3), settled(3, 3)] == [False, True, False, True]
    assert metrics.settled_since(told, "other", 0, 3).first()["settled"] is False


def test_counts_without_windows_or_rows(spark):
    events = spark.createDataFrame([("/a", None), (None, None)], "route string, event_ts timestamp")
    bad = spark.createDataFrame([("x", "y")], "reason string, route string")
    rows = {r["route"]: tuple(r)[1:] for r in metrics.batch_metrics(events, bad).collect()}
    assert rows == {"/a": (1, 0, 0), None: (1, 0, 1)}
    windows = spark.createDataFrame(WINDOWS, "route string, window_end timestamp")
    assert {r["route"]: r["late"] for r in metrics.batch_metrics(events, bad, windows).collect()} == {"/a": 0, None: 0}
    assert metrics.batch_metrics(events.limit(0), bad.limit(0)).collect() == []
