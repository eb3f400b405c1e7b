"""Streams with keyed state against the batch forms: reordered, late and repeated arrivals, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import jobs, stateful

EVENT = "job_id long, seq long, ts timestamp, status string"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, schema, batches, stream, mode):
    """What ``stream`` gives of ``batches``, each read as one micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = []
    query = stream(source).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/b{i}")
            part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
            part.rename(folder / f"{i:04d}.parquet")
            query.processAllAvailable()
        state = query.lastProgress["stateOperators"][0]
    finally:
        query.stop()
    return out, state


@pytest.fixture()
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_settling_over_a_stream_equals_the_batch(spark, tmp_path, few_partitions):
    rng = random.Random(4)
    path = ["downloading", "extracting", "ready", "completed"]
    events, seq = [], 0
    for job in range(6):
        statuses = {0: path, 1: [*path, "ready", "failed"], 2: ["downloading", "ready", "extracting", "failed"], 3: ["downloading", "downloading", "extracting"], 4: ["completed"], 5: ["failed", "completed"]}[job]
        for i, status in enumerate(statuses):
            events.append((job, seq, at(20 * i + job), status))
            seq += 1
    batch = spark.createDataFrame(events, EVENT)
    want = sorted(map(tuple, stateful.settled_events(batch).collect()))
    shuffled = sorted(events, key=lambda e: (e[2] + dt.timedelta(seconds=rng.choice([0, 25])), e[1]))
    batches = [shuffled[i : i + 5] for i in range(0, len(shuffled), 5)]
    batches[1] = batches[1] + batches[0][:2]  # come again
    batches.append([(90, 900, at(5000), "downloading")])  # moves the watermark past all others
    batches.append([(0, 901, at(1), "failed"), (91, 902, at(5001), "downloading")])  # comes far too late
    batches.append([(92, 903, at(50_000), "downloading")])
    got, state = run(spark, tmp_path, EVENT, batches, lambda s: stateful.settle_stream(s, "1 minute", keep_ms=600_000), "append")
    assert sorted(map(tuple, (r for r in got if r["job_id"] < 90))) == want
    assert len([r for r in want if r[6]]) == 5 and any(r[5] for r in want)


def test_state_is_gone_after_a_job_has_settled(spark, tmp_path, few_partitions):
    batches = [[(1, 0, at(0), "downloading"), (1, 1, at(1), "failed"), (1, 2, at(2), "ready")], [(2, 3, at(200), "failed")], [(2, 4, at(300), "ready"), (3, 5, at(90_000), "failed")], [(3, 6, at(200_000), "failed")], [(3, 7, at(300_000), "failed")]]
    got, state = run(spark, tmp_path, EVENT, batches, lambda s: stateful.settle_stream(s, "1 minute", keep_ms=60_000), "append")
    assert [(r["job_id"], r["seq"], r["settled"]) for r in got] == [(1, 0, False), (1, 1, True), (2, 3, True), (3, 5, True)]  # what comes after the end is not a new job
    assert state["numRowsTotal"] <= 4  # the last event, its timer and what marks job 3: none of jobs 1 and 2


def test_open_windows_over_a_stream_equal_the_batch(spark, tmp_path, few_partitions):
    rng = random.Random(2)
    pieces = [(run_id, w, 1000 * w + i, f"r{run_id}w{w}p{i} ") for run_id in (1, 2) for w in range(12) for i in range(20)]
    pieces += [(1, 12, 20_000 + i, f"x{i} ") for i in range(3000)]  # one hot window
    near = sorted(pieces, key=lambda p: (p[1], rng.random()))
    batches = [near[i : i + 400] for i in range(0, len(near), 400)]
    schema = "run_id long, window_idx long, seq long, text string"
    got, state = run(spark, tmp_path, schema, batches, stateful.window_text_stream, "update")
    last = {(r["run_id"], r["window_idx"]): r["text"] for r in got}
    assert last == {(r["run_id"], r["window_idx"]): r["text"] for r in jobs.open_window_text(spark.createDataFrame(pieces, schema)).collect()}
    assert state["numRowsTotal"] <= 3000 + 20 * 3 + 4  # the pieces of older windows are gone


def test_files_in_progress_over_a_stream_equal_the_batch(spark, tmp_path, few_partitions):
    rng = random.Random(6)
    messages, seq = [], 0
    for session in (1, 2):
        for f in range(40):
            for status, p in [("initiate", 0.0), *[("progress", rng.random()) for _ in range(3)], *([("done", 1.0)] if f % 3 else [])]:
                messages.append((session, f"s{session}f{f}", status, seq, p))
                seq += 1
    messages.append((1, "never", "progress", seq, 0.5))
    schema = "session long, file string, status string, seq long, progress double"
    batches = [messages[i : i + 90] for i in range(0, len(messages), 90)]
    got, state = run(spark, tmp_path, schema, batches, stateful.progress_stream, "update")
    shown = {}
    for r in got:
        shown[r["file"]] = r
    batch = {r["file"]: r["progress"] for r in jobs.progress_items(spark.createDataFrame(messages[:-1], schema)).collect()}
    assert {f: r["progress"] for f, r in shown.items() if not r["done"]} == batch and len(batch) == 28 and "never" not in shown
    assert state["numRowsTotal"] == 28
