"""Tables, readers and streams on small rows."""

import datetime as dt
import struct
import time

import pytest
from pyspark.sql import functions as F

from lectern import api
from lectern.functions import config
from lectern.operators import store
from lectern.sources import readers
from lectern.streaming import jobs

RECIPE = "source_id long, model_id string, task string, language string"


def test_lookup_prefers_the_exact_model(spark):
    stored = spark.createDataFrame([(1, "base", "transcribe", "en", "alias"), (2, "base", "transcribe", "en", "alias"), (2, "base_timestamped", "transcribe", "en", "exact")], RECIPE + ", full_text string")
    asked = spark.createDataFrame([("a", 1, "base_timestamped", "transcribe", "en"), ("b", 2, "base_timestamped", "transcribe", "en"), ("c", 1, "base_timestamped", "transcribe", "fr")], "request_id string, " + RECIPE)
    assert {r["request_id"]: r["full_text"] for r in store.lookup_transcripts(asked, stored).collect()} == {"a": "alias", "b": "exact"}


def test_upsert_and_update(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
    schema = "id long, source_type string, source_key string, canonical_url string, filename string, size_bytes long, created_at timestamp, updated_at timestamp, last_accessed_at timestamp"
    have = spark.createDataFrame([(5, "file", "k", "u", "f", 1, t0, t0, t0)], schema)
    new = spark.createDataFrame([("file", "k", None, "g", None, t1), ("file", "n", None, None, 3, t1)], "source_type string, source_key string, canonical_url string, filename string, size_bytes long, at timestamp")
    got = {r["source_key"]: r for r in store.upsert_sources(have, new).collect()}
    assert got["k"]["id"] == 5 and got["k"]["filename"] == "g" and got["k"]["canonical_url"] == "u" and got["k"]["created_at"] == t0 and got["k"]["updated_at"] == t1
    assert got["n"]["id"] == 6 and got["n"]["size_bytes"] == 3
    aged = store.expire_audio(spark.createDataFrame([(1, "a", "m", t0), (2, "a", "m", t1), (3, None, None, t0)], "id long, audio_path string, audio_mime_type string, last_accessed_at timestamp"), F.lit(t1))
    assert [(r["id"], r["audio_path"], r["expired"]) for r in aged.orderBy("id").collect()] == [(1, None, True), (2, "a", False), (3, None, False)]


def test_persist_completes_jobs_and_forgets_names(spark):
    seg = "array<struct<start:double,end:double,text:string,speaker:string>>"
    stored = spark.createDataFrame([(1, "m", "transcribe", "en", "old", [(0.0, 1.0, "a", "SPEAKER_00")])], RECIPE + f", full_text string, segments {seg}")
    work = spark.createDataFrame([("j", 1, "m", "transcribe", "en", "ready", 0.5, "x", None), ("bad", 1, "m", "transcribe", "en", "failed", 0.0, "y", None)], "id string, " + RECIPE + ", status string, progress double, error string, full_text string")
    names = spark.createDataFrame([(1, "SPEAKER_00", "Ann", 1), (2, "SPEAKER_00", "Bob", 1)], "source_id long, speaker_key string, display_name string, seq long")
    new = spark.createDataFrame([("j", 1, "m", "transcribe", "en", "new", [(0.0, 1.0, "a", "SPEAKER_01")], 1), ("bad", 1, "m", "transcribe", "en", "no", [], 2)], "job_id string, " + RECIPE + f", full_text string, segments {seg}, seq long")
    ws = api.Workspace(spark, work.limit(0), stored, work, names).persist(new)
    assert [r["full_text"] for r in ws.transcripts.collect()] == ["new"]
    done = {r["id"]: r for r in ws.jobs.collect()}
    assert done["j"]["status"] == "completed" and done["j"]["error"] is None and done["bad"]["status"] == "failed" and done["bad"]["error"] == "y"
    assert [r["display_name"] for r in ws.names.collect()] == ["Bob"]


def test_outcomes_stay_apart(spark):
    rows = spark.createDataFrame([(1, [], 0, None, False, True), (2, None, None, "crash", False, False), (3, None, None, "x", True, False)], "i int, turns array<struct<start:double,end:double,speaker:int>>, speaker_count int, reason string, cancelled boolean, ok boolean")
    got = store.outcomes(rows).orderBy("i").collect()
    assert [(r["status"], r["turns"], r["reason"]) for r in got] == [("succeeded", [], None), ("degraded", None, "crash"), ("cancelled", None, None)]


def test_enums(spark):
    rows = spark.createDataFrame([("file",), ("odd",)], "t string")
    assert [r[0] for r in rows.select(store.read_enum("t", store.SOURCE_TYPES, "file")).collect()] == ["file", "file"]
    with pytest.raises(Exception, match="unknown value"):
        rows.select(store.write_enum("t", store.SOURCE_TYPES)).collect()


def test_segment_json(spark):
    good = '[{"start":0,"end":1,"text":"a"}]'
    rows = spark.createDataFrame([(good,), ('[{"start":0,"end":1,"text":"a","x":1}]',), ('[{"start":0,"text":"a"}]',), ("nonsense",), (None,)], "j string")
    assert [len(r[0]) for r in rows.select(readers.parse_segments("j")).collect()] == [1, 0, 0, 0, 0]
    back = spark.createDataFrame([(good,)], "j string").select(readers.write_segments(readers.parse_segments("j")).alias("j")).first()["j"]
    assert "speaker" not in back


def wav(tag=1, bits=16, extra=b"", before=b""):
    fmt = struct.pack("<HHIIHH", tag, 1, 16000, 32000, 2, bits) + extra
    body = before + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def test_wave_headers_and_media_files(spark, tmp_path):
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert readers.wav_format(wav(before=odd)) == (1, 16000, 16, None)
    assert readers.wav_format(wav(bits=8))[3] == "not 16 bits" and readers.wav_format(b"x")[3] == "not a WAVE file"
    guid = bytes.fromhex("1600") + struct.pack("<HI", 16, 0) + readers.PCM_GUID
    assert readers.wav_format(wav(tag=0xFFFE, extra=guid))[3] is None and readers.wav_format(wav(tag=0xFFFE, extra=guid[:-1] + b"x"))[3] == "not PCM"
    (tmp_path / "a.WAV").write_bytes(wav())
    (tmp_path / "b.doc").write_bytes(b"")
    (tmp_path / "v.mp4.part").write_bytes(b"")
    files = readers.media_files(spark, str(tmp_path))
    row = files.select(readers.wav_header("content").alias("h"), readers.content_key("content").alias("k")).collect()
    assert len(row) == 1 and row[0]["h"]["sample_rate"] == 16000 and len(row[0]["k"]) == 64
    every = spark.read.format("binaryFile").load(str(tmp_path))
    assert readers.finished_downloads(every, "v").count() == 0


def test_turns_and_models(spark):
    rows = spark.createDataFrame([(1, '{"turns":[{"start":0.1,"end":1,"speaker":3}]}')], "transcript_id long, j string").withColumn("turns", readers.parse_turns("j"))
    assert readers.explode_turns(rows).first()["speaker"] == 3
    text = "{ id: 'auto', modelId: '__auto__' }, { id: 'a', modelId: 'x/y' }"
    assert [r[0] for r in readers.model_list(spark.createDataFrame([(text,)], "value string")).collect()] == ["x/y"]
    assert tuple(spark.range(1).select(readers.video_metadata(F.lit('{"title":"t","duration":12.7}')).alias("v")).first()["v"]) == ("t", 12)


def test_supersession_batch_and_stream_agree(spark, tmp_path):
    rows = [("s", i, r) for i, r in enumerate([1, 1, 2, 1, 2, 3, 2])] + [("t", 9, 5)]
    batch = spark.createDataFrame(rows, "session string, seq long, run_id long")
    want = sorted((r["session"], r["seq"]) for r in jobs.current_runs(batch).collect())
    assert want == [("s", 0), ("s", 1), ("s", 2), ("s", 4), ("s", 5), ("t", 9)]
    batch.where("seq < 3 or seq = 9").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    batch.where("seq >= 3 and seq < 9").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = jobs.current_runs_stream(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 90  # a query with timers never idles, so wait for the rows
    while time.time() < until and spark.table("kept").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert sorted((r["session"], r["seq"]) for r in spark.table("kept").collect()) == want


def test_job_events(spark):
    e = spark.createDataFrame([("a", 1, "downloading", 0.0), ("a", 2, "ready", 0.3), ("a", 3, "failed", 0.3), ("a", 4, "ready", 0.9), ("b", 1, "extracting", 0.01)], "job_id string, seq long, status string, progress double")
    assert {r["job_id"]: (r["settled"], r["status"], r["events"]) for r in jobs.terminal_states(e).collect()} == {"a": (3, "failed", 3), "b": (None, None, 1)}
    assert sorted((r["job_id"], r["seq"]) for r in jobs.bad_transitions(e).collect()) == [("a", 2), ("a", 4)]
    assert jobs.until_terminal(e).count() == 4
    assert [r["seq"] for r in jobs.throttle(e).where("job_id = 'a'").orderBy("seq").collect()] == [2, 4]
    pieces = spark.createDataFrame([(1, 0, 2, "b"), (1, 0, 1, "a")], "run_id long, window_idx int, seq long, text string")
    assert jobs.open_window_text(pieces).first()["text"] == "ab"


def test_throttle_and_previews_over_streams(spark, tmp_path):
    steps = spark.createDataFrame([(k, i, (i * 37 % 101) / 101) for k in ("a", "b") for i in range(60)], "job_id string, seq long, progress double")
    want = sorted((r["job_id"], r["seq"]) for r in jobs.throttle(steps).collect())
    steps.where("seq < 25").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    steps.where("seq >= 25").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = jobs.throttle_stream(stream).writeStream.format("memory").queryName("passed").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 90
    while time.time() < until and spark.table("passed").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert want and sorted((r["job_id"], r["seq"]) for r in spark.table("passed").collect()) == want
    shown = jobs.previews(stream, "job_id").writeStream.outputMode("complete").format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    shown.awaitTermination(90)
    assert sorted((r["job_id"], r["seq"]) for r in spark.table("shown").collect()) == [("a", 59), ("b", 59)]


def test_publish_writes_each_snapshot_once_even_on_a_retry(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "job_id string, seq long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for checkpoint in ("c", "again"):  # a lost checkpoint replays the batch
        q = jobs.publish(stream, str(tmp_path / "out"), str(tmp_path / checkpoint))
        q.processAllAvailable()
        q.stop()
    for topic in ("all", "by_job"):
        assert sorted((r["job_id"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out" / topic)).collect()) == [("a", 1), ("a", 3), ("b", 2)]


def test_errors_are_errors(spark):
    run = lambda df: df.collect()
    turns = spark.createDataFrame([(1, [(0.0, 1.0, -1)])], "transcript_id long, turns array<struct<start:float,end:float,speaker:int>>")
    request = spark.createDataFrame([("nothing", True, 8.0, 8, "transcribe", "en")], "preset_id string, gpu boolean, memory_gib double, cores int, task string, language string")
    seg = "array<struct<start:double,end:double,text:string,speaker:string>>"
    recipe = "source_id long, model_id string, task string, language string"
    work = spark.createDataFrame([("j", 1, "m", "transcribe", "en", "ready", 0.5, None, None)], f"id string, {recipe}, status string, progress double, error string, full_text string")
    other = spark.createDataFrame([("j", 1, "m2", "transcribe", "en", "t", None, 1)], f"job_id string, {recipe}, full_text string, segments {seg}, seq long")
    stored = spark.createDataFrame([], f"{recipe}, full_text string, segments {seg}")
    names = spark.createDataFrame([], "source_id long, speaker_key string, display_name string")
    for wrong, message in ((readers.explode_turns(turns), "negative speaker"), (config.resolve_models(request), "no such preset"), (store.persist_transcripts(stored, work, names, other)["transcripts"], "does not match the recipe")):
        with pytest.raises(Exception, match=message):
            run(wrong)


def test_tables_can_start_empty(spark):
    tables = {name: spark.createDataFrame([], schema) for name, schema in store.SCHEMAS.items()}
    assert [len(t.columns) for t in tables.values()] == [11, 9, 17, 4]
    new = spark.createDataFrame([("file", "k", None, "f.mp3", 3)], "source_type string, source_key string, canonical_url string, filename string, size_bytes long").withColumn("at", F.lit("2025-01-01").cast("timestamp"))
    assert [(r["id"], r["filename"]) for r in store.upsert_sources(tables["sources"], new).collect()] == [(1, "f.mp3")]
