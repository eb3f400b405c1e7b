"""Cues and caption files on hand-written transcripts."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import cues, export, tokens
from lectern.streaming import jobs

SEG = "transcript_id long, pos long, text string, start double, end double, speaker string"
WORD = SEG
TURN = "transcript_id long, idx int, start double, end double, speaker int"


def segs(spark, *rows):
    return spark.createDataFrame([(1, i, t, float(s), float(e), None) for i, (s, e, t) in enumerate(rows)], SEG)


def shown(df):
    return [(r["start"], r["end"], r["text"], r["speaker"]) for r in df.orderBy("pos").collect()]


def test_repeated_words_of_overlapping_segments(spark):
    got = shown(cues.tokens_from_segments(segs(spark, (0, 4, "red blue green amber white black brown kilo"), (3.5, 8, "kilo pink grey"))))
    assert [g[2] for g in got].count("kilo") == 1
    got = shown(cues.tokens_from_segments(segs(spark, (0, 4, "say kilo"), (4, 8, "kilo again"))))
    assert [g[2] for g in got].count("kilo") == 2


def test_cues_end_at_limits_not_at_segments(spark):
    got = shown(cues.consolidate(segs(spark, (0, 7.2, "lanterns along the river glow."), (7.2, 11, "the ferry departs."))))
    assert [g[2] for g in got] == ["Lanterns along the river", "glow. the ferry departs."]


def words(spark, *texts, step=0.5):
    return spark.createDataFrame([(1, i, " " + t, i * step, (i + 1) * step, None) for i, t in enumerate(texts)], WORD)


def test_speaker_changes_cut_cues(spark):
    turns = spark.createDataFrame([(1, 0, 0.0, 2.5, 0), (1, 1, 2.5, 4.0, 1)], TURN)
    none = segs(spark)
    times = [0, 0.5, 1, 1.5, 2, 2.5, 2.9, 3.3, 3.6, 4.0]
    w = spark.createDataFrame([(1, i, " " + t, times[i] * 1.0, times[i + 1] * 1.0, None) for i, t in enumerate("and where did we put those keys last night".split())], WORD)
    got = shown(cues.consolidate(none, w, turns))
    assert [(g[1], g[2], g[3]) for g in got][0] == (2.5, "And where did we put", "SPEAKER_00") and len(got) == 2 and got[1][3] == "SPEAKER_01"
    got = shown(cues.consolidate(segs(spark, (0, 4, "red blue green amber white black brown grey")), None, turns))
    assert {g[3] for g in got} == {"SPEAKER_00"}


def test_short_words_of_two_speakers_stay_apart(spark):
    rows = spark.createDataFrame([(1, 0, "yes", 0.0, 0.5, "A"), (1, 1, "no", 0.5, 1.0, "B")], SEG)
    assert [g[2:] for g in shown(cues.consolidate(rows))] == [("Yes", "A"), ("no.", "B")]


def test_invariants_on_all_test_conversations(spark, sf_dir):
    from lectern.plans import derived as D

    rows = D.seconds(D.segments_ms(spark, sf_dir))
    out = cues.consolidate(rows.drop("speaker")).collect()
    by = {}
    for r in out:
        by.setdefault(r["transcript_id"], []).append(r)
    assert len(by) == rows.select("transcript_id").distinct().count()
    for cs in by.values():
        cs.sort(key=lambda r: r["pos"])
        assert all(a["end"] <= b["start"] + 1e-9 for a, b in zip(cs, cs[1:]))
        assert all(len(line) <= 78 for c in cs for line in c["text"].split("\n"))


def test_full_text_and_hidden_tail(spark):
    c = spark.createDataFrame([(1, 0, "Good morning\nneighbours.", 0.0, 1.0, None), (1, 1, "and", 1.0, 2.0, None)], SEG)
    assert cues.full_text(c).first()["full_text"] == "Good morning neighbours. and"
    assert cues.hide_short_tail(c).count() == 1
    fallback = spark.createDataFrame([(1, "w"), (2, "x")], "transcript_id long, worker_text string")
    assert {r[0]: r[1] for r in cues.full_text(c, fallback).collect()} == {1: "Good morning neighbours. and", 2: "x"}


@pytest.fixture
def two(spark):
    return spark.createDataFrame([(1, 0, "Good morning.", 0.0, 3.25, "SPEAKER_00"), (1, 1, "well, is it raining?", 3.25, 7.0, "SPEAKER_01")], SEG)


def test_files(spark, two):
    doc = lambda fmt, rows=two: export.export(rows, fmt).first()["document"]
    assert doc("srt") == "1\n00:00:00,000 --> 00:00:03,250\n[SPEAKER_00]: Good morning.\n\n2\n00:00:03,250 --> 00:00:07,000\n[SPEAKER_01]: well, is it raining?\n"
    assert doc("vtt").startswith("WEBVTT\n\n1\n00:00:00.000 --> 00:00:03.250\n<v SPEAKER_00>Good morning.</v>\n")
    assert doc("txt") == "[SPEAKER_00]: Good morning.\n\n[SPEAKER_01]: Well, is it raining?"
    whole = json.loads(doc("json"))
    assert whole["segments"][1] == {"start": 3.25, "end": 7, "text": "well, is it raining?", "speaker": "SPEAKER_01"} and whole["speakerNames"] == {}
    plain = two.withColumn("speaker", F.lit(None).cast("string"))
    assert doc("json", plain).startswith('[\n  {\n    "start": 0,\n    "end": 3.25,\n') and "[" not in doc("srt", plain)
    hostile = two.withColumn("display", F.lit("A\n\n1\n00:00 <b>&"))
    assert "[A100:00 <b>&]: " in doc("srt", hostile) and "<v A100:00 &lt;b&gt;&amp;>" in doc("vtt", hostile)
    assert export.export(two.withColumn("text", F.lit(" \n")), "srt").count() == 0


def test_names_and_caption_files(spark, two, tmp_path):
    names = spark.createDataFrame([(1, {"SPEAKER_00": 'An "n"'})], "transcript_id long, names map<string,string>")
    shown = {fmt: export.export(two, fmt, str(tmp_path), names).first()["document"] for fmt in export.FORMATS}
    assert '[An "n"]: Good morning.' in shown["txt"] and "[SPEAKER_01]" in shown["srt"] and '<v An "n">' in shown["vtt"]
    assert json.loads(shown["json"])["speakerNames"] == {"SPEAKER_00": 'An "n"'} and json.loads(shown["json"])["segments"][0]["speaker"] == "SPEAKER_00"
    export.export(two, "srt", str(tmp_path), names)  # again, as a retry would
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["1.json", "1.srt", "1.txt", "1.vtt"]
    assert {fmt: (tmp_path / f"1.{fmt}").read_text() for fmt in shown} == shown and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_json_numbers_and_strings(spark):
    rows = spark.createDataFrame([(1, 0, 'a "b" \\ /\n\t é😀', 0.001, 12345678.5, None), (1, 1, "x", 3.0, 0.1 + 0.2, None)], SEG)
    document = export.export(rows, "json").first()["document"]
    assert json.loads(document) == [{"start": 0.001, "end": 12345678.5, "text": 'a "b" \\ /\n\t é😀'}, {"start": 3, "end": 0.1 + 0.2, "text": "x"}] and '"start": 3,' in document and "E" not in document


def test_runs_treat_null_as_equal(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([None, None, "A", "A", None])], "transcript_id long, pos long, speaker string")
    assert [r["run"] for r in tokens.speaker_runs(rows).orderBy("pos").collect()] == [1, 1, 2, 2, 3]


def test_folds_go_on_from_batch_to_batch(spark):
    """Whatever the size of the batches, and with keys that are null or numbers, the folds give the same."""
    rows = [(k, i, f"word{i % 7} and more of it", float(i), i + 0.9, None) for k in (None, 1, 2) for i in range(40)]
    segments = spark.createDataFrame(rows, "transcript_id long, pos long, text string, start double, end double, speaker string")
    want = sorted(map(repr, cues.consolidate(segments).collect()))
    steps = spark.createDataFrame([(k, i, (i * 37 % 101) / 101) for k in (None, 1, 2) for i in range(100)], "job_id long, seq long, progress double")
    passed = sorted(map(repr, jobs.throttle(steps).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert want and sorted(map(repr, cues.consolidate(segments).collect())) == want
        assert passed and sorted(map(repr, jobs.throttle(steps).collect())) == passed
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert cues.consolidate(segments.limit(0)).count() == 0 and jobs.throttle(steps.limit(0)).count() == 0
