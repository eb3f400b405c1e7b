"""Decode windows, stitching of what they repeat, two granularities in one pass, cues by islands, very long spans."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar
from lectern.functions import text as T
from lectern.operators import align, cues, windows
from test_tokens_and_alignment import assign

WORD = "transcript_id long, pos long, text string, start double, end double"
SEG = WORD + ", speaker string"
TURN = "transcript_id long, idx int, start double, end double, speaker int"


def spoken(spark, texts, step=0.5, transcript=1):
    return spark.createDataFrame([(transcript, i, t, i * step, (i + 0.9) * step) for i, t in enumerate(texts)], WORD)


def test_every_word_is_in_the_windows_it_starts_in(spark):
    n, step, length, stride = 300, 0.5, 29.0, 5.0
    got = {r["pos"]: r for r in windows.decode(spoken(spark, [f"w{i}" for i in range(n)], step), length, stride).collect()}
    last = next(k for k in range(100) if k * 19 + length >= (n - 0.1) * step)
    assert sorted(got) == list(range(last + 1))
    for k, r in got.items():
        held = [i for i in range(n) if 19 * k <= i * step < 19 * k + length]
        assert r["text"].split() == [f"w{i}" for i in held]
        assert (r["start"], r["end"]) == (held[0] * step, (held[-1] + 0.9) * step) and (r["window_start"], r["window_end"]) == (19.0 * k, 19.0 * k + 29)
    assert windows.decode(spoken(spark, ["one", "two"])).count() == 1
    assert windows.decode(spoken(spark, ["one"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        windows.decode(spoken(spark, ["one"]), 10, 5)


def test_stitching_gives_back_what_the_windows_were_cut_from(spark):
    rng = random.Random(3)
    said = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    # seven seconds are shared: fourteen words, within the sixteen that are remembered
    decoded = windows.decode(spoken(spark, said), 29.0, 3.5).withColumn("speaker", F.lit(None).cast("string"))
    got = cues.tokens_from_segments(decoded).orderBy("pos").collect()
    assert [r["text"] for r in got] == said
    assert all(a["end"] <= b["start"] + 1e-9 for a, b in zip(got, got[1:]))
    counts = cues.overlap_cuts(decoded).first()
    assert counts["kept"] == 400 and counts["cut"] == counts["given"] - 400 > 100


def test_more_shared_words_than_are_remembered_stay(spark):
    said = [f"w{i}x" for i in range(100)]
    decoded = windows.decode(spoken(spark, said, 0.25), 10.0, 3.0).withColumn("speaker", F.lit(None).cast("string"))  # 24 words are shared
    assert cues.tokens_from_segments(decoded).count() > 130


def test_scripts_without_spaces_are_joined_and_never_cut_as_repetitions(spark):
    decoded = windows.decode(spoken(spark, ["光合", "作用", "是", "植物"] * 30), 20.0, 3.0).withColumn("speaker", F.lit(None).cast("string"))
    rows = decoded.orderBy("pos").collect()
    assert rows[0]["text"].startswith("光合作用是植物")
    assert cues.tokens_from_segments(decoded).count() == len(rows)
    assert cues.consolidate(decoded).orderBy(F.desc("pos")).first()["text"].endswith("。")


def test_two_granularities_in_one_pass(spark, tmp_path):
    rows = [(1, i, w, i * 0.5, i * 0.5 + 0.5, None) for i, w in enumerate("so what do you think of it all".split())]
    rows += [(2, 0, "so what do you think of it all", 0.0, 4.0, None), (3, 0, "kept as it was stored", 0.0, 2.0, "SPEAKER_09")]
    turns = [(t, i, a, b, s) for t in (1, 2, 4) for i, (a, b, s) in enumerate([(0.0, 2.4, 0), (2.4, 4.0, 1)])]
    spark.createDataFrame(rows, SEG).write.parquet(f"{tmp_path}/base")
    base, words = spark.read.parquet(f"{tmp_path}/base"), spark.createDataFrame([(4, i, " " + w, i * 0.5, i * 0.5 + 0.5, None) for i, w in enumerate("so what do you think of it all".split())], SEG)
    got = cues.consolidate(base, words, spark.createDataFrame(turns, TURN))
    shown = [(r["transcript_id"], r["text"], r["speaker"]) for r in got.orderBy("transcript_id", "pos").collect()]
    by_word = [("So what do you think", "SPEAKER_00"), ("of it all.", "SPEAKER_01")]
    assert [s[1:] for s in shown if s[0] == 1] == [s[1:] for s in shown if s[0] == 4] == by_word
    assert [s[1:] for s in shown if s[0] == 2] == [("So what do you think of it all.", "SPEAKER_00")]
    assert [s[1:] for s in shown if s[0] == 3] == [("Kept as it was stored.", "SPEAKER_09")]
    unmatched = align.label(align.assign_speakers(base.where("transcript_id = 3").drop("speaker"), spark.createDataFrame(turns, TURN)))
    assert unmatched.first()["speaker"] is None
    plan = cues.consolidate(base, None, spark.createDataFrame(turns, TURN))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 2  # one scan; one fold to tokens, one to cues


def test_islands_give_the_cues_of_one_fold(spark):
    rng = random.Random(8)
    texts = [rng.choice(["yes", "no, never", "so it goes.", "a rather longer stretch of words that fills a line", "光合作用", "and", "well; then"]) for _ in range(600)]
    rows, at = [], 0.0
    for i, t in enumerate(texts):
        span = rng.choice([0.3, 0.8, 1.5, 2.5])
        rows.append((1 if i < 400 else 2, i, t, at, at + span, rng.choice(["A", "A", "A", "B", None])))
        at += span
    said = spark.createDataFrame(rows, SEG)
    got = [(r["transcript_id"], r["pos"], r["start"], r["end"], r["speaker"], r["text"].lower().rstrip(".。")) for r in cues.cues_from_tokens(said).orderBy("transcript_id", "pos").collect()]
    want = []
    for t in (1, 2):
        held = [dict(zip("transcript_id pos text start end speaker".split(), r)) for r in rows if r[0] == t]
        want += [(t, i, c[0], c[1], c[3], c[2].lower().rstrip(".。")) for i, c in enumerate(cues.merge_cues(cues.cut_cues(iter(held))))]
    assert got == want


def test_islands_of_one_transcript_are_folded_in_several_tasks(spark):
    rows = [(1, i, f"w{i}", i * 1.0, i + 1.0, "AB"[i // 5 % 2]) for i in range(400)]
    seen = cues.tokens.speaker_runs(spark.createDataFrame(rows, SEG)).repartition(4, "transcript_id", "run").select(F.spark_partition_id().alias("p")).distinct().count()
    assert seen == 4


def test_spans_far_too_long_for_buckets(spark):
    rng = random.Random(4)
    items = [(i, s := rng.randint(0, 4000) / 4, s + rng.choice([0, 0.25, 3, 40, 5000])) for i in range(150)] + [(150, 10.0, 1e12), (151, 5e11, 6e11)]
    turns = [(i, s := rng.randint(0, 4000) / 4, s + rng.choice([0, 1, 30, 2500, 200_000]), i % 4) for i in range(30)] + [(30, 900.0, 1e12, 7), (31, 2e12, 3e12, 8)]
    left = spark.createDataFrame([(1, *i) for i in items], "transcript_id long, pos long, start double, end double")
    right = spark.createDataFrame([(1, *t) for t in turns], TURN)
    want = assign(items, turns)
    for bucket in (30.0, 0.5):
        assert {r["pos"]: r["speaker_id"] for r in align.assign_speakers(left, right, bucket).collect()} == want


def test_items_that_do_not_seek_ride_along(spark):
    left = spark.createDataFrame([(1, 0, 0.0, 1.0, True, "a"), (1, 1, 0.0, 1.0, False, None), (2, 0, 0.0, 1.0, True, "c")], "transcript_id long, pos long, start double, end double, ask boolean, x string")
    right = spark.createDataFrame([(1, 0, 0.0, 5.0, 3)], TURN)
    got = align.assign_speakers(left, right, seeks="ask").orderBy("transcript_id", "pos").collect()
    assert [(r["x"], r["speaker_id"]) for r in got] == [("a", 3), (None, None), ("c", None)]


def test_lines_are_measured_in_utf16_units(spark):
    texts = ["𝄞" * 20 + " " + "𝄞" * 3, "a" * 20 + " 𝄞𝄞𝄞𝄞𝄞𝄞𝄞𝄞𝄞𝄞𝄞 " + "b" * 8, "c" * 30 + " " + "d" * 12, "𝄞 " * 15 + "word and more", "光𝄞合" * 14]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.wrap("t").alias("w"), T.units("t").alias("n")).collect()
    for r in got:
        assert r["w"] == scalar.wrap(texts[r["i"]]) and r["n"] == scalar.length(texts[r["i"]])
    assert "\n" in next(r["w"] for r in got if r["i"] == 0)


def test_words_without_a_time_leave_and_segments_take_their_place(spark):
    base = spark.createDataFrame([(1, 0, "from the segment", 0.0, 2.0, None), (2, 0, "from the segment", 0.0, 2.0, None)], SEG)
    words = spark.createDataFrame([(1, 0, " timed", 0.0, 1.0, None), (1, 1, " lost", None, 1.5, None), (1, 2, " words", 1.0, 2.0, None), (2, 0, " never", None, None, None)], SEG)
    assert [r["text"] for r in cues.consolidate(base, words).orderBy("transcript_id").collect()] == ["Timed words.", "From the segment."]
    assert [(r["transcript_id"], r["text"]) for r in cues.rows_to_persist(base, words).orderBy("transcript_id", "pos").collect()] == [(1, "timed"), (1, "words"), (2, "from the segment")]
