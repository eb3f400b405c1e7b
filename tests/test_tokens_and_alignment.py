"""Time repair, token folding and speaker alignment on hand-written rows and against a plain loop."""

import random

from pyspark.sql import functions as F

from lectern.functions import timing as C
from lectern.operators import align, tokens

WORD = "transcript_id long, pos long, text string, start double, end double, speaker string"


def test_open_ends(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.0, None), (1, 1, "b", 4.2, None)], "transcript_id long, pos long, text string, start double, end double")
    assert [r["end"] for r in tokens.chunk_segments(rows).orderBy("pos").collect()] == [4.2, 6.2]
    assert [r["end"] for r in tokens.chunk_segments(rows, F.lit(9.75)).orderBy("pos").collect()] == [4.2, 9.75]


def test_continuations_and_glued_words(spark):
    words = [(1, 0, " state", 0.0, 0.4, None), (1, 1, "-of", 0.4, 0.5, None), (1, 2, " ", 0.5, 0.6, None), (1, 3, " wait...what", 0.6, 1.8, None), (1, 4, "光", 1.8, 2.0, None)]
    got = tokens.normalise_words(spark.createDataFrame(words, WORD)).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["state-of", "wait.", ".", ".", "what", "光"]
    assert got[0]["end"] == 0.5 and abs(got[1]["start"] - 0.6) < 1e-9
    assert all(b["start"] >= a["end"] - 1e-9 for a, b in zip(got, got[1:])) and all(r["end"] - r["start"] >= 0.01 - 1e-9 for r in got)


def test_clamp_equals_the_loop(spark):
    random.seed(5)
    rows = [(1, i, "w", random.uniform(0, 9), random.uniform(0, 9), None) for i in range(200)]
    got = tokens.clamp(spark.createDataFrame(rows, WORD).withColumn("part", F.lit(0))).orderBy("pos").collect()
    end = None
    for r, (_, _, _, s, e, _) in zip(got, rows):
        s = s if end is None else max(s, end)
        end = max(e, s + 0.01)
        assert abs(r["start"] - s) < 1e-9 and abs(r["end"] - end) < 1e-9


def test_densify(spark):
    rows = spark.createDataFrame([(1, s) for s in (0, 3, 0, 3)], "transcript_id long, speaker int")
    got = tokens.densify(rows).orderBy("speaker").collect()
    assert [r["dense_speaker"] for r in got] == [0, 0, 1, 1] and {r["speaker_count"] for r in got} == {2}


def assign(items, turns):
    out = {}
    for pos, s, e in items:
        best = None
        for idx, ts, te, sp in turns:
            o = max(0.0, min(e, te) - max(s, ts))
            g = s - te if s >= te else ts - e if ts >= e else 0.0
            if best is None or (-o, g, idx) < best[0]:
                best = (-o, g, idx), sp
        out[pos] = best and best[1]
    return out


def test_alignment_equals_the_loop_both_ways(spark):
    random.seed(9)
    items, turns = [], []
    for i in range(120):
        s = random.randint(0, 400) / 4
        items.append((i, s, s + random.choice([0, 0.25, 1, 5])))
    for i in range(25):
        s = random.randint(0, 400) / 4
        turns.append((i, s, s + random.choice([0, 0.25, 2, 8]), random.randint(0, 3)))
    left = spark.createDataFrame([(1, *i) for i in items] + [(2, *items[0])], "transcript_id long, pos long, start double, end double")
    right = spark.createDataFrame([(1, *t) for t in turns], "transcript_id long, idx int, start double, end double, speaker int")
    want = assign(items, turns)
    for f in (align.assign_speakers, lambda a, b: align.assign_speakers(a, b, 7.0)):
        got = {(r["transcript_id"], r["pos"]): r["speaker_id"] for r in f(left, right).collect()}
        assert len(got) == 121 and got[(2, 0)] is None
        assert {p: got[(1, p)] for p, _, _ in items} == want


def test_time_formats(spark):
    values = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert values(C.timestamp(F.lit(4.995))) == "00:00:04,995" and values(C.timestamp(F.lit(1.001))) == "00:00:01,000" and values(C.timestamp(F.lit(360000.5), ".")) == "100:00:00.500"
    assert values(C.banner_duration(F.lit("  Duration: 00:07:30.05, start"))) == 450.05 and values(C.banner_duration(F.lit("Duration: N/A,"))) is None
    assert values(C.progress_position(F.lit("out_time=00:00:12.500000"))) == 12.5
    assert values(C.round3(F.lit(-0.0005))) == 0.0 and values(C.clock(F.lit(3661))) == "01:01:01"
    assert values(C.progress_fraction(F.lit(5.0), F.lit(0.0))) is None and values(C.progress_fraction(F.lit(5.0), F.lit(2.0))) == 1.0
