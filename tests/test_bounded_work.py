"""What the steps of long inputs cost: work in proportion to the input, few rows dealt out."""

import time

from pyspark.sql import functions as F

from lectern.functions import scalar
from lectern.functions import text as T
from lectern.operators import align, cues, tokens


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") - plan.count("BroadcastExchange ")


def spoken(n: int) -> list[dict]:
    return [{"text": f"word{i}" + ("." if i % 9 == 8 else ""), "start": i * 0.3, "end": i * 0.3 + 0.25, "speaker": None} for i in range(n)]


def test_few_tokens_are_cleaned_to_find_where_a_cue_ends(monkeypatch):
    calls = []
    clean = scalar.clean
    monkeypatch.setattr(scalar, "clean", lambda t: calls.append(t) or clean(t))
    found = list(cues.merge_cues(cues.cut_cues(iter(spoken(900)))))
    assert " ".join(c[2].replace("\n", " ") for c in found).split() == [r["text"] for r in spoken(900)]
    assert len(calls) < 600  # one a token and more, before


def test_a_mark_that_needs_a_space_counts_towards_the_room():
    words = ["a.b,c" * 4, "d;e" * 8, "f!g" * 8, "h"]  # cleaned they are longer than joined
    assert all(scalar.length(scalar.clean(w)) <= scalar.most_clean(w) for w in words)
    assert scalar.length(scalar.clean(" ".join(words))) > 78 > scalar.length(" ".join(words))
    rows = [{"text": w, "start": i * 0.1, "end": i * 0.1 + 0.1, "speaker": None} for i, w in enumerate(words)]
    assert len(list(cues.cut_cues(iter(rows)))) == 2


def test_captions_of_segments_deal_out_no_tokens(spark):
    segments = spark.createDataFrame([(t, i, f"so it goes {i} now.", i * 2.0, i * 2.0 + 2.2) for t in range(3) for i in range(9)], "transcript_id long, pos int, text string, start double, end double")
    own = cues.consolidate(segments)
    parts = cues.cues_from_tokens(cues.tokens_from_segments(segments.withColumn("speaker", F.lit(None).cast("string"))))
    assert exchanges(own) < exchanges(parts)
    assert sorted(map(str, own.collect())) == sorted(map(str, parts.select(own.columns).collect()))


def test_joining_long_arrays_takes_one_pass(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("a"))
    began = time.time()
    assert row.select(T.join_all("a").alias("j")).first()["j"] == " ".join(f"w{i}" for i in range(1, 30_001))
    assert time.time() - began < 20
    cases = [(["", "a", "", "光", "b", "", "c"], "a光b c"), ([], ""), (["", ""], ""), (["a", None], None), (None, None), (["กข", "x"], "กขx")]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a array<string>").select("i", T.join_all("a").alias("j")).collect()
    assert {r["i"]: r["j"] for r in got} == {i: j for i, (_, j) in enumerate(cases)}


def test_overlap_cuts_reads_segments_once(spark):
    rows = [(1, 0, "one two three four", 0.0, 2.0), (1, 1, "three four five six", 1.5, 3.0), (2, 0, " ", 0.0, 1.0), (3, 0, None, 0.0, 1.0), (3, 1, "alone", 2.0, 1.0)]
    segments = spark.createDataFrame(rows, "transcript_id long, pos int, text string, start double, end double").withColumn("speaker", F.lit(None).cast("string"))
    found = cues.overlap_cuts(segments)
    assert found.columns == ["transcript_id", "given", "kept", "cut"]
    assert exchanges(found) <= 2  # the windows and the fold; four and more when tokens were counted apart
    assert sorted(map(tuple, found.collect())) == [(1, 8, 6, 2), (3, 1, 1, 0)]


def test_wrapping_asks_no_break_about_the_whole_text(spark):
    row = spark.range(1).select(F.repeat(F.lit("word and "), 1_500).alias("t"))
    began = time.time()
    wrapped = row.select(T.wrap("t").alias("w")).first()["w"]
    assert time.time() - began < 15
    first, second = wrapped.split("\n")
    assert abs(len(first) - len(second)) < 9 and f"{first} {second}" == ("word and " * 1_500).strip()


def test_whole_segments_are_labelled_before_they_are_cut(spark, monkeypatch):
    rows = [(t, p, f"and so we said {p} again", p * 3.0, p * 3.0 + 2.5 if (t, p) != (2, 1) else None) for t in range(3) for p in (0, 1, 1, 2)]
    rows += [(7, p, w, p * 0.4, p * 0.4 + 0.3) for p, w in enumerate("one word a row is timed".split())]
    segments = spark.createDataFrame(rows, "transcript_id long, pos int, text string, start double, end double").withColumn("speaker", F.lit("own"))
    turns = spark.createDataFrame([(0, 0, 0.0, 2.9, 3), (0, 1, 2.9, 9.0, 1), (2, 0, 1.0, 4.0, 5), (7, 0, 0.0, 1.0, 2), (7, 1, 1.0, 3.0, 4)], "transcript_id long, idx int, start double, end double, speaker int")
    before = cues.cues_from_tokens(cues.align.label_tokens(cues.tokens_from_segments(segments), turns))
    labelled = []
    label = cues.align.label_tokens
    monkeypatch.setattr(cues.align, "label_tokens", lambda tokens, turns: labelled.append(tokens) or label(tokens, turns))
    found = cues.consolidate(segments, turns=turns)
    assert sorted(map(str, found.collect())) == sorted(map(str, before.select(found.columns).collect()))
    rows = labelled[0].groupBy("transcript_id").count().collect()
    # whole segments of two; tokens of a transcript with a segment without an end, and of one with word times
    assert {r["transcript_id"]: r["count"] for r in rows} == {0: 4, 1: 4, 2: cues.tokens_from_segments(segments).where("transcript_id = 2").count(), 7: 6}


def test_words_are_normalised_by_one_sort(spark):
    rows = [(1, 0, "lead", 0.0, 0.2), (1, 1, "ing", 0.2, 0.5), (1, 2, " i", 0.4, 0.3), (1, 3, " ", 0.5, 0.6), (1, 4, " so,then go", 0.5, 1.7), (1, 5, "光", 1.6, 1.6), (1, 6, "合", 1.6, 1.9),
            (2, 0, " late", 5.0, 4.0), (2, 1, "-ly", None, 6.0), (2, 2, " none", None, None), (2, 3, " x\U0001f600 y", 7.0, 8.0), (3, 0, None, 1.0, 2.0), (4, 0, " a.b", None, None), (4, 1, "", 1.0, 2.0), (4, 2, " c", 1.0, None)]
    words = spark.createDataFrame(rows, "transcript_id long, pos int, text string, start double, end double").withColumn("speaker", F.concat(F.lit("s"), "pos"))
    found = tokens.normalise_words(words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan and "Window" not in plan
    parts = tokens.clamp(tokens.split_glued(tokens.fold_continuations(words)))
    assert found.schema.simpleString() == parts.schema.simpleString()
    assert sorted(map(str, found.collect())) == sorted(map(str, parts.collect())) and found.count() == 13


def test_items_are_dealt_out_for_the_join_and_once_more(spark):
    items = spark.createDataFrame([(1, i, f"w{i}", i * 1.0, i + 0.9) for i in range(50)] + [(2, 0, "far", 5.0, 6.0), (3, 0, "none", 0.0, 1.0)], "transcript_id long, pos long, text string, start double, end double")
    turns = spark.createDataFrame([(1, 0, 0.0, 20.0, 4), (1, 1, 19.5, 30.0, 5), (1, 2, 40.2, 44.0, 6), (2, 0, 9.0, 9.5, 7)], "transcript_id long, idx int, start double, end double, speaker int")
    wrong_end = spark.createDataFrame([(1, 3, 31.0, 9e6, 8), (2, 1, 5.5, 9e4, 9)], turns.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = align.assign_speakers(items, turns)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(") == 3  # items and turns for the join, and what it finds; four when aggregate and windows dealt out apart
        got = {(r["transcript_id"], r["text"]): r["speaker_id"] for r in found.collect()}
        long = {(r["transcript_id"], r["text"]): r["speaker_id"] for r in align.assign_speakers(items, turns.union(wrong_end)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 52 and got[1, "w3"] == 4 and got[1, "w19"] == 4 and got[1, "w29"] == got[1, "w34"] == 5 and got[1, "w36"] == got[1, "w49"] == 6
    assert got[2, "far"] == 7 and got[3, "none"] is None
    assert len(long) == 52 and long[1, "w34"] == long[1, "w49"] == 8 and long[1, "w41"] == 6 and long[1, "w3"] == 4 and long[2, "far"] == 9
