"""Text functions on hand-written vectors, and the column forms against the plain-Python forms."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar as S
from lectern.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize("raw, expected", [
    ("  a   b \n c ", "a b c"), ("hello , world", "hello, world"), ("one.two", "one. two"), ("3.14", "3.14"), ("10:30", "10:30"), ("U.S.A", "U.S.A"), ("No.one", "No. one"), ("wait...what", "wait. . . what"),
    ("a!?b", "a! ? b"), ("i think i'm in", "I think I'm in"), ("éi", "éI"), ('he said."x"', 'he said."x"'), (" a　b", "a b"), ("", ""),
])
def test_clean(spark, raw, expected):
    assert one(spark, raw, T.clean) == expected == S.clean(raw)


def test_words_and_joins(spark):
    assert one(spark, "光合作用。 ok then", T.word_count) == 7 == S.word_count("光合作用。 ok then")
    assert one(spark, "Été d'été!", T.normalise_word) == "td't"
    rows = spark.createDataFrame([("a", "b"), ("", "b"), ("a", ""), ("光", "合"), ("a", "光")], "l string, r string")
    assert [r[0] for r in rows.select(T.join_pair("l", "r")).collect()] == ["a b", "b", "a", "光合", "a光"]


def test_sentence_marks(spark):
    for text, sentence, clause in (("end.", True, False), ('end."', True, False), ("go,", False, True), ("终。", True, False), ("x.\n", False, False)):
        assert one(spark, text, T.ends_sentence) is sentence and one(spark, text, T.ends_clause) is clause
    assert one(spark, "'twas", T.capitalise_first) == "'Twas" and one(spark, "123", T.capitalise_first) == "123"
    assert one(spark, "a b. c! d e? 1. f", T.capitalise_sentences) == "A b. C! D e? 1. F"
    assert [one(spark, x, T.terminator) for x in ("word", "能 ", "ไทย")] == [".", "。", ""]


def test_wrap_agrees_with_plain_python(spark):
    random.seed(2)
    texts = ["".join(random.choice(["a", "bb", "ccc", " ", " ", ",", "光", "。", "dddd "]) for _ in range(random.randint(0, 70))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.wrap("t").alias("w"), T.clean("t").alias("c"), T.word_count("t").alias("n")).collect()
    for r in rows:
        assert r["w"] == S.wrap(texts[r["i"]]) and r["c"] == S.clean(texts[r["i"]]) and r["n"] == S.word_count(texts[r["i"]])


def test_names_and_ids(spark):
    assert [one(spark, x, T.speaker_label, "long") for x in (7, 120)] == ["SPEAKER_07", "SPEAKER_120"]
    assert one(spark, "a<b>&\n", lambda c: T.escape_annotation(T.sanitise_name(c))) == "a&lt;b&gt;&amp;"
    assert tuple(one(spark, "  \x07 ", T.validated_name)) == (None, "blank")
    assert tuple(one(spark, "x" * 101, T.validated_name)) == (None, "too long")
    assert one(spark, "  ", T.normalise_language) == "auto" and one(spark, " EN ", T.normalise_language) == "en"
    assert one(spark, "m", T.model_alias) == "m_timestamped" and one(spark, "m_timestamped", T.model_alias) == "m" and one(spark, "_timestamped", T.model_alias) is None
    assert one(spark, "https://youtu.be/abcdefghijk?x=1", T.video_id) == "abcdefghijk" and one(spark, "https://youtu.be/short", T.video_id) is None
    assert one(spark, "a/b\\c.tar.gz", T.basename) == "c.tar.gz" and one(spark, "c.tar.gz", T.export_base_name) == "c.tar" and one(spark, "", T.export_base_name) == "transcript"
    row = spark.range(1).select(T.exit_message(F.lit(6), F.lit(None).cast("int"), F.lit(True)).alias("a"), T.exit_message(F.lit(None).cast("int"), F.lit(0), F.lit(False)).alias("b")).first()
    assert row["a"] == "the engine panicked (signal 6)" and row["b"] == "the engine ended with status 0"
