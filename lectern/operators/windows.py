"""Decode windows: what a recogniser that reads long audio in overlapping windows makes of timed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timing import WINDOW, window_span


def of_time(words: DataFrame, length: float = WINDOW[0], stride: float = WINDOW[1]) -> DataFrame:
    """``words`` (transcript_id, pos, text, start, end) once for each window that they start in, with its number ``k``.

    Windows of ``length`` begin every ``length`` less twice the ``stride``, so one word lies in a bounded number of them. The
    last window of a transcript is the first that reaches its end.
    """
    step = length - 2 * stride
    if step <= 0:
        raise ValueError("a window has to be longer than twice the stride")
    total = F.max("end").over(Window.partitionBy("transcript_id"))
    first = F.greatest(F.lit(0), F.floor((F.col("start") - length) / step) + 1)
    last = F.least(F.floor(F.col("start") / step), F.greatest(F.lit(0), F.ceil((F.col("_total") - length) / step)))
    return words.withColumn("_total", total).withColumn("k", F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long")))).drop("_total")


def decode(words: DataFrame, length: float = WINDOW[0], stride: float = WINDOW[1]) -> DataFrame:
    """Segments (transcript_id, pos, text, start, end, window_start, window_end), one for each window that holds words.

    Neighbours repeat what is said where they overlap; ``cues.tokens_from_segments`` takes that out again. Times are those of
    the first and last word; the window's own span is what a preview shows before they are known.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text", "start", "end")))
    held = of_time(words, length, stride).groupBy("transcript_id", "k").agg(ordered.alias("w"))
    span = window_span("k", length, stride)
    return held.select(
        "transcript_id", F.col("k").alias("pos"), T.join_all(F.col("w.text")).alias("text"), F.col("w")[0]["start"].alias("start"), F.array_max("w.end").alias("end"),
        span["start"].alias("window_start"), span["end"].alias("window_end"))
