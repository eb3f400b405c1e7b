"""Speakers for timed items: the turn of largest overlap, else the nearest, the first in input order on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timing as C

#: Width in time units of the buckets that bound the overlap join of long transcripts.
BUCKET = 30.0
#: A span of more than so many buckets registers in buckets that are so many times as wide, then in one for the transcript.
FAN = 64


def _grids(start: Column, end: Column, bucket: float) -> tuple[Column, Column]:
    """(own, wider): the cells (level, number) that a span registers in, by its length, and those of wider grids that it lies in.

    Level 0 has buckets of ``bucket``, level 1 of ``FAN`` times that, level 2 has one. No span has more than ``FAN`` + 1 own cells.
    """
    last = F.greatest(start, end)
    at = lambda level, x: F.floor(x / (bucket * FAN**level)).cast("long")
    upto = lambda level: F.least(at(level, last), at(level, start) + FAN)
    cells = lambda level: F.transform(F.sequence(at(level, start), upto(level)), lambda b: F.struct(F.lit(level).alias("l"), b.alias("b")))
    whole = F.array(F.struct(F.lit(2).alias("l"), F.lit(0).cast("long").alias("b")))
    narrow, middle = last - start <= bucket * (FAN - 1), last - start <= bucket * FAN * (FAN - 1)
    own = F.when(narrow, cells(0)).when(middle, cells(1)).otherwise(whole)
    return own, F.when(narrow, F.concat(cells(1), whole)).when(middle, whole).otherwise(F.slice(whole, 1, 0))


def assign_speakers(items: DataFrame, turns: DataFrame, bucket: float = BUCKET, key: str = "transcript_id", pos: str = "pos", span: tuple[str, str] = ("start", "end"), seeks: str | None = None) -> DataFrame:
    """``items`` (key, pos, start, end, ...) with ``speaker_id`` of ``turns`` (key, idx, start, end, speaker); null without turns.

    ``pos`` tells the items of a key apart. ``span`` names an item's times; where the boolean column ``seeks`` is given, other items ride along without a speaker.

    The turn of largest overlap counts, else the one of the smaller gap, and the smaller ``idx`` where these are equal.
    Items and turns register in each time bucket they touch, so pairs that overlap or touch meet there, in one join;
    what is far too long for buckets (a wrong end time) registers on a wider grid, where the others look it up; a grid that
    holds no turn is not looked up. An item that meets nothing takes the nearer of the latest end before it and the earliest
    start after it, which running windows over the transcript's times find: turns and items sorted together. What the join
    finds and the turns themselves are dealt out by transcript once, for the aggregate and both windows.
    """
    t = turns.select(F.col(key), F.col("idx").cast("long").alias("_idx"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("speaker").alias("_sp"))

    def registered(rows: DataFrame, start: str, end: str, seeks: bool) -> DataFrame:
        """Rows with each cell they meet others in. ``own``: whose own cell that is, an item's or a turn's."""
        own, wider = _grids(F.col(start), F.col(end), bucket)
        tagged = lambda cells, mine: F.transform(cells, lambda c: F.struct(F.lit(mine).alias("own"), c["l"].alias("l"), c["b"].alias("b")))
        held = F.filter(wider, lambda c: F.array_contains("_levels", c["l"]))
        # a turn waits in its own cells for all items; an item on a wide grid waits there for turns on narrower ones
        cells = F.concat(tagged(own, "turn"), tagged(held, "turn"), tagged(F.filter(own, lambda c: c["l"] > 0), "item")) if seeks else F.concat(tagged(own, "turn"), tagged(wider, "item"))
        found = rows.select("*", F.posexplode_outer(cells).alias("_n", "_c")).select("*", "_c.own", "_c.l", "_c.b").drop("_c")
        # what an item carries goes along once
        return (found.withColumn("_row", F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_row"))).drop("_levels") if seeks else found).drop("_n")

    others = [c for c in items.columns if c not in (key, pos)]
    seeking = F.lit(True) if seeks is None else F.col(seeks)
    asking = items.select(key, pos, F.struct(*others).alias("_row"), F.when(seeking, F.col(span[0])).alias("_a"), F.when(seeking, F.col(span[1])).alias("_z"))
    levels = t.agg(F.collect_set(_grids(F.col("_s"), F.col("_e"), bucket)[0][0]["l"]).alias("_levels"))  # one row of at most three
    o = F.when(F.col("_s").isNotNull(), C.overlap("_a", "_z", "_s", "_e"))  # without a turn there is none: least and greatest pass over nulls
    touches = (o == 0) & (C.gap("_a", "_z", "_s", "_e") == 0)  # gaps of touching turns count as 0, also of a turn that holds an item without length, or is one
    # the items go through the join and come out of the aggregate whole, so that what made them runs once
    met = registered(asking.crossJoin(F.broadcast(levels)), "_a", "_z", True).join(registered(t, "_s", "_e", False), [key, "own", "l", "b"], "left")
    met = met.where(F.col("_row").isNotNull() | F.col("_s").isNotNull()).select(
        key, pos, "_row", F.when(o > 0, F.struct(o.alias("o"), (-F.col("_idx")).alias("i"), F.col("_sp").alias("sp"))).alias("_over"),
        F.when(touches, F.struct(F.lit(0.0).alias("g"), F.col("_idx").alias("i"), F.col("_sp").alias("sp"))).alias("_touch"))
    # the turns go along to where the searches for the nearest need them; a turn is a mark, an item asks
    marks = t.select(key, F.struct("_s", "_e", "_idx", "_sp").alias("_mark"))
    both = met.unionByName(marks, allowMissingColumns=True).repartition(key).groupBy(key, pos, "_mark").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.max("_over").alias("_over"), F.min("_touch").alias("_touch"))

    # one row a turn or item with the times that either search sorts by
    mark = lambda time, sign: F.when(F.col("_kind") == 0, F.struct((sign * F.col(f"_mark.{time}")).alias("t"), (-F.col("_mark._idx")).alias("i"), F.col("_mark._sp").alias("sp")))
    times = {"_at1": F.when(F.col("_kind") == 0, F.col("_mark._e")).otherwise(F.col("_row")[span[0]]), "_at2": -F.when(F.col("_kind") == 0, F.col("_mark._s")).otherwise(F.col("_row")[span[1]])}
    both = both.withColumn("_kind", F.col("_mark").isNull().cast("int")).withColumns(times | {"_m1": mark("_e", 1), "_m2": mark("_s", -1)})

    def before(n: str) -> Column:
        w = Window.partitionBy(key).orderBy(f"_at{n}", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        m = F.max(f"_m{n}").over(w)
        return F.when(m.isNotNull(), F.struct((F.col(f"_at{n}") - m["t"]).cast("double").alias("g"), (-m["i"]).alias("i"), m["sp"].alias("sp")))

    found = both.withColumns({"_earlier": before("1"), "_later": before("2")}).where("_kind = 1")
    nearest = F.least("_touch", "_earlier", "_later")["sp"]
    found = found.withColumn("speaker_id", F.when(F.col("_over").isNotNull(), F.col("_over.sp")).otherwise(nearest)).select(key, pos, "_row.*", "speaker_id")
    return (found.withColumn("speaker_id", F.when(F.col(seeks), F.col("speaker_id"))) if seeks else found).select(*items.columns, "speaker_id")


def label(items: DataFrame) -> DataFrame:
    """``speaker`` as ``SPEAKER_nn`` from ``speaker_id``, null where that is."""
    return items.withColumn("speaker", T.speaker_label("speaker_id")).drop("speaker_id")


def label_tokens(tokens: DataFrame, turns: DataFrame) -> DataFrame:
    """Tokens (transcript_id, pos, start, end, speaker, head, whole_start, whole_end, ...) with the labels of ``turns``.

    A token that stands for itself (``head``, no ``whole_start``) is matched by its own time. Of the tokens cut from one segment
    the first (``head``) is matched by the segment's time, and the others take its label. Where nothing is found the
    token's own speaker stays. Two granularities thus go through one assignment.
    """
    spans = {"_from": F.coalesce("whole_start", "start"), "_to": F.coalesce("whole_end", "end")}
    found = assign_speakers(tokens.withColumns(spans), turns, span=("_from", "_to"), seeks="head")
    since = Window.partitionBy("transcript_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what a head found may be null, so it goes along in a struct
    carried = F.last(F.when(F.col("head"), F.struct(T.speaker_label("speaker_id").alias("label"))), ignorenulls=True).over(since)["label"]
    return found.withColumn("speaker", F.coalesce(carried, "speaker")).drop("speaker_id", "_from", "_to")


def with_names(items: DataFrame, names: DataFrame, key: str = "source_id") -> DataFrame:
    """``display``: the stored name of a speaker of a source, else the label itself."""
    n = names.select(key, F.col("speaker_key").alias("speaker"), "display_name")
    return items.join(n, [key, "speaker"], "left").withColumn("display", F.coalesce("display_name", "speaker")).drop("display_name")


def talk_time(labelled: DataFrame, key: str = "transcript_id") -> DataFrame:
    return labelled.groupBy(key, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("talk"), F.count("*").alias("items"))
