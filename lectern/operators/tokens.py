"""Token and segment times by windows over (transcript_id, pos): end repair, gluing, splitting, monotone clamp."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..functions import timing as C
from .fold import fold_rows


def win(order: str = "pos", key: str = "transcript_id") -> Window:
    return Window.partitionBy(key).orderBy(order)


def so_far(order: str = "pos", key: str = "transcript_id"):
    return win(order, key).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def end_fallback(start="start", end="end", duration=None, default=C.FALLBACK_CHUNK, w=None) -> Column:
    """An open end becomes the next start, else the media's duration, else a fixed span."""
    options = [F.col(end), F.lead(start).over(w if w is not None else win())]
    if duration is not None:
        options.append(F.col(duration) if isinstance(duration, str) else duration)
    return F.coalesce(*options, F.col(start) + default)


def effective_end(start: Column, end: Column, next_start: Column, n_words: Column) -> Column:
    """The end if it lies after the start, else the next start if that does, else a nominal span."""
    return F.when(end > start, end).when(next_start > start, next_start).otherwise(start + F.greatest(n_words * C.NOMINAL_WORD, F.lit(C.LEAST_CUE)))


def chunk_segments(chunks: DataFrame, duration=None) -> DataFrame:
    """Worker chunks (transcript_id, pos, text, start, end nullable) with every end filled."""
    return chunks.withColumn("end", end_fallback(duration=duration))


def decoded_words(words: DataFrame) -> DataFrame:
    """Words without a time leave; the text of the transcript keeps them."""
    return words.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def fold_continuations(words: DataFrame) -> DataFrame:
    """Word pieces that begin without white space join the word in front, unless their script writes without spaces."""
    opens = F.col("text").rlike(f"^{T.SPACE}") | T.starts_without_space("text")
    rows = words.withColumn("_opens", opens).withColumn("text", T.trim_space("text")).where("text <> ''")
    rows = rows.withColumn("_opens", F.col("_opens") | (F.row_number().over(win()) == 1)).withColumn("_island", F.sum(F.col("_opens").cast("int")).over(so_far()))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text", "start", "end", "speaker")))
    groups = rows.groupBy("transcript_id", "_island").agg(parts.alias("p"))
    return groups.select(
        "transcript_id", F.col("p")[0]["pos"].alias("pos"), F.array_join(F.col("p.text"), "").alias("text"),
        F.col("p")[0]["start"].alias("start"), F.array_max("p.end").alias("end"), F.col("p")[0]["speaker"].alias("speaker"))


def split_glued(words: DataFrame) -> DataFrame:
    """One row a word of the cleaned text, with its share of the time by characters; ``part`` orders them."""
    rows = words.withColumn("w", T.split_words("text")).select("*", F.posexplode("w").alias("part", "word")).withColumn("weight", T.char_weight("word"))
    token = Window.partitionBy("transcript_id", "pos")
    through = F.sum("weight").over(token.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"total": F.sum("weight").over(token), "through": through, "span": F.greatest(F.col("end") - F.col("start"), F.lit(0.0))})
    at = lambda weight: F.col("start") + weight / F.col("total") * F.col("span")
    single = F.size("w") == 1
    return rows.select(
        "transcript_id", "pos", "part", F.col("word").alias("text"), F.when(single, F.col("start")).otherwise(at(F.col("through") - F.col("weight"))).alias("start"),
        F.when(single, F.col("end")).otherwise(at(F.col("through"))).alias("end"), "speaker")


def monotone_end(start: Column, end: Column, order: str = "pos", key: str = "transcript_id", least: float = C.LEAST_WORD) -> Column:
    """Ends of spans that start at or after the previous end and last ``least`` or more: a running maximum in closed form."""
    w = win(order, key)
    i = F.row_number().over(w)
    return least * i + F.max(F.greatest(end, start + least) - least * i).over(so_far(order, key))


def clamp(words: DataFrame) -> DataFrame:
    """``monotone_end`` over all words of each transcript; ``pos`` is renumbered from 0."""
    rows = words.withColumn("pos", F.row_number().over(Window.partitionBy("transcript_id").orderBy("pos", "part")) - 1).drop("part")
    rows = rows.withColumn("_end", monotone_end(F.col("start"), F.col("end")))
    return rows.withColumn("start", F.greatest("start", F.coalesce(F.lag("_end").over(win()), F.col("start")))).withColumn("end", F.col("_end")).drop("_end")


def normalise_words(words: DataFrame) -> DataFrame:
    """Words (transcript_id, pos, text, start, end, speaker) as clean single-word tokens in time order.

    ``clamp`` of ``split_glued`` of ``fold_continuations`` in one pass over the words of a transcript in order, which remembers one
    word and the last end: one sort, whatever the length.
    """
    opens = F.col("text").rlike(f"^{T.SPACE}") | T.starts_without_space("text")
    rows = words.withColumn("opens", opens).withColumn("text", T.trim_space("text")).where("text <> ''")
    kinds = [("text", "string", pa.string()), ("start", "double", pa.float64()), ("end", "double", pa.float64()), ("speaker", "string", pa.string())]
    found = fold_rows(rows.select("transcript_id", "pos", "text", "start", "end", "speaker", "opens"), whole_words, kinds)
    return found.withColumn("pos", F.col("pos").cast("int"))


def whole_words(rows: Iterator[dict]) -> Iterator[tuple]:
    """(text, start, end, speaker) of word pieces (text, start, end, speaker, opens)."""
    i, least, ended = 0, None, None
    for text, start, end, speaker in _islands(rows):
        for word, begin, until in _shares(text, start, end):
            i += 1
            least = _most(least, None if (e := _most(until, None if begin is None else begin + C.LEAST_WORD)) is None else e - C.LEAST_WORD * i)
            begin, ended = _most(begin, ended), None if least is None else C.LEAST_WORD * i + least
            yield word, begin, ended, speaker


def _islands(rows: Iterator[dict]) -> Iterator[tuple]:
    held = None
    for r in rows:
        if held is None or r["opens"]:
            if held:
                yield "".join(held[0]), *held[1:]
            held = [[r["text"]], r["start"], r["end"], r["speaker"]]
        else:
            held[0].append(r["text"])
            held[2] = _most(held[2], r["end"])
    if held:
        yield "".join(held[0]), *held[1:]


def _shares(text: str, start: float | None, end: float | None) -> Iterator[tuple]:
    plain = text.isascii() and text.isalnum() and text != "i"
    words = [text] if plain else [w for w in S.clean(text).split(" ") if w]
    if len(words) == 1:
        yield words[0], start, end
        return
    weights = [max(S.length(w), 1) for w in words]
    total, through, span = sum(weights), 0, 0.0 if start is None or end is None else max(end - start, 0.0)
    at = lambda weight: None if start is None else start + weight / total * span
    for word, weight in zip(words, weights):
        through += weight
        yield word, at(through - weight), at(through)


def _most(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None or a >= b else b


def overlaps_before(start="start", end="end", w=None) -> Column:
    """Whether a row starts before the end of the one in front."""
    return F.coalesce(F.col(start) < F.lag(end).over(w if w is not None else win()), F.lit(False))


def densify(turns: DataFrame, key: str = "transcript_id", speaker: str = "speaker") -> DataFrame:
    """Sparse speaker numbers as 0, 1, ... in ascending order, and the number of speakers."""
    dense = F.dense_rank().over(Window.partitionBy(key).orderBy(speaker)) - 1
    ranked = turns.withColumn("dense_speaker", dense)
    return ranked.withColumn("speaker_count", F.max("dense_speaker").over(Window.partitionBy(key)) + 1)


def speaker_runs(rows: DataFrame, key: str = "transcript_id", order: str = "pos", speaker: str = "speaker") -> DataFrame:
    """Numbers the stretches of rows of one speaker from 1; null equals null."""
    w = win(order, key)
    changed = ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_changed", changed.cast("long")).withColumn("run", F.sum("_changed").over(so_far(order, key))).drop("_changed")


def real_word_timings(segments: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Whether every segment of a transcript holds one word, so its times are word times."""
    return segments.groupBy(key).agg(F.bool_and(T.word_count(T.clean("text")) == 1).alias("real_timings"))
