"""Captions from tokens: overlap removal, greedy segmentation, merging, casing and line breaks.

Removal, segmentation and merging depend on what came before them in a transcript, so they are folds over its rows in
order, which remember a few words or one cue; all else is columns and windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..functions.timing import EPSILON, LEAST_CUE, LEAST_WORD, NOMINAL_WORD
from . import align, tokens
from .fold import fold_rows

# Fixed values of the caption format.
MAX_CHARS, MAX_SECONDS, MAX_MERGED_SECONDS, LEAST_WORDS, MEMORY_WORDS = 78, 6.5, 8.0, 3, 16
#: From these lengths on, a cue may end when it gets long, or at a clause after so many seconds.
LONG_CHARS, CLAUSE_CHARS, CLAUSE_SECONDS = 24, 56, 4.5
#: What the folds give for each token or cue.
TOKEN = [("text", "string", pa.string()), ("start", "double", pa.float64()), ("end", "double", pa.float64()), ("speaker", "string", pa.string())]
#: Of tokens cut from segments also whether a token is the first of its segment or stands for itself, and the segment's time unless it does.
CUT = [("head", "boolean", pa.bool_()), ("whole_start", "double", pa.float64()), ("whole_end", "double", pa.float64())]


def repeated_head(memory: list[str], words: list[str], least: int) -> int:
    """How many leading words repeat the end of what was said: the longest match of letters and digits, if long enough."""
    bare = lambda ws: [b for w in ws if (b := "".join(c for c in w.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789'"))]
    tail, head = bare(memory), bare(words)
    for n in range(min(MEMORY_WORDS, len(tail), len(head)), least - 1, -1):
        if tail[len(tail) - n :] == head[:n]:
            return n
    return 0


def segment_tokens(rows: Iterator[dict]) -> Iterator[tuple]:
    """Words of segments (words, weights, start, end, overlaps), without what the one in front has said, with times shared out by characters."""
    memory: list[str] = []
    said_until = None
    for seg in rows:
        start, end, words, weights = seg["start"], seg["end"], seg["words"], seg["weights"]
        cut = repeated_head(memory, words, 1 if seg["overlaps"] else LEAST_WORDS)
        left = start + max(end - start, LEAST_WORD) * sum(weights[:cut]) / sum(weights)
        words, weights = words[cut:], weights[cut:]
        if not words:
            continue
        begin = left if said_until is None else max(left, said_until)
        span = end - begin if end - begin >= len(words) * LEAST_WORD - EPSILON else begin + len(words) * NOMINAL_WORD - begin
        total, done = sum(weights), 0.0
        first = True
        for word, weight in zip(words, weights):
            at = begin + done * span
            done += weight / total
            said_until = begin + done * span
            yield word, at, said_until, seg["speaker"], first or seg["real"], seg["whole_start"], seg["whole_end"]
            first = False
        memory = (memory + words)[-MEMORY_WORDS:]


def tokens_from_segments(segments: DataFrame) -> DataFrame:
    """Tokens of segments (transcript_id, pos, text, start, end, speaker); what a column can say of a segment, columns say.

    Beside these columns they have ``head``, ``whole_start`` and ``whole_end`` for ``align.label_tokens``: where every segment of
    a transcript is one word, times are word times and a token stands for itself; elsewhere its segment's time counts.
    """
    return fold_rows(_prepared(segments), segment_tokens, TOKEN + CUT)


def _prepared(segments: DataFrame, *more: str) -> DataFrame:
    """What ``segment_tokens`` reads of segments."""
    rows = segments.withColumns({"words": T.split_words("text"), "next": F.lead("start").over(tokens.win())})
    rows = rows if "real" in segments.columns else _told(rows)
    whole = {f"whole_{c}": F.when(~F.col("real"), F.col(c)) for c in ("start", "end")}
    # a segment without words counts for the next start and for word times, but says nothing
    rows = rows.withColumns(whole).where(F.size("words") > 0)
    rows = rows.withColumn("end", tokens.effective_end(F.col("start"), F.col("end"), F.col("next"), F.size("words")))
    rows = rows.withColumns({"weights": F.transform("words", T.char_weight), "overlaps": tokens.overlaps_before()})
    return rows.select("transcript_id", "pos", "words", "weights", "start", "end", "overlaps", "speaker", "real", *whole, *more)


def _told(segments: DataFrame) -> DataFrame:
    """``real``: whether every segment of the transcript is one word."""
    return segments.withColumn("real", F.bool_and(T.word_count(T.clean("text")) == 1).over(Window.partitionBy("transcript_id")))


def overlap_cuts(segments: DataFrame) -> DataFrame:
    """(transcript_id, given, kept, cut): words in the segments of each transcript, tokens made of them, and words cut as repetitions."""

    def counts(rows: Iterator[dict]) -> Iterator[tuple]:
        given = 0

        def seen() -> Iterator[dict]:
            nonlocal given
            for row in rows:
                given += len(row["words"])
                yield row

        kept = sum(1 for _ in segment_tokens(seen()))
        yield given, kept, given - kept

    found = fold_rows(_prepared(segments), counts, [(name, "long", pa.int64()) for name in ("given", "kept", "cut")])
    return found.select("transcript_id", "given", "kept", "cut")


def cut_cues(rows: Iterator[dict]) -> Iterator[list]:
    """Greedy cues [start, end, text, speaker]; a token opens a new cue when the running one is full or complete."""
    run: list[dict] = []
    joined, room = "", 0  # no cleaned text is longer than its room, so that most tokens need no cleaning
    for r in rows:
        longer, more = S.join_pair(joined, r["text"]), S.most_clean(r["text"])
        if run:
            n, last, first = len(run), run[-1], run[0]
            now, then = last["end"] - first["start"], r["end"] - first["start"]
            stop = last["speaker"] != r["speaker"]
            if not stop and n >= LEAST_WORDS:
                stop = (
                    room + 1 + more > MAX_CHARS and S.length(S.clean(longer)) > MAX_CHARS
                    or now >= LEAST_CUE and S.SENTENCE_END.search(last["text"])
                    or then > MAX_SECONDS and S.length(S.clean(joined)) >= LONG_CHARS
                    or now >= CLAUSE_SECONDS and S.CLAUSE_END.search(last["text"]) and S.length(S.clean(joined)) >= CLAUSE_CHARS)
            if stop:
                yield _cue(run, joined)
                run, longer, room = [], r["text"], 0
        room += 1 + more
        run.append(r)
        joined = longer
    if run:
        yield _cue(run, joined)


def _cue(run: list[dict], joined: str) -> list:
    whole = lambda x: int((x * 1000 + 0.5) // 1) / 1000  # noqa: E731  halves go up
    return [whole(run[0]["start"]), whole(run[-1]["end"]), S.wrap(S.clean(joined)), run[0]["speaker"]]


def merge_cues(cues: Iterator[list]) -> Iterator[list]:
    """Cues of few words or little time join the cue in front, if speaker, length and span allow."""
    held: list | None = None
    for cue in cues:
        start, end, text, speaker = cue
        if held and (S.word_count(text) < LEAST_WORDS or end - start < LEAST_CUE) and held[3] == speaker:
            both = S.clean(S.join_pair(held[2], text))
            if S.length(both) <= MAX_CHARS and end - held[0] <= MAX_MERGED_SECONDS:
                held = [held[0], end, S.wrap(both), speaker]
                continue
        if held:
            yield held
        held = cue
    if held:
        yield held


def cues_from_tokens(words: DataFrame) -> DataFrame:
    """Cues (transcript_id, pos, text, start, end, speaker) of tokens in time order, with sentence casing and a final stop.

    A cue always ends where the speaker changes, and none is merged across that. So each stretch of one speaker is an
    island that is cut and merged by itself, in any task; numbers and casing follow by windows.
    """
    return sentence_case(_cut_tokens(words))


def _cut_tokens(words: DataFrame) -> DataFrame:
    words = words if "again" in words.columns else words.withColumn("again", F.lit(None).cast("boolean"))
    islands = tokens.speaker_runs(words.select("transcript_id", "pos", "text", "start", "end", "speaker", "again"))
    # overlap removal reads whole segments across speakers
    islands = islands.withColumn("run", F.when(F.col("again").isNull(), F.col("run")).otherwise(F.lit(0).cast("long")))

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        first = next(rows)
        rows = chain([first], rows)
        return _cut_and_merge(rows) if first["again"] is None else _cut_whole(_segment(r) for r in rows)

    found = fold_rows(islands, fold, TOKEN, ["transcript_id", "run"])
    place = F.row_number().over(Window.partitionBy("transcript_id").orderBy("run", "pos")) - 1
    return found.withColumn("pos", place.cast("long")).drop("run")


def _segment(row: dict) -> dict:
    words = row["text"].split(" ")
    return row | {"words": words, "weights": [max(S.length(w), 1) for w in words], "overlaps": row["again"], "real": False, "whole_start": None, "whole_end": None}


def _cut_whole(rows: Iterator[dict]) -> Iterator[tuple]:
    named = ("text", "start", "end", "speaker")
    return _cut_and_merge(dict(zip(named, token)) for token in segment_tokens(rows))


def _cut_segments(segments: DataFrame) -> DataFrame:
    """``_cut_tokens`` of ``tokens_from_segments`` in one fold: overlap removal reads a transcript in order anyway, so its
    tokens are cut and merged as they come, and none is dealt out."""
    return fold_rows(_prepared(segments), _cut_whole, TOKEN)


def _cut_and_merge(rows: Iterator[dict]) -> Iterator[tuple]:
    for start, end, text, speaker in merge_cues(cut_cues(rows)):
        yield text, start, end, speaker


def sentence_case(cues: DataFrame) -> DataFrame:
    """Capitals after ended sentences and at the start, and a terminator on the last cue of each transcript."""
    w = Window.partitionBy("transcript_id").orderBy("pos")
    flat = T.flatten_lines("text")
    opens = F.coalesce(T.ends_sentence(F.lag(flat).over(w)), F.lit(True))
    rows = cues.withColumns({"_opens": opens, "_last": F.lead("pos").over(w).isNull()})
    text = F.when(F.col("_opens"), T.capitalise_first("text")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    ended = F.col("_last") & ~T.ends_sentence(flat)
    return rows.withColumn("text", F.when(ended, F.concat("text", T.terminator(flat))).otherwise(F.col("text"))).drop("_opens", "_last")


def consolidate(segments: DataFrame, words: DataFrame | None = None, turns: DataFrame | None = None) -> DataFrame:
    """Cues of raw segments or, where a transcript has them, of its words, with speakers where it has turns.

    To be run once: cues fed back in lose words. Without word times, turns are matched per segment, not per word. Words
    without a time leave; a transcript none of whose words has one counts as without words.
    """
    base = _speaking(segments)
    if words is not None:
        words = tokens.decoded_words(words)
        base = base.join(words.select("transcript_id").distinct(), "transcript_id", "left_anti")
    spoken = None if words is None else _standing(tokens.normalise_words(_speaking(words)))
    if turns is None:
        found = _cut_segments(base)
        return sentence_case(found if spoken is None else found.unionByName(_cut_tokens(spoken)))
    every = _to_label(base)
    if spoken is not None:
        every = every.unionByName(spoken.withColumn("again", F.lit(None).cast("boolean")))
    return sentence_case(_cut_tokens(align.label_tokens(every, turns)))


def _to_label(segments: DataFrame) -> DataFrame:
    """What is labelled of segments: tokens where they have times of their own, else whole segments, as tokens take the label of theirs.

    ``again``: of a whole segment whether it overlaps the one in front; null for tokens. ``_cut_tokens`` makes tokens of it.
    """
    known = F.bool_and(~F.col("real") & F.col("start").isNotNull() & F.col("end").isNotNull()).over(Window.partitionBy("transcript_id"))

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        first = next(rows)
        rows = chain([first], rows)
        if first["known"]:
            for r in rows:
                yield " ".join(r["words"]), r["start"], r["end"], r["speaker"], True, r["whole_start"], r["whole_end"], r["overlaps"]
        else:
            for token in segment_tokens(rows):
                yield *token, None

    return fold_rows(_prepared(_told(segments).withColumn("known", known), "known"), fold, [*TOKEN, *CUT, ("again", "boolean", pa.bool_())])


def _speaking(rows: DataFrame) -> DataFrame:
    speaking = rows if "speaker" in rows.columns else rows.withColumn("speaker", F.lit(None).cast("string"))
    return speaking.select("transcript_id", "pos", "text", "start", "end", "speaker")


def _standing(rows: DataFrame) -> DataFrame:
    """Rows that stand for themselves when labels are given."""
    none = F.lit(None).cast("double")
    return rows.select("transcript_id", F.col("pos").cast("long").alias("pos"), "text", "start", "end", "speaker", F.lit(True).alias("head"), none.alias("whole_start"), none.alias("whole_end"))


def rows_to_persist(chunks: DataFrame, words: DataFrame | None = None, turns: DataFrame | None = None, duration=None) -> DataFrame:
    """What is stored of a worker's result: one row a word where it has words, else its chunks."""
    rows = _speaking(tokens.chunk_segments(chunks, duration))
    if words is not None:
        words = tokens.decoded_words(words)
        rest = rows.join(words.select("transcript_id").distinct(), "transcript_id", "left_anti")
        rows = rest.unionByName(tokens.normalise_words(_speaking(words)))
    if turns is not None:
        found = align.assign_speakers(rows, turns)
        rows = found.withColumn("speaker", F.coalesce(T.speaker_label("speaker_id"), "speaker")).drop("speaker_id")
    return rows.select("transcript_id", "pos", "text", "start", "end", "speaker")


def full_text(cues: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """The text of each transcript's cues, joined by script; ``fallback`` (transcript_id, worker_text) where that is empty."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", T.flatten_lines("text").alias("t")))), lambda x: x["t"])
    joined = cues.groupBy("transcript_id").agg(T.trim_space(T.join_all(ordered)).alias("full_text"))
    if fallback is None:
        return joined
    both = fallback.join(joined, "transcript_id", "left")
    return both.select("transcript_id", F.coalesce(F.nullif("full_text", F.lit("")), "worker_text").alias("full_text"))


def hide_short_tail(cues: DataFrame) -> DataFrame:
    """Without the last cue of a transcript while that has under three words: it is still being spoken."""
    last = F.lead("pos").over(Window.partitionBy("transcript_id").orderBy("pos")).isNull()
    return cues.withColumn("_last", last).where(~F.col("_last") | (T.word_count(T.flatten_lines("text")) >= LEAST_WORDS)).drop("_last")
