"""Queries over decoded windows: overlapping windows of timed words, stitched again, and transcripts of two granularities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cues, windows
from . import cue_sql as Q
from . import derived as D
from .catalog import TURNS_S, clean_sql, labels_sql, query

#: Neighbouring windows of this length and stride share about ten words, which is within what overlap removal remembers.
LENGTH_MS, STRIDE_MS = 20_000, 2_000
WORDS = f"{D.SEG}, {clean_sql('seg', 'transcript_id, pos')}, {D.words_sql('cleaned')}"


def decoded_sql(length: int, stride: int) -> str:
    step = length - 2 * stride
    return f"""ends as (select transcript_id, max(e) total from words group by 1),
wk as (select *, unnest(range(greatest(0, floor((s - {length}) / {step}::double)::bigint + 1), greatest(floor(s / {step}::double)::bigint, 0) + 1)) k from words),
windows as (select transcript_id, k, {Q.joined_all("list(text order by pos)")} as text, min(s) s, max(e) e from wk join ends using (transcript_id) where k <= greatest(0, ceil((total - {length}) / {step}::double)) group by 1, 2)"""


@query(f"with {WORDS}, {decoded_sql(29_000, 5_000)} select transcript_id, k pos, text, s as start, e as \"end\", cast(k * 19000 as double) window_start, cast(k * 19000 + 29000 as double) window_end from windows")
def decode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.decode(D.words_ms(spark, sf_dir), 29_000, 5_000).select("transcript_id", "pos", "text", "start", "end", F.col("window_start").cast("double").alias("window_start"), F.col("window_end").cast("double").alias("window_end"))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in seconds, without speakers."""
    found = windows.decode(D.words_ms(spark, sf_dir), LENGTH_MS, STRIDE_MS)
    return found.select("transcript_id", "pos", "text", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))


DECODED = f"{WORDS}, {decoded_sql(LENGTH_MS, STRIDE_MS)}, base as (select transcript_id, k pos, text, s / 1000.0::double s, e / 1000.0::double e, null::varchar speaker from windows)"


@query(f"with recursive {DECODED}, {Q.token_ctes('base')} select transcript_id, i - 1 pos, text, s as start, e as \"end\" from said")
def stitched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of words that neighbouring windows repeat are cut here."""
    return cues.tokens_from_segments(_decoded(spark, sf_dir).withColumn("speaker", F.lit(None).cast("string"))).select("transcript_id", "pos", "text", "start", "end")


@query(f"""with recursive {DECODED}, {Q.token_ctes('base')}, given as (select transcript_id, sum(len(list_filter(string_split({Q.clean('text')}, ' '), lambda w: w <> ''))) n from base group by 1),
kept as (select transcript_id, count(*) n from said group by 1) select transcript_id, cast(given.n as bigint) given, kept.n kept, cast(given.n - kept.n as bigint) cut from given join kept using (transcript_id)""")
def overlap_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each transcript the words that its windows hold, and how many of them repeat what was said."""
    base = _decoded(spark, sf_dir).withColumn("speaker", F.lit(None).cast("string"))
    return cues.overlap_cuts(base)


@query(f"with recursive {DECODED}, {Q.token_ctes('base')}, {Q.cue_ctes()} select transcript_id, pos, text, s as start, e as \"end\", speaker from cue")
def stitched_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.consolidate(_decoded(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments and words: every third transcript has words beside its segments, every third is stored one word a row, the others are whole."""
    spoken = D.words_ms(spark, sf_dir).select("transcript_id", "pos", "text", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), F.lit(None).cast("string").alias("speaker"))
    whole = D.seconds(D.segments_ms(spark, sf_dir)).withColumn("speaker", F.lit(None).cast("string"))
    third = F.col("transcript_id") % 3
    segments = whole.where(third != 1).unionByName(spoken.where(third == 1))
    return segments, spoken.where(third == 2).withColumn("text", F.concat(F.lit(" "), "text"))


MIXED = f"""{TURNS_S.replace(D.SEG, WORDS)},
rows as (select transcript_id, pos, text, start_ms / 1000.0::double s, end_ms / 1000.0::double e from seg where transcript_id % 3 = 0 union all select transcript_id, pos, text, s / 1000.0::double, e / 1000.0::double from words where transcript_id % 3 = 1),
real_ as (select transcript_id, bool_and({Q.words_in(Q.clean('text'))} = 1) word_times from rows group by 1),
{labels_sql('rows', 'marked')}, base as (select marked.* replace (case when not word_times then speaker end as speaker) from marked join real_ using (transcript_id)), {Q.token_ctes('base')},
fine as (select said.transcript_id, i pos, text, s, e from said join real_ using (transcript_id) where word_times), {labels_sql('fine', 'fine_marked')},
word_rows as (select transcript_id, row_number() over (partition by transcript_id order by pos) i, text, s / 1000.0::double s, e / 1000.0::double e from words where transcript_id % 3 = 2),
ended as (select *, 0.01::double * i + max(greatest(e, s + 0.01::double) - 0.01::double * i) over (partition by transcript_id order by i rows unbounded preceding) last_e from word_rows),
normal as (select transcript_id, i pos, text, greatest(s, coalesce(lag(last_e) over (partition by transcript_id order by i), s)) s, last_e e from ended), {labels_sql('normal', 'normal_marked')},
every as (select said.transcript_id, i, text, s, e, speaker from said join real_ using (transcript_id) where not word_times union all select transcript_id, pos, text, s, e, speaker from fine_marked union all select transcript_id, pos, text, s, e, speaker from normal_marked)"""


@query(f"with recursive {MIXED}, {Q.cue_ctes('every')} select transcript_id, pos, text, s as start, e as \"end\", speaker from cue")
def mixed_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of transcripts with words, of word rows and of whole segments, labelled word by word or whole."""
    segments, words = _mixed(spark, sf_dir)
    turns = D.turns_ms(spark, sf_dir).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return cues.consolidate(segments, words, turns)
