"""Timed-text tables derived from the test tables, in whole milliseconds so that every engine agrees on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as segments: 60 ms a character, 400 ms between; every fifth end is open."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = read(spark, sf_dir, "conversations").withColumn("length", F.length("text"))  # where times alone are asked for, texts are not dealt out
    start = 60 * F.coalesce(F.sum("length").over(w), F.lit(0)) + 400 * F.col("turn")
    rows = c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("pos"), "text", "length", start.cast("long").alias("start_ms"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 3).otherwise(7).alias("speaker_id"))
    rows = rows.withColumn("end_ms", F.col("start_ms") + 60 * F.col("length")).drop("length")
    return rows.withColumn("raw_end_ms", F.when((F.col("transcript_id") * 7 + F.col("pos")) % 5 != 0, F.col("end_ms")))


SEG = """seg as (select *, start_ms + 60 * length(text) end_ms, case when (transcript_id * 7 + pos) % 5 <> 0 then start_ms + 60 * length(text) end raw_end_ms from (
  select conv_id transcript_id, turn pos, text, cast(60 * coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) + 400 * turn as bigint) start_ms,
    case role when 'user' then 0 when 'assistant' then 3 else 7 end speaker_id from conversations))"""


LATIN, HAN, THAI = "abcdefghijklmnopqrstuvwxyz", "光合作用是植物利能的过程春夏秋冬山水火木金土日月星云", "กขคงจฉชซญดตถทธนบปผฝพฟภมยรล"


def words_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversation turns: 60 ms a character. In every third transcript half of them are Han, in every seventh Thai."""
    rows = segments_ms(spark, sf_dir).select("transcript_id", F.col("pos").alias("turn"), "start_ms", F.posexplode(T.split_words("text")).alias("i", "w"))
    before = Window.partitionBy("transcript_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start_ms") + 60 * (F.coalesce(F.sum(F.length("w")).over(before), F.lit(0)) + F.col("i"))
    n = F.row_number().over(Window.partitionBy("transcript_id").orderBy("turn", "i")) - 1
    rows = rows.select("transcript_id", n.cast("long").alias("pos"), "w", start.cast("long").alias("start"))
    half = F.col("pos") % 4 < 2
    text = F.when(half & (F.col("transcript_id") % 3 == 0), F.translate(F.lower("w"), LATIN, HAN)).when(half & (F.col("transcript_id") % 7 == 0), F.translate(F.lower("w"), LATIN, THAI)).otherwise(F.col("w"))
    return rows.select("transcript_id", "pos", text.alias("text"), "start", (F.col("start") + 60 * F.length("w")).alias("end"))


def words_sql(cleaned: str) -> str:
    """``words`` (transcript_id, pos, text, s, e) in ms of ``cleaned`` (transcript_id, pos, c) and ``seg``."""
    return f"""wt as (select transcript_id, pos turn, start_ms, list_filter(string_split(c, ' '), lambda x: x <> '') w from {cleaned} join seg using (transcript_id, pos)),
wp as (select transcript_id, turn, i, w[i] w, start_ms + 60 * (coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::bigint + i - 1) s from (select *, unnest(range(1, len(w) + 1)) i from wt)),
wn as (select *, row_number() over (partition by transcript_id order by turn, i) - 1 pos from wp),
words as (select transcript_id, pos, case when pos % 4 < 2 and transcript_id % 3 = 0 then translate(lower(w), '{LATIN}', '{HAN}') when pos % 4 < 2 and transcript_id % 7 = 0 then translate(lower(w), '{LATIN}', '{THAI}') else w end as text, s, s + 60 * length(w) e from wn)"""


def turns_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: segments 250 ms later, without every fourth, so that some segments overlap none."""
    s = segments_ms(spark, sf_dir).where("pos % 4 <> 3")
    return s.select("transcript_id", F.col("pos").alias("idx"), (F.col("start_ms") + 250).alias("start"), (F.col("end_ms") + 250).alias("end"), F.col("speaker_id").alias("speaker"))


TURNS = SEG + ", turns as (select transcript_id, pos idx, start_ms + 250 s, end_ms + 250 e, speaker_id speaker from seg where pos % 4 <> 3)"


def seconds(segments: DataFrame) -> DataFrame:
    """(transcript_id, pos, text, start, end, speaker) in seconds with labels."""
    return segments.select("transcript_id", "pos", "text", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), T.speaker_label("speaker_id").alias("speaker"))


def names(spark: SparkSession) -> DataFrame:
    """Speaker names, some of them hostile."""
    return spark.createDataFrame([("SPEAKER_00", "Alice"), ("SPEAKER_03", "A\n\n1\n00:00 <b>&")], "speaker string, display_name string")


NAMES = "names as (select * from (values ('SPEAKER_00', 'Alice'), ('SPEAKER_03', 'A' || chr(10) || chr(10) || '1' || chr(10) || '00:00 <b>&')) t(speaker, display_name))"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kinds = {"signup": "downloading", "click": "extracting", "view": "ready", "purchase": "completed", "error": "failed"}
    status = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type"))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), (F.col("value") / 100).alias("progress"), F.get_json_object("props", "$.k").cast("long").alias("run_id"))


EVENTS = """ev as (select user_id job_id, event_id seq, ts, case event_type when 'signup' then 'downloading' when 'click' then 'extracting' when 'view' then 'ready' when 'purchase' then 'completed' when 'error' then 'failed' end status,
  value / 100 progress, cast(json_extract_string(props, '$.k') as bigint) run_id from events)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of largest id for each recipe."""
    d = read(spark, sf_dir, "documents")
    model = F.concat(F.lit("m-"), "lang", F.when(F.col("doc_id") % 2 == 0, T.TIMESTAMPED).otherwise(""))
    rows = d.select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("source_id"), model.alias("model_id"), F.lit("transcribe").alias("task"), F.col("lang").alias("language"), "doc_id")
    return rows.groupBy("source_id", "model_id", "task", "language").agg(F.max("doc_id").alias("doc_id"))


TRANSCRIPTS = """tr as (select cast(regexp_extract(source, '(\\d+)', 1) as bigint) source_id, 'm-' || lang || case when doc_id % 2 = 0 then '_timestamped' else '' end model_id, 'transcribe' task, lang as language, max(doc_id) doc_id from documents group by all)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each source and language, for the model with its suffix; every source number up to 30 asks for Spanish."""
    have = transcripts(spark, sf_dir).select("source_id", "language").distinct()
    more = spark.range(31).select(F.col("id").alias("source_id"), F.lit("es").alias("language"))
    rows = have.union(more).distinct()
    return rows.select(F.concat_ws("-", "source_id", "language").alias("request_id"), "source_id", F.concat(F.lit("m-"), "language", F.lit(T.TIMESTAMPED)).alias("model_id"), F.lit("transcribe").alias("task"), "language")


REQUESTS = TRANSCRIPTS + """, rq as (select source_id || '-' || language request_id, source_id, 'm-' || language || '_timestamped' model_id, 'transcribe' task, language
  from (select source_id, language from tr union select range source_id, 'es' from range(31)))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources, without every tenth; half of them have audio."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    return c.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "youtube").otherwise("file").alias("source_type"), F.col("c_name").alias("source_key"), F.col("c_mktsegment").alias("filename"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/a/"), "c_name")).alias("audio_path"), F.when(F.col("c_custkey") % 2 == 0, "audio/wav").alias("audio_mime_type"))


SOURCES = """src as (select c_custkey id, case when c_custkey % 3 = 0 then 'youtube' else 'file' end source_type, c_name source_key, c_mktsegment filename,
  case when c_custkey % 2 = 0 then '/a/' || c_name end audio_path, case when c_custkey % 2 = 0 then 'audio/wav' end audio_mime_type from customer where c_custkey % 10 <> 0)"""
