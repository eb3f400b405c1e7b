"""Registered queries of the small functions and of table operations, each with SQL written from the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config, text as T, timing as C
from ..operators import cues, export, store, tokens
from ..sources import readers
from ..streaming import jobs
from . import derived as D
from .catalog import query


@query(f"with {D.SOURCES} select 'id' way, id, source_key from src where id = 7 union all select 'key', id, source_key from src where source_type = 'youtube' and source_key = 'Customer#000000009' union all select 'job', id, source_key from src where id = (select o_custkey from orders where o_orderkey = 1 and o_custkey is not null)")
def source_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sources(spark, sf_dir)
    work = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"))
    owner = s.join(store.source_of_job(work, 1), F.col("id") == F.col("source_id"), "left_semi")
    shown = lambda way, rows: rows.select(F.lit(way).alias("way"), "id", "source_key")
    return shown("id", store.by_id(s, 7)).unionByName(shown("key", store.by_natural_key(s, "youtube", "Customer#000000009"))).unionByName(shown("job", owner))


@query(f"""with {D.SOURCES} select id, case when id % 7 = 0 then 'renamed' when id % 5 = 0 and id % 2 = 0 then 'heard' else filename end filename, case when id % 5 = 0 then '/new' else audio_path end audio_path,
  id % 7 = 0 or id % 5 = 0 or id % 3 = 0 updated, id % 7 = 0 or id % 5 = 0 or id % 3 = 0 accessed from src""")
def source_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp")
    s = D.sources(spark, sf_dir).withColumns({"updated_at": old, "last_accessed_at": old})
    heard = s.where("id % 5 = 0").select("id", F.lit("/new").alias("audio_path"), F.lit("audio/wav").alias("audio_mime_type"), F.when(F.col("id") % 2 == 0, "heard").alias("filename"))
    s = store.attach_audio(store.touch(s, s.where("id % 3 = 0"), now), heard, now)
    s = store.rename_sources(s, s.where("id % 7 = 0").select("id", F.lit("renamed").alias("filename")), now)
    return s.select("id", "filename", "audio_path", (F.col("updated_at") == now).alias("updated"), (F.col("last_accessed_at") == now).alias("accessed"))


@query("select o_orderkey id, case when o_orderkey % 2 = 0 then 'failed' else o_orderstatus end status, o_orderkey % 4 = 0 or o_orderkey % 4 = 2 stamped from orders")
def job_update_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp")
    o = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), old.alias("updated_at"))
    out = store.update_fields(o, o.where("id % 2 = 0").select("id", F.lit("failed").alias("status")), ["status"], now=now)
    return out.select("id", "status", (F.col("updated_at") == now).alias("stamped"))


@query(f"with {D.SOURCES}, {D.REQUESTS} select request_id, case when id is not null and audio_path is not null and id % 4 = 0 then 'ready' when rq.source_id % 3 = 0 then 'downloading' else 'extracting' end status from rq left join src on src.id = rq.source_id")
def routed_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = D.requests(spark, sf_dir).withColumn("source_type", F.when(F.col("source_id") % 3 == 0, "youtube").otherwise("file"))
    s = D.sources(spark, sf_dir)
    there = s.where("id % 4 = 0").select(F.col("audio_path").alias("path"))
    return store.route_jobs(asked, D.transcripts(spark, sf_dir).where("doc_id < 0"), s, files=there).select("request_id", "status")


@query(f"""with {D.REQUESTS}, w as (select *, row_number() over (partition by request_id order by exact desc) k from (select request_id, source_id, model_id, task, language, true exact from rq union all select request_id, source_id, replace(model_id, '_timestamped', ''), task, language, false from rq) x join tr using (source_id, model_id, task, language))
select rq.request_id, 'text ' || doc_id full_text from rq left join w on w.request_id = rq.request_id and k = 1""")
def cached_job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = D.requests(spark, sf_dir).withColumn("source_type", F.lit("file"))
    stored = D.transcripts(spark, sf_dir).withColumn("full_text", F.concat(F.lit("text "), "doc_id"))
    return store.route_jobs(asked, stored, D.sources(spark, sf_dir)).select("request_id", "full_text")


@query(f"""with {D.TRANSCRIPTS} select 'j' || doc_id id, case when doc_id % 3 = 0 then 'completed' else 'ready' end status, case when doc_id % 3 = 0 then 1.0::double else 0.5::double end progress, case when doc_id % 3 = 0 then 't' || doc_id end full_text,
  case when doc_id % 3 = 0 then 1 else 0 end::integer n_segments, case when doc_id % 3 = 0 then null else 'old' end error, doc_id % 3 = 0 stamped from tr""")
def persisted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = "array<struct<start:double,end:double,text:string,speaker:string>>"
    old, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp")
    t = D.transcripts(spark, sf_dir).withColumn("id", F.concat(F.lit("j"), "doc_id"))
    work = t.select("id", *store.RECIPE, F.lit("ready").alias("status"), F.lit(0.5).alias("progress"), F.lit("old").alias("error"), F.lit(None).cast("string").alias("full_text"), F.lit(None).cast(seg).alias("segments"), old.alias("updated_at"))
    one = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("x").alias("text"), F.lit("SPEAKER_00").alias("speaker")))
    new = t.where("doc_id % 3 = 0").select(F.col("id").alias("job_id"), *store.RECIPE, F.concat(F.lit("t"), "doc_id").alias("full_text"), one.alias("segments"), F.col("doc_id").alias("seq"))
    none = t.where("doc_id < 0").select(*store.RECIPE, F.lit("").alias("full_text"), F.lit(None).cast(seg).alias("segments"))
    names = spark.createDataFrame([], "source_id long, speaker_key string, display_name string, seq long")
    out = store.persist_transcripts(none, work, names, new, now)["jobs"]
    return out.select("id", "status", "progress", "full_text", F.coalesce(F.size("segments"), F.lit(0)).alias("n_segments"), "error", (F.col("updated_at") == now).alias("stamped"))


@query("select o_orderkey seq, o_custkey job_id, o_custkey % 4 <> 0 and o_orderkey = min(o_orderkey) over (partition by o_custkey) accepted from orders")
def run_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("job_id"))
    return store.start_runs(o, o.where("job_id % 4 = 0").select("job_id")).select("seq", "job_id", "accepted")


@query("select p_partkey, p_brand model_id, p_brand is null or p_brand in (select p_brand from part where p_size > 48) available from part")
def model_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("model_id"), "p_size")
    status = p.select("model_id", (F.col("p_size") > 48).alias("ready"))
    return config.with_availability(p, status).select("p_partkey", "model_id", "available")


@query("""with recursive s as (select user_id % 7 worker, event_id seq, case when event_type in ('signup', 'click') then 1 else -1 end change, row_number() over (partition by user_id % 7 order by event_id) i from events),
c(worker, i, seq, active) as (select worker, i, seq, greatest(0, change) from s where i = 1 union all select s.worker, s.i, s.seq, greatest(0, c.active + s.change) from c join s on s.worker = c.worker and s.i = c.i + 1)
select worker, seq, cast(active as bigint) active from c""")
def download_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("event_type").isin("signup", "click"), 1).otherwise(-1)
    e = D.read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("worker"), F.col("event_id").alias("seq"), change.alias("change"))
    return jobs.download_counts(e).select("worker", "seq", F.col("active").cast("long").alias("active"))


@query("select cast(0 as integer) queued, cast(0 as integer) transcriptions, count(*) filter (o_orderstatus = 'O') active_downloads from orders")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..api import Workspace

    work = D.read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "downloading").otherwise("ready").alias("status"))
    return Workspace(spark, work, work, work, work).health()


@query("""select event_id, value / 20 fraction, case when v < 0 then 0 when v > 1 then 1 else v end as clamped, event_id % 3 = 0 unknown, case when event_id % 3 = 0 then null when v > 1 then 1 else v end progress, case when event_id % 4 > 0 then event_id / (event_id % 4 / 1000.0::double) end rate, event_id * 50 > 7200 too_long
  from (select *, value / 20 v from events)""")
def progress_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    duration = F.when(i % 3 == 0, 0.0).otherwise(20.0)
    return D.read(spark, sf_dir, "events").select(
        i, (F.col("value") / 20).alias("fraction"), C.unit_range(F.col("value") / 20).alias("clamped"), (i % 3 == 0).alias("unknown"),
        C.progress_fraction("value", duration).alias("progress"), C.tokens_per_second(i, i % 4).alias("rate"), C.too_long(i * 50).alias("too_long"))


@query("""select event_id, line, case when event_id % 3 = 0 then null else (event_id // 3600) * 3600.0::double + (event_id // 60 % 60) * 60.0::double + (event_id % 60 + 0.25::double) end as seconds
  from (select event_id, case when event_id % 3 = 0 then 'out_time=N/A' else 'out_time=' || printf('%02d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) || '.25' end line from events)""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    at = F.format_string("out_time=%02d:%02d:%02d.25", F.floor(e / 3600), F.floor(e / 60) % 60, e % 60)
    line = F.when(e % 3 == 0, "out_time=N/A").otherwise(at)
    return D.read(spark, sf_dir, "events").select(e, line.alias("line")).withColumn("seconds", C.progress_position("line"))


@query("select user_id, event_id, 'w' || event_id word from events where event_id % 4 <> 0 and event_id % 6 <> 0")
def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    words = D.read(spark, sf_dir, "events").select("user_id", i, F.concat(F.lit("w"), i.cast("string")).alias("word"), F.when(i % 4 != 0, i * 0.5).alias("start"), F.when(i % 6 != 0, i * 0.5 + 1).alias("end"))
    return tokens.decoded_words(words).select("user_id", "event_id", "word")


@query("select event_id, (floor((value * 7 - 100) * 1000 + 0.5) / 1000) rounded, event_id + greatest(event_id + value - event_id, 0.01::double) * (event_id % 5) / 9.0::double as offset_start from events")
def rounded_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return D.read(spark, sf_dir, "events").select(i, C.round3(F.col("value") * 7 - 100).alias("rounded"), C.overlap_offset(i, i + F.col("value"), i % 5, F.lit(9)).alias("offset_start"))


@query("select c_custkey, case when trim(raw) = '' then 'auto' else lower(trim(raw)) end as language, case when trim(raw) = '' or lower(trim(raw)) = 'auto' then null else lower(trim(raw)) end requested from (select c_custkey, case c_custkey % 4 when 0 then '  ' when 1 then ' EN ' when 2 then 'Auto' else c_mktsegment end raw from customer)")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    c = D.read(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "  ").when(k == 1, " EN ").when(k == 2, "Auto").otherwise(F.col("c_mktsegment")).alias("raw"))
    found = c.select("c_custkey", T.normalise_language("raw").alias("language"))
    return found.withColumn("requested", T.requested_language("language"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'youtube' else 'file' end || '-' || c_name || '.wav' prepared, left(c_name, 8) short, left(c_mktsegment, 5) cut from customer")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, "youtube").otherwise("file")
    return D.read(spark, sf_dir, "customer").select("c_custkey", T.prepared_name(kind, "c_name").alias("prepared"), T.short_id("c_name").alias("short"), T.truncate("c_mktsegment", 5).alias("cut"))


@query("select event_id, case when event_id % 5 > 0 then floor(epoch(ts::timestamp))::bigint end as seconds from events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 > 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("yesterday")
    return e.select("event_id", F.unix_timestamp(T.parse_iso(raw)).alias("seconds"))


@query("""with t as (select event_id, case when event_id % 3 = 0 then (event_id // 3) % 17 end signal, case when event_id % 3 = 1 then (event_id // 3) % 130 end code, event_id % 4 = 0 panicked from events)
select event_id, case when signal = 6 and panicked then 'the engine panicked (signal 6)' when signal = 6 then 'the engine aborted, perhaps over a damaged model (signal 6)' when signal = 9 then 'the engine was killed (signal 9)'
  when signal = 11 then 'the engine made an invalid access (signal 11)' when signal is not null then 'the engine ended by signal ' || signal when code is not null and panicked then 'the engine panicked with status ' || code
  when code is not null then 'the engine ended with status ' || code else 'the engine ended abnormally' end message from t""")
def exit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    third = F.floor(i / 3)
    rows = D.read(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, third % 17).alias("signal"), F.when(i % 3 == 1, third % 130).alias("code"), (i % 4 == 0).alias("panicked"))
    return rows.select("event_id", T.exit_message("signal", "code", "panicked").alias("message"))


#: Letters that become characters of scripts without word spaces, so that the test texts meet their rules.
LATIN, OTHER = "aeiouy", "あ漢อ、。ກ"
SCRIPT = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{0e00}-\x{0e7f}\x{0e80}-\x{0eff}\x{1000}-\x{109f}]"
CJK = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"
TURNED = f"t as (select conv_id, turn, translate(trim(replace(text, chr(10), ' ')), '{LATIN}', '{OTHER}') t from conversations)"


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), LATIN, OTHER).alias("t"))


@query(rf"""with {TURNED} select conv_id, turn, cast(len(regexp_extract_all(t, '{SCRIPT}')) + len(list_filter(string_split(regexp_replace(t, '{SCRIPT}', ' ', 'g'), ' '), lambda w: w <> '')) as integer) as words,
  regexp_matches(t, '[.!?。！？…]["''”’)\]]*$') ends_sentence, regexp_matches(t, '[,;:，、；：]["''”’)\]]*$') ends_clause,
  case when regexp_matches(t, '{CJK}$') then '。' when regexp_matches(t, '{SCRIPT}$') then '' else '.' end terminator from t""")
def script_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turned(spark, sf_dir).select("conv_id", "turn", T.word_count("t").alias("words"), T.ends_sentence("t").alias("ends_sentence"), T.ends_clause("t").alias("ends_clause"), T.terminator("t").alias("terminator"))


@query(rf"""with {TURNED} select conv_id, turn, case when a = '' or b = '' then a || b when regexp_matches(a, '{SCRIPT}$') or regexp_matches(b, '^{SCRIPT}') then a || b else a || ' ' || b end joined
  from (select conv_id, turn, left(t, turn * 3 + 1) a, substr(t, turn * 3 + 4) b from t)""")
def script_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("turn") * 3).cast("int")
    r = _turned(spark, sf_dir).select("conv_id", "turn", F.left("t", n + 1).alias("a"), F.substring(F.col("t"), n + 4, F.char_length("t")).alias("b"))
    return r.select("conv_id", "turn", T.join_pair("a", "b").alias("joined"))


@query("""select transcript_id, case when transcript_id % 2 = 0 then 'from the worker' else 'cue' end full_text from (select distinct conv_id transcript_id from conversations)""")
def full_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id")).distinct()
    shown = t.where("transcript_id % 2 = 1").select("transcript_id", F.lit(0).cast("long").alias("pos"), F.lit("cue").alias("text"))
    return cues.full_text(shown, t.withColumn("worker_text", F.lit("from the worker")))


@query(f"with {D.SEG} select transcript_id, string_agg(pos, ',' order by start_ms % 7, pos) places from seg group by 1")
def turns_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("pos", (F.col("start_ms") % 7).alias("start"))
    t = D.segments_ms(spark, sf_dir).groupBy("transcript_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return t.select("transcript_id", F.array_join(F.transform(readers.by_start("turns"), lambda x: x["pos"].cast("string")), ",").alias("places"))


@query("""select page_id, case when page_id % 3 = 0 then null when page_id % 3 = 1 then 'b.MP4' else 'a.wav' end path, case when page_id % 3 = 0 then null when page_id % 3 = 1 then 2 else 1 end::integer ignored, case when page_id % 3 = 0 then 'no audio or video file' end error from pages""")
def first_dropped_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda *p: F.array(*map(F.lit, p))
    i = F.col("page_id") % 3
    p = D.read(spark, sf_dir, "pages").select("page_id", F.when(i == 0, listed("x.txt", "y")).when(i == 1, listed("x.txt", "b.MP4", "c.mp3")).otherwise(listed("a.wav", "n.pdf")).alias("paths"))
    return readers.first_media(p).select("page_id", "path", "ignored", "error")


@query("select '/d/v' || n_nationkey || '.m4a' path from nation where n_nationkey in (3, 8)")
def downloaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.read(spark, sf_dir, "nation").select(F.explode(F.array(*[F.concat(F.lit("/d/v"), F.col("n_nationkey").cast("string"), F.lit(e)) for e in (".m4a", ".webm", ".webm.part", ".a.part")])).alias("path"))
    return readers.first_download(n, "v3").unionByName(readers.first_download(n, "v8"))


@query(f"""with {D.SEG}, item as (select transcript_id, pos, '      {{' || chr(10) || '        "start": ' || start_ms || ',' || chr(10) || '        "end": ' || end_ms || ',' || chr(10) || '        "text": ' || cast(to_json(text) as varchar) || ',' || chr(10) || '        "speaker": "SPEAKER_0' || speaker_id || '"' || chr(10) || '      }}' t from seg)
select transcript_id, '{{' || chr(10) || '  "segments": [' || chr(10) || string_agg(replace(replace(t, '        "', '      "'), '      {{', '    {{'), ',' || chr(10) order by pos) || chr(10) || '  ],' || chr(10) || '  "speakerNames": {{' || chr(10) || '    "SPEAKER_00": "Al \\"x\\"",' || chr(10) || '    "SPEAKER_03": "Bo"' || chr(10) || '  }}' || chr(10) || '}}' as document from item group by 1""".replace("'      }'", "'    }'"))
def named_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments_ms(spark, sf_dir).select("transcript_id", "pos", "text", F.col("start_ms").cast("double").alias("start"), F.col("end_ms").cast("double").alias("end"), T.speaker_label("speaker_id").alias("speaker"))
    names = s.select("transcript_id").distinct().withColumn("names", F.create_map(F.lit("SPEAKER_00"), F.lit('Al "x"'), F.lit("SPEAKER_03"), F.lit("Bo")))
    return export.export(s, "json", names=names)


@query(f"with {D.EVENTS}, l as (select job_id, arg_max(status, seq) status, max(seq) seq from ev where status = 'completed' group by 1) select job_id as session, seq, seq % 2 = 0 words_win from l")
def final_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.job_events(spark, sf_dir).select(F.col("job_id").alias("session"), "seq", F.when(F.col("status") == "completed", "complete").otherwise("update").alias("kind"), F.array(F.lit("c")).alias("chunks"), F.when(F.col("seq") % 2 == 0, F.array(F.lit("w"))).alias("words"))
    return jobs.results(e).select("session", "seq", F.col("chunks").isNull().alias("words_win"))


@query(f"with {D.EVENTS} select job_id as session, max(seq) seq, arg_max(progress, seq) progress from ev group by 1")
def preview_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.previews(D.job_events(spark, sf_dir).select(F.col("job_id").alias("session"), "seq", "progress"))
