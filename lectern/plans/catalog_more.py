"""Further registered queries: the smaller operators, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config, text as T, timing as C
from ..operators import align, cues, store, tokens
from ..sources import readers
from ..streaming import jobs
from . import derived as D
from .catalog import WS, query


@query(f"with {D.EVENTS} select job_id, max(seq) seq, arg_max(status, seq) status, arg_max(progress, seq) progress from ev group by 1")
def last_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.last_state(D.job_events(spark, sf_dir)).select("job_id", "seq", "status", "progress")


@query(f"""with {D.EVENTS}, f as (select *, min(case when status in ('completed', 'failed') then seq end) over (partition by job_id) settled from ev)
select job_id, seq, status from f where settled is null or seq <= settled""")
def events_until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.until_terminal(D.job_events(spark, sf_dir)).select("job_id", "seq", "status")


@query(f"with {D.EVENTS}, l as (select run_id, arg_max(status, seq) status, max(seq) seq from ev group by 1) select run_id, status, seq from l where status <> 'completed'")
def files_in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.job_events(spark, sf_dir).select(F.col("run_id").alias("file"), "seq", F.when(F.col("status") == "completed", "done").otherwise(F.col("status")).alias("status"))
    return jobs.progress_items(e).select(F.col("file").alias("run_id"), "status", "seq")


@query(f"with {D.SEG} select transcript_id run_id, pos // 3 window_idx, string_agg(text, '' order by pos) as text from seg group by 1, 2")
def window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments_ms(spark, sf_dir)
    return jobs.open_window_text(s.select(F.col("transcript_id").alias("run_id"), F.floor(F.col("pos") / 3).alias("window_idx"), F.col("pos").alias("seq"), "text"))


@query(f"with {D.EVENTS} select job_id, arg_min(progress, seq) duration from ev where seq % 3 = 0 group by 1")
def first_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.job_events(spark, sf_dir).withColumn("duration", F.when(F.col("seq") % 3 == 0, F.col("progress")))
    return jobs.first_duration(e)


@query(f"with {D.EVENTS} select source_id, string_agg(speaker_key || '=' || display_name, ',' order by speaker_key) as names from (select job_id % 20 source_id, status speaker_key, cast(max(run_id) as varchar) display_name from ev group by 1, 2) group by 1")
def speaker_name_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.job_events(spark, sf_dir).groupBy((F.col("job_id") % 20).alias("source_id"), F.col("status").alias("speaker_key")).agg(F.max("run_id").cast("string").alias("display_name"))
    entries = F.transform(F.array_sort(F.map_entries("names")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return store.speaker_names(rows).select("source_id", F.array_join(entries, ",").alias("names"))


@query(f"with {D.SEG}, {D.NAMES} select transcript_id, pos, coalesce(display_name, 'SPEAKER_0' || speaker_id) display from seg left join names on speaker = 'SPEAKER_0' || speaker_id")
def named_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.seconds(D.segments_ms(spark, sf_dir)).withColumn("source_id", F.lit(1))
    names = D.names(spark).select(F.lit(1).alias("source_id"), F.col("speaker").alias("speaker_key"), "display_name")
    return align.with_names(s, names).select("transcript_id", "pos", "display")


@query("select event_id, printf('%02d:%02d:%02d,%03d', floor(v / 3600)::bigint, floor((v % 3600) / 60)::bigint, floor(v % 60)::bigint, floor((v % 1) * 1000)::bigint) srt, case when v >= 3600 then printf('%02d:', floor(v / 3600)::bigint) else '' end || printf('%02d:%02d', floor(v % 3600 / 60)::bigint, floor(v)::bigint % 60) clock from (select event_id, value * 97 v from events)")
def clock_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") * 97
    return D.read(spark, sf_dir, "events").select("event_id", C.timestamp(v).alias("srt"), C.clock(v).alias("clock"))


@query("select event_id, value between 1 and 64 and value = floor(value) entered, k between 0 and 64 accepted, case when k > 0 then k else -1 end clusters, value > 0 threshold from (select *, cast(floor(value) as integer) k from events)")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor("value").cast("int")
    return D.read(spark, sf_dir, "events").select("event_id", config.valid_speaker_count("value").alias("entered"), config.valid_speaker_count(k, backend=True).alias("accepted"), config.cluster_count(k).alias("clusters"), config.valid_threshold("value").alias("threshold"))


WANTED = "['auto', 'fast', 'balanced', 'quality', 'fast_en'][o_orderkey % 5 + 1]"


@query(f"""with m as (select * from (values {', '.join(f"('{p}', '{m}')" for p, m, _, _ in config.PRESETS)}) t(preset_id, model_id)), asked as (select o_orderkey, {WANTED} preset_id from orders)
select o_orderkey, case when preset_id <> 'auto' then model_id end model_id, true available from asked join m using (preset_id)""")
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a preset; all models of the catalogue are ready, and who asks for none needs none."""
    preset = F.get(F.array(*map(F.lit, ["auto", "fast", "balanced", "quality", "fast_en"])), (F.col("o_orderkey") % 5).cast("int"))
    asked = D.read(spark, sf_dir, "orders").select("o_orderkey", preset.alias("preset_id")).join(F.broadcast(config.presets(spark).select("preset_id", "model_id")), "preset_id")
    wanted = asked.select("o_orderkey", F.when(F.col("preset_id") != "auto", F.col("model_id")).alias("model_id"))
    return config.with_availability(wanted, config.models(spark)).select("o_orderkey", "model_id", "available")


@query("select l_orderkey, l_linenumber, title, cast(floor(greatest(coalesce(d, 0), 0)) as bigint) duration from (select l_orderkey, l_linenumber, l_returnflag title, case when l_linenumber % 3 > 0 then l_quantity / 4 end d from lineitem)")
def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.read(spark, sf_dir, "lineitem")
    text = F.to_json(F.struct(F.col("l_returnflag").alias("title"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") / 4).alias("duration")))
    return li.select("l_orderkey", "l_linenumber", readers.video_metadata(text).alias("v")).select("l_orderkey", "l_linenumber", "v.*")


@query("""with p as (select page_id, case when page_id % 4 = 0 then '/a/b.MP3' when page_id % 4 = 1 then 'c:\\d\\e.tar.gz' when page_id % 4 = 2 then 'f' else 'g.x/h.webm' end || case when page_id % 9 = 0 then '.part' else '' end p from pages)
select page_id, regexp_extract(p, '([^/\\\\]*)$', 1) file, lower(regexp_extract(p, '\\.([^./\\\\]+)$', 1)) kind, lower(regexp_extract(p, '\\.([^./\\\\]+)$', 1)) in ('mp3', 'webm') media, case when regexp_replace(p, '\\.[^/.]+$', '') = '' then 'transcript' else regexp_replace(p, '\\.[^/.]+$', '') end base from p""")
def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    name = F.when(i % 4 == 0, "/a/b.MP3").when(i % 4 == 1, "c:\\d\\e.tar.gz").when(i % 4 == 2, "f").otherwise("g.x/h.webm")
    p = D.read(spark, sf_dir, "pages").select(i, F.concat(name, F.when(i % 9 == 0, ".part").otherwise("")).alias("p"))
    return p.select("page_id", T.basename("p").alias("file"), readers.extension("p").alias("kind"), readers.is_media("p").alias("media"), T.export_base_name("p").alias("base"))


@query(f"with {D.SEG}, {D.NAMES} select transcript_id, pos, start_ms, k, case when end_ms - start_ms >= k * 10 then end_ms else start_ms + k * 350 end usable_ms from (select *, cast(len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) as integer) k from seg)")
def usable_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments_ms(spark, sf_dir).withColumn("k", T.word_count("text"))
    end = C.usable_end(F.col("start_ms") / 1000, F.col("end_ms") / 1000, "k")
    return s.select("transcript_id", "pos", "start_ms", "k", F.round(end * 1000).cast("long").alias("usable_ms"))


@query(f"with {D.SEG} select transcript_id, count(*) n, case when transcript_id % 5 = 0 then 'cancelled' when transcript_id % 3 = 0 then 'degraded' else 'succeeded' end status, case when transcript_id % 5 <> 0 and transcript_id % 3 = 0 then 'crash' end reason, case when transcript_id % 5 <> 0 and transcript_id % 3 <> 0 then count(*) else -1 end turns from seg group by 1")
def diarization_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("transcript_id")
    turn = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker_id").alias("speaker"))
    runs = D.segments_ms(spark, sf_dir).groupBy("transcript_id").agg(F.count("*").alias("n"), F.collect_list(turn).alias("turns"))
    runs = runs.withColumns({"speaker_count": F.lit(1), "reason": F.when(i % 3 == 0, "crash"), "cancelled": i % 5 == 0, "ok": i % 3 != 0})
    return store.outcomes(runs).select("transcript_id", "n", "status", "reason", F.when(F.col("status") == "succeeded", F.size("turns").cast("long")).otherwise(-1).alias("turns"))


@query(f"""with {D.TRANSCRIPTS}, nw as (select *, row_number() over (partition by source_id, model_id, language order by doc_id desc) k from (select source_id, model_id, language, doc_id + 1 doc_id, 'j' || doc_id job from tr where doc_id % 3 = 0))
select source_id, model_id, language, cast(coalesce(nw.doc_id, tr.doc_id) as varchar) full_text from tr left join nw using (source_id, model_id, language)""")
def persisted_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = "array<struct<start:double,end:double,text:string,speaker:string>>"
    none = F.lit(None).cast(seg)
    t = D.transcripts(spark, sf_dir)
    stored = t.select(*store.RECIPE, F.col("doc_id").cast("string").alias("full_text"), none.alias("segments"))
    job = F.concat(F.lit("j"), "doc_id")
    work = t.where("doc_id % 3 = 0").select(job.alias("id"), *store.RECIPE, F.lit("ready").alias("status"), F.lit(0.5).alias("progress"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("full_text"))
    new = t.where("doc_id % 3 = 0").select(job.alias("job_id"), *store.RECIPE, (F.col("doc_id") + 1).cast("string").alias("full_text"), none.alias("segments"), F.col("doc_id").alias("seq"))
    names = spark.createDataFrame([], "source_id long, speaker_key string, display_name string, seq long")
    return store.persist_transcripts(stored, work, names, new)["transcripts"].select("source_id", "model_id", "language", "full_text")


@query("select o_orderkey id, case o_orderstatus when 'F' then 'failed' when 'O' then 'ready' else 'failed' end status, o_orderpriority is not null prioritised from orders")
def stored_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "O", "ready").otherwise(F.col("o_orderstatus"))
    o = D.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), store.read_enum(s, store.STATUSES, "failed").alias("status"), F.col("o_orderpriority").isNotNull().alias("prioritised"))


@query("select o_orderkey id, o_custkey source_id from orders where o_custkey % 10 = 0")
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"))
    empty = D.transcripts(spark, sf_dir).where("doc_id < 0")
    bad = store.violations(empty, D.sources(spark, sf_dir).select("id", "source_type", "source_key"), o).where("rule = 'job without source'")
    return o.join(bad.select(F.col("id").cast("long").alias("source_id")).distinct(), "source_id", "left_semi").select("id", "source_id")


@query(f"with {D.SEG}, e as (select *, lag(end_ms) over (partition by transcript_id order by pos) pe from seg where trim(text) <> '') select transcript_id, pos, coalesce(start_ms + 300 < pe + 600, false) as \"overlaps\" from e")
def overlap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments_ms(spark, sf_dir).where(T.trim_space("text") != "")
    s = s.withColumns({"start": F.col("start_ms") + 300, "end": F.col("end_ms") + 600})
    return s.select("transcript_id", "pos", tokens.overlaps_before().alias("overlaps"))


@query(f"""with {D.SEG}, f as (select *, replace(text, chr(10), ' ') flat, regexp_extract(text, '^[^A-Za-z]*', 0) head, lead(pos) over w is null final, lag(replace(text, chr(10), ' ')) over w before from seg window w as (partition by transcript_id order by pos)),
g as (select *, '[.!?。！？…]["''”’)\\]]*$' ends from f)
select transcript_id, pos, case when before is null or regexp_matches(before, ends) then head || upper(substr(text, length(head) + 1, 1)) || substr(text, length(head) + 2) else text end || case when final and not regexp_matches(flat, ends) then '.' else '' end as text from g""")
def cue_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.sentence_case(D.seconds(D.segments_ms(spark, sf_dir))).select("transcript_id", "pos", "text")


@query("""with w as (select user_id, event_id, 'w' || event_id t, event_id % 3 <> 0 or event_id = min(event_id) over (partition by user_id) opens, event_id * 0.5::double s, event_id * 0.5::double + value e from events),
i as (select *, sum(opens::int) over (partition by user_id order by event_id rows unbounded preceding) island from w)
select user_id transcript_id, min(event_id) pos, string_agg(t, '' order by event_id) as text, min(s) as start, max(e) as "end" from i group by user_id, island""")
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.concat(F.when(i % 3 != 0, " ").otherwise(""), F.lit("w"), i.cast("string"))
    words = D.read(spark, sf_dir, "events").select(F.col("user_id").alias("transcript_id"), i.alias("pos"), text.alias("text"), (i * 0.5).alias("start"), (i * 0.5 + F.col("value")).alias("end"), F.lit(None).cast("string").alias("speaker"))
    return tokens.fold_continuations(words).drop("_island", "speaker")


@query(f"with {D.SEG} select transcript_id, cast(row_number() over w - 1 as bigint) pos, text, start_ms / 1000.0::double as start, coalesce(raw_end_ms / 1000.0::double, lead(start_ms / 1000.0::double) over w, start_ms / 1000.0::double + 2) as \"end\" from seg window w as (partition by transcript_id order by pos)")
def worker_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments_ms(spark, sf_dir)
    chunk = F.struct("pos", "text", F.array(F.col("start_ms") / 1000, F.col("raw_end_ms") / 1000).alias("timestamp"))
    results = s.groupBy("transcript_id").agg(F.sort_array(F.collect_list(chunk)).alias("c"))
    results = results.select("transcript_id", F.transform("c", lambda x: F.struct(x["text"].alias("text"), x["timestamp"].alias("timestamp"))).alias("chunks"))
    return tokens.chunk_segments(readers.explode_chunks(results))


@query(f"with {D.SEG} select transcript_id, cast(row_number() over (partition by transcript_id order by pos) - 1 as integer) idx, cast(cast(start_ms / 1000.0::double as float) as double) as start, cast(cast(end_ms / 1000.0::double as float) as double) as \"end\", speaker_id speaker from seg")
def engine_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("pos", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker_id").alias("speaker"))
    answers = D.segments_ms(spark, sf_dir).groupBy("transcript_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["speaker"].alias("speaker"))).alias("turns"))).alias("answer"))
    return readers.explode_turns(answers.select("transcript_id", readers.parse_turns("answer").alias("turns")))


@query("""select event_id, case when event_id % 11 = 0 then 0 else 1 + event_id % 2 end::integer channels, case when event_id % 11 = 0 then 0 when event_id % 3 = 0 then 44100 else 16000 end::integer sample_rate, case when event_id % 11 = 0 then 0 when event_id % 5 = 0 then 24 else 16 end::integer bits,
  case when event_id % 11 = 0 then 'not a WAVE file' when event_id % 7 = 0 then 'not PCM' when event_id % 5 = 0 then 'not 16 bits' end error from events""")
def wave_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")

    def little(x, n: int):
        x = x if not isinstance(x, int) else F.lit(x)
        return F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(n)])

    letters = lambda s: F.lit(s.encode().hex())
    channels, rate, bits = 1 + i % 2, F.when(i % 3 == 0, 44100).otherwise(16000), F.when(i % 5 == 0, 24).otherwise(16)
    form = F.concat(letters("fmt "), little(16, 4), little(F.when(i % 7 == 0, 3).otherwise(1), 2), little(channels, 2), little(rate, 4), little(rate * 2, 4), little(2, 2), little(bits, 2))
    odd = F.when(i % 4 == 0, F.concat(letters("LIST"), little(3, 4), letters("abc"), F.lit("00"))).otherwise(F.lit(""))
    content = F.unhex(F.concat(F.when(i % 11 == 0, letters("RIFX")).otherwise(letters("RIFF")), little(100, 4), letters("WAVE"), odd, form, letters("data"), little(0, 4)))
    return D.read(spark, sf_dir, "events").select("event_id", readers.wav_header(content).alias("h")).select("event_id", "h.*")


@query(f"with {D.SOURCES} select id, case when audio_path is null then 'no audio' when id % 4 <> 0 then 'audio file is missing' end error from src")
def audio_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.sources(spark, sf_dir).select("id", "audio_path")
    return readers.prepared_audio(s, s.where("id % 4 = 0").select(F.col("audio_path").alias("path"))).select("id", "error")


@query("select 'm-' || lower(n_name) model_id from nation where n_nationkey > 0")
def configured_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit('{ id: "p'), "n_nationkey", F.lit('", modelId: "'), F.when(F.col("n_nationkey") == 0, "__auto__").otherwise(F.concat(F.lit("m-"), F.lower("n_name"))), F.lit('" },'))
    return readers.model_list(D.read(spark, sf_dir, "nation").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("value")))
