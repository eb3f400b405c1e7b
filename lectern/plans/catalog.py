"""The registered queries of the timed-text operators, each with SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import config, text as T, timing as C
from ..operators import align, cues, export, store, tokens
from ..sources import readers
from ..streaming import jobs
from . import cue_sql as Q
from . import derived as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WS = r"[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def clean_sql(table: str, keys: str) -> str:
    """``cleaned`` as (keys, c): characters are walked, as the SQL dialect's patterns cannot look around."""
    return rf"""k1 as (select {keys}, trim(regexp_replace(text, '{WS}', ' ', 'g')) t from {table}),
k2 as (select {keys}, string_split(regexp_replace(t, ' +([,.;:!?])', '\1', 'g'), '') l from k1),
k3 as (select {keys}, array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when l[i] in (',', '.', ';', ':', '!', '?') and i < len(l) and l[i+1] not in (' ', '"', '''')
  and not (l[i] in ('.', ',', ':') and i > 1 and regexp_matches(l[i-1], '^[0-9]$') and regexp_matches(l[i+1], '^[0-9]$'))
  and not (l[i] = '.' and i > 1 and regexp_matches(l[i-1], '^[A-Za-z]$') and regexp_matches(l[i+1], '^[A-Za-z]$') and not (i > 2 and regexp_matches(coalesce(l[i-2], ''), '^[A-Za-z]$')))
  then l[i] || ' ' else l[i] end), '') t from k2),
cleaned as (select {keys}, trim(regexp_replace(t, '\bi\b', 'I', 'g')) c from k3)"""


@query(f"with {clean_sql('documents', 'doc_id')} select doc_id, c as cleaned from cleaned")
def clean_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "documents").select("doc_id", T.clean("text").alias("cleaned"))


@query(f"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) as integer) as words from documents")
def caption_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"))


@query(f"with {clean_sql('documents', 'doc_id')}, w as (select unnest(list_filter(string_split(c, ' '), lambda x: x <> '')) w from cleaned) "
       "select regexp_replace(lower(w), '[^a-z0-9'']+', '', 'g') word, count(*) n from w group by 1")
def normalized_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = D.read(spark, sf_dir, "documents").select(F.explode(T.split_words("text")).alias("w"))
    return words.groupBy(T.normalise_word("w").alias("word")).agg(F.count("*").alias("n"))


@query(rf"""with {clean_sql('conversations', 'conv_id, turn')},
s as (select conv_id, turn, unnest(p) c, generate_subscripts(p, 1) i from (select conv_id, turn, string_split(regexp_replace(c, '([.!?]) +', '\1' || chr(10), 'g'), chr(10)) p from cleaned)),
b as (select conv_id, turn, i, c, unnest(case when length(c) <= 42 then [0] else list_filter(range(2, length(c)), lambda j: c[j] = ' ') end) j from s),
r as (select *, case when j = 0 then c else left(c, j - 1) || chr(10) || substr(c, j + 1) end w, row_number() over (partition by conv_id, turn, i order by
  greatest(0, j - 1 - 42) + greatest(0, length(c) - j - 42), (not contains(left(c, j - 1), ' ') or not contains(substr(c, j + 1), ' '))::int, abs(j - 1 - (length(c) - j)), j) k from b),
o as (select conv_id, turn, i, c from s where length(c) > 42 and not contains(c, ' '))
select conv_id, turn, cast(i as integer) sentence, w wrapped from r where k = 1 union all select conv_id, turn, cast(i as integer), c from o""")
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = F.split(F.regexp_replace(T.clean("text"), "([.!?]) +", "$1\n"), "\n")
    rows = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(sentences).alias("i", "s"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).alias("sentence"), T.wrap("s").alias("wrapped"))


@query(f"with {D.SEG} select transcript_id, pos, coalesce(raw_end_ms, lead(start_ms) over (partition by transcript_id order by pos), start_ms + 2000) end_ms from seg")
def segment_end_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = tokens.end_fallback("start_ms", "raw_end_ms", default=2000)
    return D.segments_ms(spark, sf_dir).select("transcript_id", "pos", end.alias("end_ms"))


@query(f"""with {D.SEG}, n as (select transcript_id, pos, start_ms, coalesce(raw_end_ms, 0) e, lead(start_ms) over (partition by transcript_id order by pos) nx,
  len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) k from seg)
select transcript_id, pos, cast(case when e > start_ms then e when nx > start_ms then nx else start_ms + greatest(k * 350, 1200) end as double) effective_end from n""")
def effective_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = tokens.effective_end(F.col("start_ms") / 1000, F.coalesce("raw_end_ms", F.lit(0)) / 1000, F.lead("start_ms").over(tokens.win()) / 1000, T.word_count("text"))
    return D.segments_ms(spark, sf_dir).select("transcript_id", "pos", F.round(seconds * 1000).alias("effective_end"))


TOK = f"""{D.SEG}, {clean_sql('seg', 'transcript_id, pos')},
tw as (select transcript_id, pos, string_split(c, ' ') w from cleaned where c <> ''),
tok as (select tw.transcript_id, tw.pos, i as part, w[i] as word, start_ms + (end_ms - start_ms) * coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) // list_sum(list_transform(w, lambda x: length(x))) as start_ms
  from (select *, unnest(range(1, len(w) + 1)) i from tw) tw join seg using (transcript_id, pos))"""


@query(f"with {TOK} select transcript_id, pos, cast(part as integer) part, word, cast(start_ms as bigint) start_ms from tok")
def word_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.segments_ms(spark, sf_dir).select("transcript_id", "pos", "text", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.lit(None).cast("string").alias("speaker"))
    words = tokens.split_glued(rows)  # whole milliseconds, from quotients of small numbers
    return words.select("transcript_id", "pos", (F.col("part") + 1).alias("part"), F.col("text").alias("word"), F.floor(F.col("start") + 1e-6).alias("start_ms"))


@query(f"""with {D.EVENTS}, s as (select job_id, seq, (seq % 500) * 20 s, (seq % 500) * 20 + cast(floor(progress * 100) as bigint) % 40 e from ev),
r as (select job_id, seq, 10 * row_number() over w + max(greatest(e, s + 10) - 10 * i) over (partition by job_id order by seq rows unbounded preceding) e from (select *, row_number() over (partition by job_id order by seq) i from s) window w as (partition by job_id order by seq))
select job_id, seq, cast(e as bigint) clamped_end from r""")
def monotonic_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("seq") % 500) * 20
    end = start + F.floor(F.col("progress") * 100) % 40
    return D.job_events(spark, sf_dir).select("job_id", "seq", tokens.monotone_end(start, end, "seq", "job_id", 10).cast("long").alias("clamped_end"))


@query(f"""with {D.SEG} select transcript_id, pos, cast(dense_rank() over (partition by transcript_id order by speaker_id) - 1 as integer) dense_speaker,
  cast((select count(distinct t.speaker_id) from seg t where t.transcript_id = seg.transcript_id) as integer) speaker_count from seg""")
def densify_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.densify(D.segments_ms(spark, sf_dir), speaker="speaker_id").select("transcript_id", "pos", "dense_speaker", "speaker_count")


ASSIGN = f"""{D.TURNS}, j as (select seg.transcript_id, seg.pos, seg.start_ms s0, seg.end_ms e0, speaker, greatest(0, least(end_ms, e) - greatest(start_ms, s)) o, case when start_ms >= e then start_ms - e when s >= end_ms then s - end_ms else 0 end g, idx
  from seg left join turns using (transcript_id)),
best as (select *, row_number() over (partition by transcript_id, pos order by o desc, g, idx) k from j),
labelled as (select transcript_id, pos, s0, e0, case when speaker is not null then 'SPEAKER_' || lpad(cast(speaker as varchar), cast(greatest(2, length(cast(speaker as varchar))) as integer), '0') end speaker from best where k = 1)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.segments_ms(spark, sf_dir).select("transcript_id", "pos", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))


@query(f"with {ASSIGN} select transcript_id, pos, speaker from labelled")
def assign_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.label(align.assign_speakers(_items(spark, sf_dir), D.turns_ms(spark, sf_dir), 30_000.0)).select("transcript_id", "pos", "speaker")


@query(f"with {ASSIGN} select transcript_id, pos, speaker from labelled")
def assign_speakers_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.label(align.assign_speakers(_items(spark, sf_dir), D.turns_ms(spark, sf_dir), 7_000.0)).select("transcript_id", "pos", "speaker")


@query(f"with {ASSIGN} select transcript_id, speaker, cast(sum(e0 - s0) as bigint) talk, count(*) items from labelled group by 1, 2")
def speaker_talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.talk_time(align.label(align.assign_speakers(_items(spark, sf_dir), D.turns_ms(spark, sf_dir), 30_000.0)))


RUNS = f"""{D.SEG}, ch as (select *, case when pos = min(pos) over (partition by transcript_id) or speaker_id is distinct from lag(speaker_id) over (partition by transcript_id order by pos) then 1 else 0 end f from seg),
runs as (select *, sum(f) over (partition by transcript_id order by pos rows unbounded preceding) run from ch)"""


@query(f"with {RUNS} select transcript_id, pos, cast(run as bigint) run from runs")
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.speaker_runs(D.segments_ms(spark, sf_dir), speaker="speaker_id").select("transcript_id", "pos", "run")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.seconds(D.segments_ms(spark, sf_dir)).join(F.broadcast(D.names(spark)), "speaker", "left")
    return s.withColumn("display", F.coalesce("display_name", "speaker")).drop("display_name")


NAMED = f"""{D.SEG}, {D.NAMES}, named as (select transcript_id, pos, text, start_ms / 1000.0::double s, end_ms / 1000.0::double e, coalesce(display_name, label) display from (select *, 'SPEAKER_0' || speaker_id label from seg) x left join names on label = speaker),
shown as (select *, regexp_replace(display, '[\\x00-\\x1f\\x7f]', '', 'g') who, row_number() over (partition by transcript_id order by pos) n from named)"""


def _clock(x: str, mark: str) -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', floor({x} / 3600)::bigint, floor(({x} % 3600) / 60)::bigint, floor({x} % 60)::bigint, floor(({x} % 1) * 1000)::bigint)"


@query(f"""with {NAMED} select transcript_id, string_agg(n || chr(10) || {_clock('s', ',')} || ' --> ' || {_clock('e', ',')} || chr(10) || '[' || who || ']: ' || text || chr(10), chr(10) order by pos) as document
  from shown where trim(text, ' ' || chr(10)) <> '' group by 1""")
def srt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export(_named(spark, sf_dir), "srt")


@query(f"""with {NAMED} select transcript_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {_clock('s', '.')} || ' --> ' || {_clock('e', '.')} || chr(10) || '<v ' || replace(replace(replace(who, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>' || text || '</v>' || chr(10), chr(10) order by pos) as document
  from shown where trim(text, ' ' || chr(10)) <> '' group by 1""")
def vtt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export(_named(spark, sf_dir), "vtt")


PROSE = f"""{RUNS}, joined as (select transcript_id, cast(run as bigint) run, min(pos) p0, any_value(speaker_id) speaker_id, string_agg(text, ' ' order by pos) as text from runs group by 1, 2), {clean_sql('joined', 'transcript_id, run, p0, speaker_id')},
u as (select transcript_id, run, p0, speaker_id, string_split(c, '') l from cleaned),
v as (select transcript_id, run, p0, speaker_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when l[i] >= 'a' and l[i] <= 'z' and length(l[i]) = 1 and ascii(l[i]) < 128 and (i = 1 or (i > 2 and l[i-1] = ' ' and l[i-2] in ('.', '!', '?'))) then upper(l[i]) else l[i] end), '') t from u),
turn as (select transcript_id, run, p0, speaker_id, case when t = '' or regexp_matches(t, '[.!?。！？…]["''”’)\\]]*$') then t else t || '.' end prose from v)"""


@query(f"with {PROSE} select transcript_id, run, prose from turn")
def turn_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.turn_prose(D.seconds(D.segments_ms(spark, sf_dir))).select("transcript_id", "run", "prose")


@query(f"""with {PROSE}, {D.NAMES} select transcript_id, string_agg('[' || regexp_replace(coalesce(display_name, 'SPEAKER_0' || speaker_id), '[\\x00-\\x1f\\x7f]', '', 'g') || ']: ' || prose, chr(10) || chr(10) order by p0) as document
  from turn left join names on speaker = 'SPEAKER_0' || speaker_id where prose <> '' group by 1""")
def txt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export(_named(spark, sf_dir), "txt")


def _plain(ms: str) -> str:
    return f"case when {ms} % 1000 = 0 then cast({ms} // 1000 as varchar) else cast({ms} / 1000.0::double as varchar) end"


@query(f"""with {D.SEG}, item as (select transcript_id, pos, '    {{' || chr(10) || '      "start": ' || {_plain('start_ms')} || ',' || chr(10) || '      "end": ' || {_plain('end_ms')} || ',' || chr(10)
  || '      "text": ' || cast(to_json(text) as varchar) || ',' || chr(10) || '      "speaker": "SPEAKER_0' || speaker_id || '"' || chr(10) || '    }}' t from seg where trim(text, ' ' || chr(10)) <> '')
select transcript_id, '{{' || chr(10) || '  "segments": [' || chr(10) || string_agg(t, ',' || chr(10) order by pos) || chr(10) || '  ],' || chr(10) || '  "speakerNames": {{}}' || chr(10) || '}}' as document from item group by 1""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export(_named(spark, sf_dir), "json")


@query(f"with {D.SEG}, {clean_sql('seg', 'transcript_id, pos')} select transcript_id, bool_and(c <> '' and not contains(c, ' ')) real_timings from cleaned group by 1")
def real_word_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.real_word_timings(D.segments_ms(spark, sf_dir))


TURNS_S = f"""{D.SEG}, turn_s as (select transcript_id, pos idx, (start_ms + 250) / 1000.0::double s, (end_ms + 250) / 1000.0::double e, speaker_id speaker from seg where pos % 4 <> 3)"""


def labels_sql(items: str, name: str) -> str:
    """``name``: ``items`` (transcript_id, pos, text, s, e) with the label of the turn of largest overlap, else of least gap, else the first."""
    return f"""{name} as (select * exclude (k) from (select i.*, 'SPEAKER_' || lpad(cast(speaker as varchar), 2, '0') speaker,
  row_number() over (partition by i.transcript_id, i.pos order by greatest(0, least(i.e, t.e) - greatest(i.s, t.s)) desc, case when i.s >= t.e then i.s - t.e when t.s >= i.e then t.s - i.e else 0 end, idx) k
  from {items} i join turn_s t on t.transcript_id = i.transcript_id) where k = 1)"""


CUES = f"with recursive {TURNS_S}, item as (select transcript_id, pos, text, start_ms / 1000.0::double s, end_ms / 1000.0::double e from seg), {labels_sql('item', 'base')}, {Q.token_ctes('base')}, {Q.cue_ctes()}"


@query(f'{CUES} select transcript_id, pos, text, s as start, e as "end", speaker from cue')
def consolidate_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = D.turns_ms(spark, sf_dir).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return cues.consolidate(D.seconds(D.segments_ms(spark, sf_dir)).drop("speaker"), turns=turns)


OWN_CUES = f"with recursive {D.SEG}, base as (select transcript_id, pos, text, start_ms / 1000.0::double s, end_ms / 1000.0::double e, 'SPEAKER_0' || speaker_id speaker from seg), {Q.token_ctes('base')}, {Q.cue_ctes()}"


@query(f"""{OWN_CUES}, flat as (select *, replace(text, chr(10), ' ') t, lead(pos) over (partition by transcript_id order by pos) is null final from cue)
select transcript_id, trim(string_agg(t, ' ' order by pos)) full_text from flat where not final or {Q.words_in('t')} >= 3 group by 1""")
def cue_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.full_text(cues.hide_short_tail(cues.consolidate(D.seconds(D.segments_ms(spark, sf_dir)))))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.seconds(D.segments_ms(spark, sf_dir)).select("*", F.posexplode(F.split(T.clean("text"), "(?=[ -])")).alias("i", "w"))
    n = F.row_number().over(Window.partitionBy("transcript_id").orderBy("pos", "i")) - 1
    return rows.select("transcript_id", n.cast("long").alias("pos"), F.when(F.col("i") == 0, F.concat(F.lit(" "), "w")).otherwise(F.col("w")).alias("text"), (F.col("start") + F.col("i") * 0.2).alias("start"), (F.col("start") + F.col("i") * 0.2 + 0.3).alias("end"), "speaker")


WORDS = f"""{D.SEG}, {clean_sql('seg', 'transcript_id, pos')}, pieces as (select transcript_id, pos, list_filter(string_split(regexp_replace(c, '([ -])', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '') p from cleaned),
piece as (select transcript_id, pos, unnest(p) w, generate_subscripts(p, 1) - 1 i from pieces),
word as (select transcript_id, row_number() over (partition by transcript_id order by pos, i) n, trim(w) w, start_ms / 1000.0::double + i * 0.2::double s, start_ms / 1000.0::double + i * 0.2::double + 0.3::double e, 'SPEAKER_0' || speaker_id speaker, i = 0 or w like ' %' opens from piece join seg using (transcript_id, pos)),
glued as (select *, sum((opens or n = first)::int) over (partition by transcript_id order by n rows unbounded preceding) island from (select *, min(n) over (partition by transcript_id) first from word where w <> '')),
whole as (select transcript_id, min(n) n, string_agg(w, '' order by n) as text, arg_min(s, n) s, max(e) e, arg_min(speaker, n) speaker from glued group by transcript_id, island),
placed as (select *, row_number() over (partition by transcript_id order by n) i from whole),
ended as (select *, 0.01::double * i + max(greatest(e, s + 0.01::double) - 0.01::double * i) over (partition by transcript_id order by i rows unbounded preceding) last_e from placed),
normal as (select transcript_id, i - 1 pos, text, greatest(s, coalesce(lag(last_e) over (partition by transcript_id order by i), s)) s, last_e e, speaker from ended)"""


@query(f'with {WORDS} select transcript_id, cast(pos as integer) pos, text, s as start, e as "end", speaker from normal')
def normalised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.normalise_words(_words(spark, sf_dir))


PERSISTED = f"""{TURNS_S.replace(D.SEG, WORDS)},
chunk as (select transcript_id, pos, text, start_ms / 1000.0::double s, coalesce(raw_end_ms / 1000.0::double, lead(start_ms / 1000.0::double) over (partition by transcript_id order by pos), start_ms / 1000.0::double + 2) e from seg),
stored as (select * from chunk where transcript_id % 2 = 1 union all select transcript_id, pos, text, s, e from normal where transcript_id % 2 = 0), {labels_sql('stored', 'labelled')}"""


@query(f'with {PERSISTED} select transcript_id, pos, text, s as start, e as "end", speaker from labelled')
def persisted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = D.segments_ms(spark, sf_dir).select("transcript_id", "pos", "text", (F.col("start_ms") / 1000).alias("start"), (F.col("raw_end_ms") / 1000).alias("end"))
    turns = D.turns_ms(spark, sf_dir).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return cues.rows_to_persist(chunks, _words(spark, sf_dir).where("transcript_id % 2 = 0"), turns)


@query(f"""with {D.SOURCES} select o_orderkey id, src.filename, src.audio_mime_type, case when src.audio_path is not null then '/audio/' || o_orderkey end audio_url from orders left join src on src.id = o_custkey""")
def hydrate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.lit(None).cast("string")
    o = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), empty.alias("filename"), empty.alias("audio_mime_type"))
    return store.hydrate_jobs(o, D.sources(spark, sf_dir)).select("id", "filename", "audio_mime_type", "audio_url")


LOOKUP = f"""{D.REQUESTS}, ways as (select request_id, source_id, model_id, task, language, true exact from rq union all select request_id, source_id, replace(model_id, '_timestamped', ''), task, language, false from rq),
hit as (select *, row_number() over (partition by request_id order by exact desc) k from ways join tr using (source_id, model_id, task, language))"""


@query(f"with {LOOKUP} select request_id, model_id, doc_id, exact from hit where k = 1")
def transcript_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup_transcripts(D.requests(spark, sf_dir), D.transcripts(spark, sf_dir)).select("request_id", "model_id", "doc_id", "exact")


@query(f"""with {LOOKUP}, {D.SOURCES} select rq.request_id, case when hit.request_id is not null then 'completed' when audio_path is not null then 'ready' when rq.source_id % 3 = 0 then 'downloading' else 'extracting' end status,
  hit.request_id is not null cache_hit, case when hit.request_id is not null or audio_path is not null then 1.0::double else 0.0::double end progress
  from rq left join hit on rq.request_id = hit.request_id and k = 1 left join src on src.id = rq.source_id""")
def job_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = D.requests(spark, sf_dir).withColumn("source_type", F.when(F.col("source_id") % 3 == 0, "youtube").otherwise("file"))
    routed = store.new_jobs(store.route_jobs(asked, D.transcripts(spark, sf_dir), D.sources(spark, sf_dir)))
    return routed.select("request_id", "status", "cache_hit", "progress")


@query(f"""with {D.SOURCES}, nw as (select c_custkey, case when c_custkey % 3 = 0 then 'youtube' else 'file' end source_type, c_name source_key, case when c_custkey % 4 = 0 then 'new' end filename from customer where c_custkey % 5 = 0)
select source_type, source_key, coalesce(nw.filename, src.filename) filename, src.id is null created, nw.source_key is not null touched from src full join nw using (source_type, source_key)""")
def upsert_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = F.lit("2024-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp")
    have = D.sources(spark, sf_dir).select("id", "source_type", "source_key", "filename", F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("long").alias("size_bytes"), old.alias("created_at"), old.alias("updated_at"), old.alias("last_accessed_at"))
    c = D.read(spark, sf_dir, "customer").where("c_custkey % 5 = 0")
    add = c.select(F.when(F.col("c_custkey") % 3 == 0, "youtube").otherwise("file").alias("source_type"), F.col("c_name").alias("source_key"), F.when(F.col("c_custkey") % 4 == 0, "new").alias("filename"), F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("long").alias("size_bytes"), new.alias("at"))
    out = store.upsert_sources(have, add)
    return out.select("source_type", "source_key", "filename", (F.col("created_at") == new).alias("created"), (F.col("updated_at") == new).alias("touched"))


@query(f"with {D.EVENTS} select job_id % 20 source_id, status speaker_key, arg_max(cast(run_id as varchar), seq) display_name, max(seq) seq from ev group by 1, 2")
def upsert_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.job_events(spark, sf_dir).select((F.col("job_id") % 20).alias("source_id"), F.col("status").alias("speaker_key"), F.col("run_id").cast("string").alias("display_name"), "seq")
    return store.upsert_names(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'failed' else o_orderstatus end status, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'late' end error from orders")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("error"))
    u = o.where("id % 3 = 0").select("id", F.lit("failed").alias("status"), F.when(F.col("id") % 2 == 0, "late").alias("error"))
    return store.update_fields(o, u, ["status", "error"])


@query(f"""with {D.SEG}, l as (select transcript_id, list(speaker_id order by pos) a, list(case when transcript_id % 3 = 0 then null when transcript_id % 3 = 1 and pos = 1 then 9 else speaker_id end order by pos) b from seg group by 1)
select transcript_id source_id from l where len(list_filter(a, lambda x: x is not null)) > 0 and len(list_filter(b, lambda x: x is not null)) > 0 and a is distinct from b""")
def recluster_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments_ms(spark, sf_dir)
    t = F.col("transcript_id") % 3
    other = F.when(t == 0, F.lit(None)).when((t == 1) & (F.col("pos") == 1), 9).otherwise(F.col("speaker_id"))

    def listed(speaker) -> DataFrame:
        rows = s.groupBy(F.col("transcript_id").alias("source_id")).agg(F.sort_array(F.collect_list(F.struct("pos", T.speaker_label(speaker).alias("label")))).alias("a"))
        return rows.select("source_id", F.transform("a", lambda x: F.struct(F.when(x["label"] != "SPEAKER_null", x["label"]).alias("speaker"))).alias("segments"))

    return store.labels_changed(listed(F.col("speaker_id")), listed(other))


@query("""select user_id id, max(ts) < timestamp '2024-01-20 00:00:00' - interval 168 hours and user_id % 2 = 0 expired, case when user_id % 2 = 0 and not (max(ts) < timestamp '2024-01-20 00:00:00' - interval 168 hours) then 'a' end audio_path from events group by 1""")
def expire_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = D.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").cast("timestamp").alias("last_accessed_at"))
    s = used.withColumns({"audio_path": F.when(F.col("id") % 2 == 0, "a"), "audio_mime_type": F.lit("audio/wav")})
    return store.expire_audio(s, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id", "expired", "audio_path")


VIDEO_URLS = [
    "https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=ABCDEFGHIJ_&t=3", "https://www.youtube.com/shorts/12345678901", "https://youtube.com/embed/zzzzzzzzzzz",
    "https://www.youtube.com/watch?v=short", "https://example.com/watch?v=abcdefghijk", "not an address", "https://notyoutu.be.example.com/abcdefghijk", "https://YOUTU.BE/abcdefghijk",
    "https://www.YouTube.com/watch?v=abcdefghijk", "https://www.youtube.com/watch/?v=abcdefghijk", "https://m.youtube.com.example.org/watch?v=abcdefghijk", "https://www.youtu.be//abcdefghijk/x", "https://youtu.be.example.com/abcdefghijk",
    "https://www.youtube.com/shorts/abcdefghijk/more", "https://www.youtube.com/v/abcdefghijk", "https://www.youtube.com/watch?list=v&v=abcdefghij%6B", "https://www.youtube.com/watch?vv=abcdefghijk",
]


@query("""with u as (select url from pages union all select unnest([%s])), h as (select url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) p from u),
r as (select url, case when host in ('youtu.be', 'www.youtu.be') then split_part(ltrim(p, '/'), '/', 1) when contains(host, 'youtube.com') then case when p = '/watch' then url_decode(regexp_extract(url, '[?&]v=([^&#]*)', 1))
  when starts_with(p, '/shorts/') or starts_with(p, '/embed/') then split_part(p, '/', 3) end end v from h)
select url, case when regexp_matches(v, '^[A-Za-z0-9_-]{11}$') then v end video_id from r""" % ", ".join(f"'{u}'" for u in VIDEO_URLS))
def youtube_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = D.read(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u in VIDEO_URLS], "url string"))
    return urls.select("url", T.video_id("url").alias("video_id"))


@query("""with n as (select n_name raw from nation union all select '  ' || chr(9) union all select repeat('x', 101) union all select ' A' || chr(7) || 'b ')
select raw, case when v <> '' and length(v) <= 100 then v end as value, case when v = '' then 'blank' when length(v) > 100 then 'too long' end error from (select raw, trim(regexp_replace(trim(raw, ' ' || chr(9)), '[\\x00-\\x1f\\x7f]', '', 'g')) v from n)""")
def name_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([("  \t",), ("x" * 101,), (" A\x07b ",)], "raw string")
    rows = D.read(spark, sf_dir, "nation").select(F.col("n_name").alias("raw")).unionByName(extra)
    return rows.select("raw", T.validated_name("raw").alias("v")).select("raw", "v.*")


MODEL_CASES = """select c_custkey, ['auto', 'fast', 'balanced', 'quality', 'fast_en', 'auto'][c_custkey % 6 + 1] preset_id, c_custkey % 2 = 0 gpu, case when c_custkey % 5 > 0 then c_custkey % 5 * 4.0::double end memory_gib,
  case when c_nationkey % 2 = 0 then 2 else 8 end cores, case when c_nationkey % 3 = 0 then 'translate' else 'transcribe' end task, case c_mktsegment when 'BUILDING' then 'English' when 'MACHINERY' then '' else 'fr' end as language from customer"""


@query(f"""with q as ({MODEL_CASES}), e as (select *, lower(language) in ('english', 'en') en from q),
a as (select *, case when preset_id <> 'auto' then preset_id when task = 'translate' then 'balanced' when not gpu and (coalesce(memory_gib, 4) <= 4 or cores <= 4) then case when en then 'fast_en' else 'fast' end
  when gpu and coalesce(memory_gib, 0) >= 8 and cores >= 8 then 'quality' else 'balanced' end w from e),
b as (select *, case when w = 'quality' and not gpu then 'balanced' when w = 'fast_en' and (task = 'translate' or not en) then 'balanced' else w end resolved_preset from a)
select c_custkey, preset_id, gpu, memory_gib, cores, task, case when language = '' then 'auto' else language end as language, resolved_preset,
  case resolved_preset {' '.join(f"when '{p}' then '{m}'" for p, m, _, _ in config.PRESETS)} end model_id, case when gpu then 'webgpu' else 'wasm' end device from b""")
def model_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key, nation = D.read(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    preset = F.get(F.array(*map(F.lit, ["auto", "fast", "balanced", "quality", "fast_en", "auto"])), (key % 6).cast("int"))
    language = F.when(F.col("c_mktsegment") == "BUILDING", "English").when(F.col("c_mktsegment") == "MACHINERY", "").otherwise("fr")
    asked = c.select(
        "c_custkey", preset.alias("preset_id"), (key % 2 == 0).alias("gpu"), F.when(key % 5 > 0, (key % 5 * 4).cast("double")).alias("memory_gib"), F.when(nation % 2 == 0, 2).otherwise(8).alias("cores"),
        F.when(nation % 3 == 0, "translate").otherwise("transcribe").alias("task"), language.alias("language"))
    return config.resolve_models(asked)


@query(f"with {D.EVENTS}, m as (select *, max(run_id) over (partition by job_id order by seq rows unbounded preceding) top from ev) select job_id, seq, run_id from m where run_id = top")
def supersede_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.current_runs(D.job_events(spark, sf_dir), "job_id").select("job_id", "seq", "run_id")


@query(f"""with recursive {D.EVENTS}, e as (select job_id, seq, progress::float p, row_number() over (partition by job_id order by seq) i from ev),
t(job_id, i, seq, last, passed) as (select job_id, i, seq, case when p - 0::float >= 0.02::float then p else 0::float end, p - 0::float >= 0.02::float from e where i = 1
  union all select e.job_id, e.i, e.seq, case when e.p - t.last >= 0.02::float then e.p else t.last end, e.p - t.last >= 0.02::float from t join e on e.job_id = t.job_id and e.i = t.i + 1)
select job_id, seq from t where passed""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.throttle(D.job_events(spark, sf_dir)).select("job_id", "seq")


@query(f"""with {D.EVENTS}, f as (select *, min(case when status in ('completed', 'failed') then seq end) over (partition by job_id) settled from ev)
select job_id, any_value(settled) settled, max(case when seq = settled then status end) status, count_if(settled is null or seq <= settled)::bigint events from f group by 1""")
def job_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.terminal_states(D.job_events(spark, sf_dir))


@query(f"""with {D.EVENTS}, b as (select *, lag(status) over (partition by job_id order by seq) previous from ev)
select job_id, seq, previous, status from b where previous is not null and not (previous = status or (status = 'failed' and previous not in ('completed', 'failed'))
  or (previous, status) in (('downloading', 'extracting'), ('extracting', 'ready'), ('ready', 'completed')))""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.bad_transitions(D.job_events(spark, sf_dir)).select("job_id", "seq", "previous", "status")


@query(f"with {D.EVENTS}, l as (select job_id, arg_max(status, seq) status from ev group by 1) select count(*) active_downloads from l where status = 'downloading'")
def active_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.active_downloads(D.job_events(spark, sf_dir))


@query("select doc_id, sha256(text) content_key from documents")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "documents").select("doc_id", readers.content_key(F.col("text").cast("binary")).alias("content_key"))


@query(f"with {D.SEG} select transcript_id, count(*) segments, cast(sum(start_ms) as bigint) starts, cast(count_if(pos % 2 = 0) as bigint) speakers from seg where transcript_id % 7 <> 0 group by 1 union all select distinct transcript_id, 0, cast(0 as bigint), 0 from seg where transcript_id % 7 = 0")
def parse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments_ms(spark, sf_dir)
    seg = F.struct(F.col("start_ms").cast("double").alias("start"), F.col("end_ms").cast("double").alias("end"), "text", F.when(F.col("pos") % 2 == 0, "S").alias("speaker"))
    stored = s.groupBy("transcript_id").agg(readers.write_segments(F.collect_list(seg)).alias("json"))
    broken = stored.withColumn("json", F.when(F.col("transcript_id") % 7 == 0, F.regexp_replace("json", '"text"', '"words"')).otherwise(F.col("json")))
    parsed = broken.select("transcript_id", readers.parse_segments("json").alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["start"])
    return parsed.select("transcript_id", F.size("s").cast("long").alias("segments"), total.cast("long").alias("starts"), F.size(F.filter("s", lambda x: x["speaker"].isNotNull())).cast("long").alias("speakers"))


@query(f"with {D.EVENTS} select seq, case when seq % 3 = 0 then 0.65 + least(greatest(progress, 0), 1) * 0.30 else 0.05 + least(greatest(progress, 0), 1) * 0.90 end as progress from ev")
def progress_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("seq") % 3 == 0, "youtube").otherwise("file")
    return D.job_events(spark, sf_dir).select("seq", C.job_progress(C.unit_range("progress"), kind).alias("progress"))


@query("""select seq, line, case when regexp_matches(c, '^[0-9]+:[0-9]+:[0-9.]+$') then cast(split_part(c, ':', 1) as double) * 3600 + cast(split_part(c, ':', 2) as double) * 60 + cast(split_part(c, ':', 3) as double) end as seconds
  from (select *, regexp_extract(line, 'Duration: ([^,]*)', 1) c from (select event_id seq, case when event_id % 5 = 0 then '  Duration: N/A, start' when event_id % 5 = 1 then 'frame=1' else '  Duration: ' || printf('%02d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) || '.50, start: 0' end line from events))""")
def banner_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    at = F.format_string("%02d:%02d:%02d", F.floor(e / 3600), F.floor(e / 60) % 60, e % 60)
    line = F.when(e % 5 == 0, "  Duration: N/A, start").when(e % 5 == 1, "frame=1").otherwise(F.concat(F.lit("  Duration: "), at, F.lit(".50, start: 0")))
    return D.read(spark, sf_dir, "events").select(e.alias("seq"), line.alias("line")).withColumn("seconds", C.banner_duration("line"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
