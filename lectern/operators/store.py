"""Sources, transcripts, jobs and speaker names as tables: lookups, upserts, updates and expiry, DataFrame in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RECIPE = ["source_id", "model_id", "task", "language"]
SOURCE_TYPES, TASKS = ("youtube", "file"), ("transcribe", "translate")
STATUSES = ("downloading", "extracting", "ready", "completed", "failed")
TERMINAL = ("completed", "failed")
#: From each status, those a job may go to; any may fail.
NEXT = {"downloading": ("extracting",), "extracting": ("ready",), "ready": ("completed",), "completed": (), "failed": ()}


#: The four tables. Times are timestamps here; lists of segments are kept as JSON.
SCHEMAS = {
    "sources": "id long, source_type string, source_key string, canonical_url string, filename string, audio_path string, audio_mime_type string, size_bytes long, created_at timestamp, updated_at timestamp, last_accessed_at timestamp",
    "transcripts": "id long, source_id long, model_id string, task string, language string, full_text string, segments_json string, created_at timestamp, updated_at timestamp",
    "jobs": "id string, source_id long, source_type string, source_key string, status string, progress double, cache_hit boolean, error string, filename string, audio_mime_type string, model_id string, task string, language string, full_text string, segments_json string, created_at timestamp, updated_at timestamp",
    "names": "id long, source_id long, speaker_key string, display_name string",
}


def read_enum(c, allowed: tuple, default: str) -> Column:
    """Unknown values of stored rows become ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*allowed), c).otherwise(default)


def write_enum(c, allowed: tuple) -> Column:
    """Unknown values of new rows are an error."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), F.coalesce(c, F.lit("null")))))


def by_id(table: DataFrame, value) -> DataFrame:
    return table.where(F.col("id") == value)


def by_natural_key(sources: DataFrame, source_type: str, source_key: str) -> DataFrame:
    return sources.where((F.col("source_type") == source_type) & (F.col("source_key") == source_key))


def hydrate_jobs(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with what their source adds: the job's own file name and type first, an address only where audio is there."""
    s = sources.select(F.col("id").alias("source_id"), F.col("filename").alias("_file"), F.col("audio_mime_type").alias("_mime"), F.col("audio_path").alias("_path"))
    joined = jobs.join(s, "source_id", "left")
    return joined.withColumns({
        "filename": F.coalesce("filename", "_file"), "audio_mime_type": F.coalesce("audio_mime_type", "_mime"),
        "audio_url": F.when(F.col("_path").isNotNull(), F.concat(F.lit("/audio/"), F.col("id").cast("string")))}).drop("_file", "_mime", "_path")


def source_of_job(jobs: DataFrame, job_id) -> DataFrame:
    return by_id(jobs, job_id).where("source_id is not null").select("source_id")


def speaker_names(names: DataFrame) -> DataFrame:
    """(source_id, names): a map from label to name for each source."""
    return names.groupBy("source_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("speaker_key", "display_name")))).alias("names"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(every, F.col(order)).alias("r")).select("r.*")


def upsert_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Get or create on (source_type, source_key): given fields replace, absent ones keep; both times are touched.

    New ids continue after the largest, in the order of the keys. ``new`` holds each key once.
    """
    keys = ["source_type", "source_key"]
    fields = ["canonical_url", "filename", "size_bytes"]
    n = new.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.col("at").alias("_at"))
    both = sources.join(n, keys, "full")
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = both.where("id is null")
    # ids of new rows: offset of their key's bucket plus rank inside it, so no single task sorts them all
    bucket = F.pmod(F.xxhash64(*keys), F.lit(256))
    marked = fresh.withColumn("_bucket", bucket)
    before = marked.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = marked.join(F.broadcast(before), "_bucket").withColumn("id", top + F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)))
    every = both.where("id is not null").unionByName(ranked.select(both.columns))
    touched = F.coalesce("_at", "updated_at")
    return every.withColumns({f: F.coalesce(f"_{f}", f) for f in fields} | {"created_at": F.coalesce("created_at", "_at"), "updated_at": touched, "last_accessed_at": F.coalesce("_at", "last_accessed_at")}).select(sources.columns)


def upsert_names(names: DataFrame, new: DataFrame) -> DataFrame:
    """Last write by ``seq`` wins on (source_id, speaker_key)."""
    return latest(names.unionByName(new), ["source_id", "speaker_key"], "seq")


def update_fields(table: DataFrame, updates: DataFrame, fields: list[str], key: str = "id", now: Column | None = None, stamps: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Fields that an update gives replace; null keeps. Updates of unknown keys do nothing; each key occurs once.

    With ``now`` the ``stamps`` of every updated row become that time, whether a field changes or not.
    """
    u = updates.select(key, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields])
    changes = {f: F.coalesce(f"_{f}", f) for f in fields}
    if now is not None:
        changes |= {s: F.when(F.col("_hit"), now).otherwise(F.col(s)) for s in stamps}
    return table.join(u, key, "left").withColumns(changes).select(table.columns)


SOURCE_STAMPS = ("updated_at", "last_accessed_at")


def touch(sources: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Both times of the sources of ``ids`` become ``now``."""
    return update_fields(sources, ids.select("id").distinct(), [], now=now, stamps=SOURCE_STAMPS)


def rename_sources(sources: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """``updates`` (id, filename)."""
    return update_fields(sources, updates, ["filename"], now=now, stamps=SOURCE_STAMPS)


def attach_audio(sources: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """``updates`` (id, audio_path, audio_mime_type, filename): a null file name keeps the one there is."""
    return update_fields(sources, updates, ["filename", "audio_path", "audio_mime_type"], now=now, stamps=SOURCE_STAMPS)


def start_runs(requests: DataFrame, running: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """``requests`` with accepted: the first of each job, unless that is among the ``running`` ones; error says why not."""
    busy = running.select(F.col(key).alias("_key")).distinct().withColumn("_busy", F.lit(True))
    first = requests.groupBy(F.col(key).alias("_first_key")).agg(F.min(order).alias("_first"))
    marked = requests.join(busy, F.col(key) == F.col("_key"), "left").join(first, F.col(key) == F.col("_first_key"))
    accepted = F.col("_busy").isNull() & (F.col(order) == F.col("_first"))
    return marked.withColumns({"accepted": accepted, "error": F.when(~accepted, "already running for this job")}).drop("_key", "_busy", "_first_key", "_first")


def new_jobs(requests: DataFrame) -> DataFrame:
    """Jobs with a progress of 1 if there is nothing left to prepare, else 0."""
    done = F.col("status").isin("ready", "completed")
    return requests.withColumns({"status": write_enum("status", STATUSES), "progress": F.when(done, 1.0).otherwise(0.0)})


def lookup_transcripts(requests: DataFrame, transcripts: DataFrame, key: str = "request_id") -> DataFrame:
    """For each request (key, source_id, model_id, task, language) the stored transcript of its model or the alias of that.

    The exact model comes first. Requests without a transcript do not come back.
    """
    own = requests.select(key, *RECIPE)
    ways = own.withColumn("_exact", F.lit(1)).unionByName(own.withColumn("model_id", T.model_alias("model_id")).where("model_id is not null").withColumn("_exact", F.lit(0)))
    found = ways.join(transcripts, RECIPE)
    kept = [c for c in found.columns if c not in (key, "_exact")]
    best = found.groupBy(key).agg(F.max_by(F.struct(*kept), F.col("_exact")).alias("r"), F.max("_exact").alias("exact"))
    return best.select(key, "r.*", (F.col("exact") == 1).alias("exact"))


def route_jobs(requests: DataFrame, transcripts: DataFrame, sources: DataFrame, key: str = "request_id", files: DataFrame | None = None) -> DataFrame:
    """What a request leads to: completed from a transcript, ready with its audio, else extraction or download.

    ``files`` (path) are the audio files that there are: a source whose file has gone has no audio. Without ``files`` the path
    that a source has is trusted. Completed jobs carry the text and segments of their transcript, where it has such columns.
    """
    carried = [c for c in ("full_text", "segments", "segments_json") if c in transcripts.columns]
    hits = lookup_transcripts(requests, transcripts, key).select(key, F.lit(True).alias("_hit"), *carried)
    paths = sources.select(F.col("id").alias("source_id"), F.col("audio_path").alias("path")).where("path is not null")
    audio = (paths if files is None else paths.join(files.select("path"), "path", "left_semi")).select("source_id", F.lit(True).alias("_audio"))
    joined = requests.join(hits, key, "left").join(audio, "source_id", "left")
    status = F.when(F.col("_hit"), "completed").when(F.col("_audio"), "ready").when(F.col("source_type") == "youtube", "downloading").otherwise("extracting")
    return joined.withColumns({"status": status, "cache_hit": F.coalesce("_hit", F.lit(False))}).drop("_hit", "_audio")


def labels_changed(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources whose stored names no longer fit: speakers before and now, in another sequence of labels.

    ``old`` and ``new`` hold (key, segments), an array of segments.
    """
    labels = lambda c: F.transform(c, lambda s: s["speaker"])
    spoken = lambda c: F.exists(c, lambda s: s["speaker"].isNotNull())
    both = old.select(key, F.col("segments").alias("_old")).join(new.select(key, F.col("segments").alias("_new")), key)
    return both.where(spoken("_old") & spoken("_new") & ~labels("_old").eqNullSafe(labels("_new"))).select(key)


def drop_names(names: DataFrame, sources: DataFrame) -> DataFrame:
    return names.join(sources.select("source_id"), "source_id", "left_anti")


def persist_transcripts(transcripts: DataFrame, jobs: DataFrame, names: DataFrame, new: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """The three tables after storing ``new`` (job_id, recipe, full_text, segments, seq).

    Only jobs that exist and have not failed take part; a result whose recipe is not that of its job is an error. The
    transcript of a recipe is replaced, the job completes without error and gets text and segments, and names go where
    the labels changed. With ``now`` the rows that change get that time, where the tables have one.
    """
    owners = jobs.where("status <> 'failed'").select(F.col("id").alias("job_id"), *[F.col(c).alias(f"_{c}") for c in RECIPE])
    right = F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RECIPE]), lambda x: x)
    checked = F.when(right, F.col("full_text")).otherwise(F.raise_error(F.concat(F.lit("a result does not match the recipe of job "), F.col("job_id").cast("string"))))
    fits = new.join(owners, "job_id").withColumn("full_text", checked).select(new.columns)
    timed = lambda t, hit: {} if now is None or "updated_at" not in t.columns else {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if now is not None:
        fits = fits.withColumns({c: now for c in ("created_at", "updated_at") if c in transcripts.columns})
    fresh = latest(fits, RECIPE, "seq")
    if "created_at" in transcripts.columns and now is not None:  # a replaced transcript keeps the time it was first stored
        older = transcripts.select(*RECIPE, F.col("created_at").alias("_created"))
        fresh = fresh.join(older, RECIPE, "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    kept = transcripts.join(fresh.select(RECIPE), RECIPE, "left_anti")
    stored = kept.unionByName(fresh.select(transcripts.columns))
    done = fits.groupBy(F.col("job_id").alias("id")).agg(F.max_by(F.struct("full_text", "segments"), "seq").alias("_result")).withColumn("_done", F.lit(True))
    hit = F.coalesce("_done", F.lit(False))
    changes = {"status": F.when(hit, "completed").otherwise(F.col("status")), "progress": F.when(hit, 1.0).otherwise(F.col("progress")), "error": F.when(~hit, F.col("error"))}
    for c in ("full_text", "segments"):
        if c in jobs.columns:
            changes[c] = F.when(hit, F.col(f"_result.{c}")).otherwise(F.col(c))
    finished = jobs.join(done, "id", "left").withColumns(changes | timed(jobs, hit)).select(jobs.columns)
    before = transcripts.join(fresh.select(*RECIPE, F.col("segments").alias("_new")), RECIPE)
    pairs = before.select("source_id", "segments", "_new")
    moved = labels_changed(pairs.select("source_id", "segments"), pairs.select("source_id", F.col("_new").alias("segments"))).distinct()
    return {"transcripts": stored, "jobs": finished, "names": drop_names(names, moved)}


def expire_audio(sources: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """Audio not used for so long is forgotten; the row stays. ``expired`` tells which rows changed."""
    old = F.col("audio_path").isNotNull() & (F.col("last_accessed_at") < now - F.make_interval(hours=F.lit(hours)))
    gone = F.coalesce(old, F.lit(False))
    return sources.withColumns({"audio_path": F.when(~gone, F.col("audio_path")), "audio_mime_type": F.when(~gone, F.col("audio_mime_type")), "expired": gone})


def outcomes(runs: DataFrame) -> DataFrame:
    """``runs`` (turns array, speaker_count, reason, cancelled, ok) with an outcome: the cancel flag decides, not the message.

    No speech (an empty list of turns), a degraded run and a cancelled one stay apart.
    """
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("ok"), "succeeded").otherwise("degraded")
    return runs.withColumn("status", status).withColumns({
        "turns": F.when(F.col("status") == "succeeded", F.coalesce("turns", F.expr("cast(array() as array<struct<start:double,end:double,speaker:int>>)"))),
        "speaker_count": F.when(F.col("status") == "succeeded", F.coalesce("speaker_count", F.lit(0))), "reason": F.when(F.col("status") == "degraded", F.coalesce("reason", F.lit("unknown")))})


def violations(transcripts: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows that break the references and unique keys of the tables: (rule, id as text)."""
    known = sources.select(F.col("id").alias("source_id"))
    orphan = lambda t, rule: t.where("source_id is not null").join(known, "source_id", "left_anti").select(F.lit(rule).alias("rule"), F.col("source_id").cast("string").alias("id"))
    twice = lambda t, keys, rule: t.groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("id"))
    return orphan(transcripts, "transcript without source").unionByName(orphan(jobs, "job without source")).unionByName(twice(transcripts, RECIPE, "recipe stored twice")).unionByName(twice(sources, ["source_type", "source_key"], "source stored twice"))
