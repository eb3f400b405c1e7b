"""Queries over changes: job logs and their settlement, bucketed tables, caption files, argument lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arguments
from ..operators import buckets, changes, export
from ..sources import files
from ..streaming import stateful
from . import derived as D
from .catalog import NAMED, _clock, _named, query


@query(f"""with {D.EVENTS}, o as (select *, lag(status) over w previous, sum((status in ('completed', 'failed'))::int) over (w rows unbounded preceding) ended from ev window w as (partition by job_id order by ts, seq))
select job_id, seq, status, previous, not (previous is null or previous = status or status = 'failed' or (previous, status) in (('downloading', 'extracting'), ('extracting', 'ready'), ('ready', 'completed'))) bad, status in ('completed', 'failed') settled
from o where ended = 0 or (ended = 1 and status in ('completed', 'failed'))""")
def job_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.settled_events(D.job_events(spark, sf_dir)).drop("ts")


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Jobs of customers, without every seventh, and the changes that the events are: an error fails a job, all else reports progress."""
    jobs = D.read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.lit("downloading").alias("status"), F.lit(0.0).alias("progress"), F.lit(None).cast("string").alias("error"))
    e = D.job_events(spark, sf_dir)
    failed = changes.failures(e.where("status = 'failed'").withColumn("message", F.concat(F.lit("run "), "run_id")))
    return jobs, changes.progress_reports(e.where("status <> 'failed'")).unionByName(failed)


LOG = f"""{D.EVENTS}, j as (select c_custkey id from customer where c_custkey % 7 <> 0),
log as (select job_id, seq, case when status = 'failed' then 'failed' end status, case when status <> 'failed' then least(greatest(progress, 0), 1) end progress, case when status = 'failed' then 'run ' || run_id end error from ev join j on j.id = job_id)"""


@query(f"""with {LOG} select job_id, seq, coalesce(last_value(status ignore nulls) over w, 'downloading') status, coalesce(last_value(progress ignore nulls) over w, 0.0::double) progress, last_value(error ignore nulls) over w error
from log window w as (partition by job_id order by seq rows unbounded preceding)""")
def job_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshots(*_log(spark, sf_dir))


@query(f"""with {LOG}, l as (select job_id, arg_max(status, seq) filter (status is not null) status, arg_max(progress, seq) filter (progress is not null) progress, arg_max(error, seq) filter (error is not null) error from log group by 1)
select id, coalesce(status, 'downloading') status, coalesce(progress, 0.0::double) progress, error from j left join l on id = job_id""")
def job_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, log = _log(spark, sf_dir)
    return changes.current(jobs, changes.compact(log, 5_000))


@query(f"""with {D.EVENTS}, e as (select job_id source_id, status speaker_key, cast(run_id as varchar) display_name, seq from ev), taken as (select * from e where seq % 2 = 0 or source_id % 10 = 1)
select source_id, speaker_key, arg_max(display_name, seq) display_name, max(seq) seq from taken group by 1, 2""")
def bucket_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names stored in buckets, of which the second half's changes to a tenth of the sources rewrite few."""
    e = D.job_events(spark, sf_dir).select(F.col("job_id").alias("source_id"), F.col("status").alias("speaker_key"), F.col("run_id").cast("string").alias("display_name"), "seq")
    table = buckets.BucketTable(spark, files.shared_folder(spark, "names"), "source_id long, speaker_key string, display_name string, seq long", ["source_id"])
    from ..operators.store import latest

    table.create(latest(e.where("seq % 2 = 0"), ["source_id", "speaker_key"], "seq"))
    buckets.merge_names(table, e.where("seq % 2 = 1 and source_id % 10 = 1"))
    return table.read()


@query(f"""with {NAMED} select cast(transcript_id as varchar) || '.srt' file, sha256(string_agg(n || chr(10) || {_clock('s', ',')} || ' --> ' || {_clock('e', ',')} || chr(10) || '[' || who || ']: ' || text || chr(10), chr(10) order by pos)) content_key
  from shown where trim(text, ' ' || chr(10)) <> '' group by transcript_id""")
def caption_file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption files written by tasks and published by the commit, then digested block by block."""
    folder = files.shared_folder(spark, "captions")
    export.export(_named(spark, sf_dir), "srt", folder)
    keys = files.content_keys(files.listed(spark, folder, media=False))
    return keys.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content_key")


ARGS = """['--wav', '/a/' || o_orderkey || '.wav', '--segmentation-model', 's.onnx', '--embedding-model', 'e.onnx']"""
VARIANTS = [
    ("{a} || ['--num-speakers', cast(o_custkey % 90 as varchar)]", ["--num-speakers", "{n}"]),
    ("{a} || ['--cluster-threshold', '0.' || (o_custkey % 10)]", ["--cluster-threshold", "{t}"]),
    ("{a}[3:]", None),
    ("{a} || ['--num-speakers']", ["--num-speakers"]),
    ("{a} || ['--verbose', 'x', '--num-speakers', '-1']", ["--verbose", "x", "--num-speakers", "-1"]),
    ("{a} || ['--num-speakers', '-1', '--verbose']", ["--num-speakers", "-1", "--verbose"]),
    ("{a} || ['--cluster-threshold', 'nan']", ["--cluster-threshold", "nan"]),
    ("{a} || ['--wav', '/b.wav', '--num-speakers', '+3']", ["--wav", "/b.wav", "--num-speakers", "+3"]),
    ("[]::varchar[]", []),
    ("{a} || ['--num-speakers', '0', '--cluster-threshold', '1e39']", ["--num-speakers", "0", "--cluster-threshold", "1e39"]),
]


def _args_sql() -> str:
    return "case o_orderkey % 10 " + " ".join(f"when {i} then {sql.format(a=ARGS)}" for i, (sql, _) in enumerate(VARIANTS)) + " end"


@query(f"""with a as (select o_orderkey, {_args_sql()} args from orders),
p as (select *, list_transform(range(1, len(args) + 1, 2), lambda i: {{'flag': args[i], 'value': args[i + 1]}}) pairs from a),
f as (select *, list_filter(list_transform(pairs, lambda p: case when p.flag not in ('--wav', '--segmentation-model', '--embedding-model', '--num-speakers', '--cluster-threshold') then 'unknown argument "' || p.flag || '"'
    when p.value is null then p.flag || ' needs a value'
    when p.flag = '--num-speakers' then case when try_cast(ltrim(p.value, '+') as uinteger) is null then '--num-speakers must be a non-negative integer, got "' || p.value || '"'
      when try_cast(ltrim(p.value, '+') as uinteger) > 64 then '--num-speakers must be between 0 and 64, got ' || cast(p.value as uinteger) end
    when p.flag = '--cluster-threshold' then case when p.value = '1e39' or not isfinite(cast(p.value as double)) or cast(p.value as double) <= 0 then '--cluster-threshold must be a positive finite number, got "' || p.value || '"' end end),
  lambda e: e is not null)[1] fault, list_transform(['--wav', '--segmentation-model', '--embedding-model', '--num-speakers', '--cluster-threshold'], lambda k: list_filter(pairs, lambda p: p.flag = k)[-1].value) given from p),
e as (select *, coalesce(fault, case when given[1] is null then '--wav is required' when given[2] is null then '--segmentation-model is required' when given[3] is null then '--embedding-model is required' end) error from f)
select o_orderkey, case when error is null then given[1] end wav, case when error is null then cast(given[4] as integer) end num_speakers, case when error is null then cast(round(1000 * cast(coalesce(given[5], '0.5') as double)) as bigint) end threshold_mil,
  case when error is null then case when cast(given[4] as integer) > 0 then cast(given[4] as integer) else -1 end end clusters, error from e""")
def engine_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine makes of argument lists, one an order."""
    o = D.read(spark, sf_dir, "orders")
    base = F.array(F.lit("--wav"), F.concat(F.lit("/a/"), "o_orderkey", F.lit(".wav")), *map(F.lit, ["--segmentation-model", "s.onnx", "--embedding-model", "e.onnx"]))
    fill = {"{n}": (F.col("o_custkey") % 90).cast("string"), "{t}": F.concat(F.lit("0."), F.col("o_custkey") % 10)}
    args = F.lit(None).cast("array<string>")
    for i, (_, more) in enumerate(VARIANTS):
        these = F.slice(base, 3, 4) if more is None else F.expr("cast(array() as array<string>)") if not more else F.concat(base, F.array(*[fill.get(m, F.lit(m)) for m in more]))
        args = F.when(F.col("o_orderkey") % 10 == i, these).otherwise(args)
    r = o.select("o_orderkey", args.alias("args")).select("o_orderkey", arguments.parse("args").alias("a"))
    return r.select("o_orderkey", "a.wav", "a.num_speakers", F.round(F.col("a.cluster_threshold") * 1000).cast("long").alias("threshold_mil"), "a.clusters", "a.error")
