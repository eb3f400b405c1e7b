"""Changes of jobs as a log: progress and failure are appended, snapshots are folded from it, each is published once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import unit_range

#: What a change may set; null leaves a field as it is.
FIELDS = {"status": "string", "progress": "double", "error": "string"}


def _change(rows: DataFrame, **fields: Column) -> DataFrame:
    return rows.select("job_id", "seq", *[fields.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()])


def progress_reports(rows: DataFrame) -> DataFrame:
    """Changes of (job_id, seq, progress): the progress between 0 and 1; the status is left alone."""
    return _change(rows.where(F.col("progress").isNotNull()), progress=unit_range("progress"))


def failures(rows: DataFrame) -> DataFrame:
    """Changes of (job_id, seq, message): the job fails with the message; its progress is left alone."""
    return _change(rows, status=F.lit("failed"), error=F.coalesce("message", F.lit("")))


def snapshots(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """(job_id, seq, status, progress, error) after every change of ``log`` to one of ``jobs`` (id, status, progress, error).

    Changes of a job take effect in order of ``seq``; those of unknown jobs do nothing. Each row is one snapshot to publish.
    """
    have = jobs.select(F.col("id").alias("job_id"), *[F.col(f).cast(kind).alias(f"_{f}") for f, kind in FIELDS.items()])
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.join(have, "job_id").select("job_id", "seq", *[F.coalesce(F.last(f, ignorenulls=True).over(w), f"_{f}").alias(f) for f in FIELDS])


def current(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """``jobs`` as the log leaves them: an aggregate a field, so that no job's changes have to fit a task."""
    given = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in FIELDS]
    last = log.groupBy(F.col("job_id").alias("_job")).agg(*given)
    out = jobs.join(last, jobs["id"] == last["_job"], "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in FIELDS}).select(jobs.columns)


def compact(log: DataFrame, upto: int) -> DataFrame:
    """The log with the changes up to ``upto`` as one change a job, which leaves all later snapshots as they were."""
    old, new = log.where(F.col("seq") <= upto), log.where(F.col("seq") > upto)
    given = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in FIELDS]
    return old.groupBy("job_id").agg(F.max("seq").alias("seq"), *given).select(log.columns).unionByName(new)
