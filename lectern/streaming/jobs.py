"""Job and worker events, batch and streaming: supersession, last state, terminal states, throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timing import PROGRESS_STEP
from ..operators.fold import in_order
from ..operators.store import NEXT, TERMINAL, latest


def running(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def current_runs(messages: DataFrame, key: str = "session", run: str = "run_id", order: str = "seq") -> DataFrame:
    """Messages of the newest run of their session at the time; those of runs already superseded leave."""
    return messages.withColumn("_newest", F.max(run).over(running(key, order))).where(F.col(run) == F.col("_newest")).drop("_newest")


def current_runs_stream(messages: DataFrame, key: str = "session", run: str = "run_id", order: str = "seq", timeout_ms: int = 3_600_000) -> DataFrame:
    """``current_runs`` over a stream: the state of a session is its newest run; idle sessions are forgotten after ``timeout_ms``."""
    schema = messages.schema

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        top = rows[run].cummax() if newest is None else rows[run].cummax().clip(lower=newest)
        state.update((int(top.iloc[-1]),))
        state.setTimeoutDuration(timeout_ms)
        yield rows[rows[run] == top]

    return messages.groupBy(key).applyInPandasWithState(keep, schema, "newest long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def last_state(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    return latest(events, [key], order)


def _settled(events: DataFrame, key: str, order: str) -> DataFrame:
    """``events`` with settled, the place of the first terminal one of their job: an aggregate and a join, so that no job has to fit a task."""
    first = events.where(F.col("status").isin(*TERMINAL)).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("settled"))
    return events.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def terminal_states(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """For each job the first terminal event, if any, and how many events come up to it."""
    seen = F.count_if(F.col("settled").isNull() | (F.col(order) <= F.col("settled")))
    return _settled(events, key, order).groupBy(key).agg(F.first("settled").alias("settled"), F.max(F.when(F.col(order) == F.col("settled"), F.col("status"))).alias("status"), seen.alias("events"))


def until_terminal(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Events up to the first terminal one of their job: what a subscriber sees."""
    return _settled(events, key, order).where(F.col("settled").isNull() | (F.col(order) <= F.col("settled"))).drop("settled")


def bad_transitions(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """Events whose status does not follow from the one before; a repeated status and a failure always do."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(order))
    allowed = F.create_map(*[x for s, n in NEXT.items() for x in (F.lit(s), F.array(*map(F.lit, n)) if n else F.expr("cast(array() as array<string>)"))])
    ended = F.col("_before").isin(*TERMINAL)
    fits = (F.col("_before") == F.col("status")) | (F.col("status") == "failed") & ~ended | F.array_contains(allowed[F.col("_before")], F.col("status"))
    return events.withColumn("_before", before).where(F.col("_before").isNotNull() & ~fits).withColumnRenamed("_before", "previous")


def throttle(events: DataFrame, key: str = "job_id", order: str = "seq", value: str = "progress", step: float = PROGRESS_STEP) -> DataFrame:
    """Progress that is at least ``step`` above what was last passed on, in single precision as in the original events.

    A value passed on raises the bar, so progress between resets is a staircase: per job at most 1 / ``step`` rows.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, last = object(), np.float32(0)
        for batch in batches:
            passed = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_numpy(zero_copy_only=False).astype(np.float32)):
                if k != job:
                    job, last = k, np.float32(0)
                passed.append(bool(v - last >= np.float32(step)))
                last = v if passed[-1] else last
            yield batch.filter(pa.array(passed, pa.bool_()))

    # what does not exceed all before it can never pass, so only new maxima reach the fold
    rising = events.withColumn("_top", F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    return in_order(rising.where(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top"), key, order).mapInArrow(keep, events.schema)


def open_window_text(chunks: DataFrame) -> DataFrame:
    """Text of each decode window of a run from pieces in order of ``seq``."""
    return chunks.groupBy("run_id", "window_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))


def first_duration(lines: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """The first duration that a media tool reports for each job."""
    return lines.where("duration is not null").groupBy(key).agg(F.min_by("duration", order).alias("duration"))


def progress_items(messages: DataFrame, order: str = "seq") -> DataFrame:
    """Files in progress: the last message of each, without those that are done."""
    return latest(messages, ["file"], order).where("status <> 'done'")


def download_counts(steps: DataFrame, key: str = "worker", order: str = "seq", change: str = "change") -> DataFrame:
    """``steps`` (key, order, change of +1 or -1) with active: a counter of each key that never falls below 0.

    Its value is the running sum, lifted by how far that has ever been below 0.
    """
    w = running(key, order)
    total = F.sum(change).over(w)
    return steps.withColumn("_total", total).withColumn("active", F.col("_total") - F.least(F.lit(0), F.min("_total").over(w))).drop("_total")


def active_downloads(events: DataFrame) -> DataFrame:
    """Jobs that are downloading now."""
    return last_state(events).where("status = 'downloading'").agg(F.count("*").alias("active_downloads"))


def throttle_stream(events: DataFrame, key: str = "job_id", order: str = "seq", value: str = "progress", step: float = PROGRESS_STEP, timeout_ms: int = 3_600_000) -> DataFrame:
    """``throttle`` over a stream: the state of a job is what was last passed on; idle jobs are forgotten after ``timeout_ms``."""

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = np.float32(state.get[0] if state.exists else 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        passed = []
        for v in rows[value].to_numpy(np.float32):
            passed.append(bool(v - last >= np.float32(step)))
            last = v if passed[-1] else last
        state.update((float(last),))
        state.setTimeoutDuration(timeout_ms)
        yield rows[passed]

    return events.groupBy(key).applyInPandasWithState(keep, events.schema, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def previews(messages: DataFrame, key: str = "session", order: str = "seq") -> DataFrame:
    """What a session shows while it is decoded: each message replaces all that came before it.

    Over a stream this is an aggregate for the update or complete output mode, one row a session as state.
    """
    return latest(messages, [key], order)


def results(messages: DataFrame, key: str = "session", order: str = "seq") -> DataFrame:
    """What a finished session leaves: the words of its last complete message, or, where it has none, the chunks."""
    done = latest(messages.where("kind = 'complete'"), [key], order)
    some = F.size(F.coalesce("words", F.expr("array()"))) > 0
    return done.withColumn("chunks", F.when(~some, F.col("chunks")))


def publish(events: DataFrame, path: str, checkpoint: str):
    """Write snapshots of a stream to a topic per job and to one for all, as folders; returns the query.

    Each batch has folders of its own, which a retry writes anew, so that no snapshot comes twice.
    """

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{path}/all/batch_id={batch_id}")
            batch.write.mode("overwrite").partitionBy("job_id").parquet(f"{path}/by_job/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).start()
