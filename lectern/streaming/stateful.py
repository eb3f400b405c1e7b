"""Job and worker events over streams with keyed state: settling once, open windows, files in progress.

State lives in the state store (RocksDB), key by key and entry by entry: arrivals are put there one by one, so a key's
micro-batch never has to be in memory at once, and entries go as soon as they can no longer matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.store import NEXT, TERMINAL
from .jobs import running

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTLED = "seq long, ts timestamp, status string, previous string, bad boolean, settled boolean"


def follows(previous: str | None, status: str) -> bool:
    """Whether a job may go from one status to another: the next one, the same again, or failure before it has ended."""
    return previous is None or previous == status or status in NEXT.get(previous, ()) or status == "failed" and previous not in TERMINAL


def settled_events(events: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, seq, ts, status, previous, bad, settled): events up to the first terminal one of each job, in order of (ts, seq).

    ``bad`` marks a status that does not follow from ``previous``, the one before; ``settled`` the terminal event.
    """
    w = Window.partitionBy(key).orderBy("ts", "seq")
    rows = events.select(key, "seq", "ts", "status").withColumn("previous", F.lag("status").over(w))
    ended = F.count_if(F.col("status").isin(*TERMINAL)).over(running(key, "_at"))
    rows = rows.withColumn("_at", F.struct("ts", "seq")).withColumn("_ended", ended).withColumn("settled", F.col("status").isin(*TERMINAL))
    # all before the first terminal event, and that event itself
    kept = rows.where((F.col("_ended") == 0) | (F.col("_ended") == 1) & F.col("settled"))
    # none of these has ended before, so a failure always follows
    may = [F.col("previous").isNull(), F.col("previous") == F.col("status"), F.col("status") == "failed"]
    may += [(F.col("previous") == s) & F.col("status").isin(*n) for s, n in NEXT.items() if n]
    fits = may[0]
    for m in may[1:]:
        fits = fits | m
    return kept.select(key, "seq", "ts", "status", "previous", (~F.coalesce(fits, F.lit(False))).alias("bad"), "settled")


class Settle(StatefulProcessor):
    """Waits with every event until the watermark has passed it, then gives the events of a job in order up to the terminal one.

    The terminal event clears what waits. A mark that the job is settled stays for ``keep_ms`` of event time, so that later
    events are not taken for a new job; then nothing of the job is left.
    """

    def __init__(self, key: str, keep_ms: int):
        self.key, self.keep_ms = key, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "ts long, status string")
        self.last = handle.getValueState("last", "status string, settled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled = self.last.exists() and self.last.get()[1]
        for frame in rows:
            if settled:
                continue
            for seq, ts, status in zip(frame["seq"], frame["ts"], frame["status"]):
                at = pd.Timestamp(ts).value // 1000  # microseconds
                self.waiting.updateValue((int(seq),), (at, status))  # a repeated event is the same entry
                self.handle.registerTimer(-(-at // 1000))  # the first whole millisecond that is not before it
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state = self.last.get() if self.last.exists() else None
        if state and state[1]:
            self.last.clear()
            return
        due = sorted((ts, seq[0], status) for seq, (ts, status) in self.waiting.iterator() if ts <= now * 1000)
        previous, out = state[0] if state else None, []
        for ts, seq, status in due:
            self.waiting.removeKey((seq,))
            ends = status in TERMINAL
            out.append((key[0], seq, pd.Timestamp(ts * 1000), status, previous, not follows(previous, status), ends))
            previous = status
            if ends:
                break
        if out:
            done = out[-1][-1]
            self.last.update((previous, done))
            if done:
                self.waiting.clear()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(now + self.keep_ms)
            yield pd.DataFrame(out, columns=[self.key, "seq", "ts", "status", "previous", "bad", "settled"])

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, columns: str, mode: str, time: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = StructType.fromDDL(f"{key} {rows.schema[key].dataType.simpleString()}, {columns}")
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, time)


def settle_stream(events: DataFrame, delay: str = "1 minute", key: str = "job_id", keep_ms: int = 3_600_000) -> DataFrame:
    """``settled_events`` over a stream of (key, seq, ts, status).

    Events may come out of order by up to ``delay``; what comes later than that is dropped. ``seq`` tells a job's events
    apart: one that comes again counts once. Results come when the watermark has passed them.
    """
    rows = events.select(key, "seq", "ts", "status").withWatermark("ts", delay)
    return _stateful(rows, key, Settle(key, keep_ms), SETTLED, "append", "EventTime")


class OpenWindows(StatefulProcessor):
    """The pieces of a run's last windows; a window goes once ``kept`` later ones have begun."""

    def __init__(self, key: str, kept: int):
        self.key, self.kept = key, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getMapState("pieces", "window_idx long, seq long", "text string")
        self.newest = handle.getValueState("newest", "window_idx long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, touched = self.newest.get()[0] if self.newest.exists() else -1, set()
        for frame in rows:
            for window, seq, text in zip(frame["window_idx"], frame["seq"], frame["text"]):
                if window > newest - self.kept:  # pieces of windows that are gone come too late
                    self.pieces.updateValue((int(window), int(seq)), (text,))
                    touched.add(int(window))
                newest = max(newest, int(window))
        self.newest.update((newest,))
        held: dict[int, list] = {}
        for (window, seq), (text,) in self.pieces.iterator():
            held.setdefault(window, []).append((seq, text))
        out = [(key[0], w, "".join(t for _, t in sorted(held[w])), w == newest) for w in sorted(touched)]
        for window in held:
            if window <= newest - self.kept:
                for seq, _ in held[window]:
                    self.pieces.removeKey((window, seq))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "window_idx", "text", "open"])

    def close(self) -> None:
        pass


def window_text_stream(chunks: DataFrame, key: str = "run_id", kept: int = 2) -> DataFrame:
    """``jobs.open_window_text`` over a stream of (key, window_idx, seq, text): a row for each window that got a piece, with all its text so far.

    The last row of a window is what a batch gives. A run's last ``kept`` windows are held, so pieces may come out of
    order within these; ``open`` marks the newest.
    """
    return _stateful(chunks.select(key, "window_idx", "seq", "text"), key, OpenWindows(key, kept), "window_idx long, text string, open boolean", "update", "None")


class InProgress(StatefulProcessor):
    """The files of a session that are being fetched: added by ``initiate``, moved by ``progress``, gone with ``done``."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file string", "seq long, progress double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        for frame in rows:
            for file, status, seq, progress in zip(frame["file"], frame["status"], frame["seq"], frame["progress"]):
                there = self.files.containsKey((file,))
                if status == "initiate" or status == "progress" and there:
                    value = (int(seq), 0.0 if pd.isna(progress) else float(progress))
                    self.files.updateValue((file,), value)
                    changed[file] = (key[0], file, *value, False)
                elif status == "done" and there:
                    self.files.removeKey((file,))
                    changed[file] = (key[0], file, int(seq), 1.0, True)
        if changed:
            yield pd.DataFrame(list(changed.values()), columns=[self.key, "file", "seq", "progress", "done"])

    def close(self) -> None:
        pass


def progress_stream(messages: DataFrame, key: str = "session") -> DataFrame:
    """Files in progress over a stream of (key, file, status, seq, progress), which come in order: a row for each file that changed.

    ``progress`` of a file that was never initiated is ignored, as is what follows ``done``; the state has the open files only.
    """
    return _stateful(messages.select(key, "file", "status", "seq", "progress"), key, InProgress(key), "file string, seq long, progress double, done boolean", "update", "None")
