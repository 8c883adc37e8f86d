"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import names
from ..operators import blocks, raster
from ..sources import images
from ..sources.dds import DdsSource

RUN = "task_id bigint, tone string, first_ts timestamp, last_ts timestamp, repeats bigint"
RUN_COLUMNS = [c.split()[0] for c in RUN.split(", ")]
_STATE = "waiting array<struct<micros: bigint, event_id: bigint, tone: string>>, tone string, first bigint, last bigint, repeats bigint"


def collapse_stream(events: DataFrame, gap: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Sessions of equal entries with an inactivity gap; rows later than the watermark are dropped. events: ts, tone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sessions = timed.groupBy(F.session_window("ts", gap), "tone").agg(F.count(F.lit(1)).alias("repeats"))
    return sessions.select("tone", F.col("session_window.start").alias("first_ts"), "repeats")


def collapse_runs_stream(events: DataFrame, gap_seconds: float, late: str = "1 minute") -> DataFrame:
    """Runs as in operators.activity.collapse_runs(): another tone or a gap of over gap_seconds ends a run.

    Entries wait in their task's state until the watermark has passed them, then go in order of ts and event_id; a run is
    given when it has ended. Rows later than the watermark are dropped. events: task_id, event_id, ts, tone.
    """
    gap = int(gap_seconds * 1_000_000)

    def stamp(micros: int) -> pd.Timestamp:
        return pd.Timestamp(micros, unit="us", tz="UTC")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, tone, first, last, repeats = state.get if state.exists else ([], None, 0, 0, 0)
        waiting = [tuple(w) for w in waiting]
        for batch in batches:
            waiting += zip(batch["micros"].astype(int), batch["event_id"].astype(int), batch["tone"], strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda w: w[:2])
        ready, ended = [w for w in waiting if w[0] <= passed], []
        for micros, _, now in ready:
            if repeats and now == tone and micros - last <= gap:
                last, repeats = micros, repeats + 1
                continue
            if repeats:
                ended.append((key[0], tone, stamp(first), stamp(last), repeats))
            tone, first, last, repeats = now, micros, micros, 1
        waiting = waiting[len(ready) :]
        if repeats and last + gap < passed and not (waiting and waiting[0][0] - last <= gap):
            ended.append((key[0], tone, stamp(first), stamp(last), repeats))
            tone, repeats = None, 0
        if repeats or waiting:
            state.update((waiting, tone, first, last, repeats))
            due = min([w[0] for w in waiting[:1]] + [last + gap] * bool(repeats))
            state.setTimeoutTimestamp(max(due, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(ended, columns=[c.split()[0] for c in RUN.split(", ")])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(F.col("task_id").cast("bigint").alias("task_id"), "event_id", "tone", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("task_id").applyInPandasWithState(run, RUN, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class RunsOfTask(StatefulProcessor):
    """Runs of one task. Entries wait under the millisecond they belong to, and a timer takes each millisecond out once the watermark has passed it.

    An entry is written once and removed once, however many wait; timers come in order of time, so nothing is sorted but
    the entries of one millisecond.
    """

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "entries array<struct<micros: bigint, event_id: bigint, tone: string>>")
        self.run = handle.getValueState("run", "tone string, first bigint, last bigint, repeats bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            at = batch["micros"] // 1000
            for when, entries in batch.groupby(at):
                before = self.waiting.getValue((int(when),)) if self.waiting.containsKey((int(when),)) else None
                found = [tuple(e) for e in before[0]] if before else []
                found += zip(entries["micros"].astype(int).tolist(), entries["event_id"].astype(int).tolist(), entries["tone"].tolist(), strict=True)
                self.waiting.updateValue((int(when),), (found,))
                self.handle.registerTimer(int(when) + 1)
        yield pd.DataFrame([], columns=RUN_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, ended = expiredTimerInfo.getExpiryTimeInMs(), []
        kept = self.run.get() if self.run.exists() else None
        tone, first, last, repeats = kept or (None, 0, 0, 0)
        if self.waiting.containsKey((now - 1,)):
            for micros, _, what in sorted((tuple(e) for e in self.waiting.getValue((now - 1,))[0]), key=lambda e: e[:2]):
                if repeats and what == tone and micros - last <= self.gap:
                    last, repeats = micros, repeats + 1
                    continue
                if repeats:
                    ended.append((key[0], tone, _stamp(first), _stamp(last), repeats))
                tone, first, last, repeats = what, micros, micros, 1
            self.waiting.removeKey((now - 1,))
            self.handle.registerTimer((last + self.gap) // 1000 + 2)
        if repeats and last + self.gap < (now - 1) * 1000:
            ended.append((key[0], tone, _stamp(first), _stamp(last), repeats))
            repeats = 0
        if repeats:
            self.run.update((tone, first, last, repeats))
        elif kept:
            self.run.clear()
        yield pd.DataFrame(ended, columns=RUN_COLUMNS)

    def close(self) -> None:
        pass


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us", tz="UTC")


def runs_with_timers(events: DataFrame, gap_seconds: float, late: str = "1 minute") -> DataFrame:
    """collapse_runs_stream() for tasks with very many waiting entries; needs RocksDB as the session's state store.

    events: task_id, event_id, ts, tone.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(F.col("task_id").cast("bigint").alias("task_id"), "event_id", "tone", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("task_id").transformWithStateInPandas(RunsOfTask(int(gap_seconds * 1_000_000)), RUN, "append", "eventtime")


def progress_stream(progress: DataFrame, tasks: DataFrame) -> DataFrame:
    """Progress within its task's time, of a finished table of tasks (task_id, start_ts, end_ts); what comes before or after is dropped. No state is kept."""
    start, end = F.col("start_ts").cast("timestamp"), F.col("end_ts").cast("timestamp")
    timed = progress.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.join(tasks, "task_id").where((F.col("ts") >= start) & (F.col("ts") <= end)).select("task_id", "ts")


def running_progress(progress: DataFrame, starts: DataFrame, late: str = "1 minute", longest: str = "1 day") -> DataFrame:
    """task_id, event_id, ts of progress from its task's start on, as soon as both are there, also while the task runs.

    Both are streams: progress (task_id, event_id, ts) and starts (task_id, start_ts). No task runs for more than longest,
    so rows leave the state once the watermark has passed that; later ones are dropped.
    """
    timed = progress.select("task_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    begun = starts.select(F.col("task_id").alias("own"), F.col("start_ts").cast("timestamp").alias("start_ts")).withWatermark("start_ts", late)
    within = F.expr(f"task_id = own and ts >= start_ts and ts <= start_ts + interval {longest}")
    return timed.join(begun, within).select("task_id", "event_id", "ts")


def settled_progress(progress: DataFrame, starts: DataFrame, ends: DataFrame, late: str = "1 minute", longest: str = "1 day") -> DataFrame:
    """running_progress() without what came after its task's end, given once the watermark rules out that such an end comes: equal to in_task().

    ends: a stream of task_id, end_ts.
    """
    ended = ends.select(F.col("task_id").alias("own"), F.col("end_ts").cast("timestamp").alias("end_ts")).withWatermark("end_ts", late)
    after = F.expr(f"task_id = own and end_ts < ts and end_ts >= ts - interval {longest}")
    found = running_progress(progress, starts, late, longest).join(ended, after, "left_outer")
    return found.where("end_ts is null").select("task_id", "event_id", "ts")


def dds_of_new_files(files: DataFrame, folder: str, checkpoint: str, fmt: str = "8.8.8.8") -> StreamingQuery:
    """Each image of a streaming binaryFile source as a DDS file of the folder, by the streaming sink; what isn't an image makes no file."""
    uncompressed = names.is_uncompressed(fmt)
    made = images.decode(files).where("status = 'ok'")
    payload = F.col("rgba") if uncompressed else F.col("payload")
    made = made if uncompressed else blocks.bc3_of_rasters(made)
    header = raster.dds_header(F.col("width"), F.col("height"), F.lit(1), F.lit(not uncompressed))
    rows = made.select(names.convert_name(F.col("path")).alias("name"), F.concat(F.unhex(header), payload).alias("bytes"))
    files.sparkSession.dataSource.register(DdsSource)
    return rows.writeStream.format("dds").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def convert_new_files(files: DataFrame, convert: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Each file of a streaming binaryFile source once: converted and appended to target.

    A batch that is run again after a failure overwrites its own folder, so no file is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
