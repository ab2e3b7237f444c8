"""Structured Streaming operators over job events and arriving files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirework.operators import timeline
from quirework.operators.intake import MAX_INPUT_BYTES

TERMINAL = ("completed", "failed", "cancelled")


def preflight_stream(spark: SparkSession, path: str, glob: str = "*.pdf", max_files: int = 1000) -> DataFrame:
    """Files that were not seen before, with the rules that need no content.

    The checkpoint of the query remembers the paths; a modified file is for the batch
    form (``preflight`` plus ``snapshot_diff``). The content is never read. The file source
    leaves out empty files; ``snapshot_diff`` reports them as missing.
    """
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").load(path)
    )
    reason = F.when(F.col("length") > F.lit(MAX_INPUT_BYTES), "too_large").otherwise("")
    return files.select(
        "path", F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), reason.alias("reason"),
    )


def latest_generation(stream: DataFrame, key: list[str], generation: str = "generation") -> DataFrame:
    """Per key the result of the newest generation; update mode drops older ones.

    Also the batch form: results of scans that were superseded disappear.
    """
    rest = [c for c in stream.columns if c not in (*key, generation)]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(generation), F.struct(*rest)))
    return stream.groupBy(*key).agg(F.max(generation).alias(generation), newest.alias("_n")).select(
        *key, generation, "_n.*"
    )


def progress_stream(job_event: DataFrame) -> DataFrame:
    """Reported progress per job, never above 99 before the job ends (update mode)."""
    value = F.least(F.greatest(F.col("progress"), F.lit(0)), F.lit(timeline.PROGRESS_CAP))
    return job_event.where("kind = 'progress'").groupBy("job_id").agg(F.max(value).alias("progress"))


def first_terminal(job_event: DataFrame) -> DataFrame:
    """J4 without silence: the first terminal message wins; a cancel request before it
    turns it into ``cancelled``."""
    end = F.col("kind").isin(*TERMINAL)
    order = F.struct("ts", "seq")
    return (
        job_event.groupBy("job_id").agg(
            F.min_by("kind", F.when(end, order)).alias("_kind"),
            F.min(F.when(end, order)).alias("_end"),
            F.min(F.when(F.col("kind") == "cancel_requested", order)).alias("_asked"),
        )
        .where("_kind IS NOT NULL")
        .select(
            "job_id",
            F.when((F.col("_kind") == "completed") & (F.col("_asked") < F.col("_end")), "cancelled")
            .otherwise(F.col("_kind")).alias("state"),
            F.col("_end.ts").alias("ended_at"),
        )
    )


def _columns(rows: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    """Columns of one key's new messages, their microseconds last; Spark hands them over in pieces.

    A key has few messages at a time, so whole frames would cost more than the rule that reads them.
    """
    parts = [[piece[c].to_numpy() for c in (*names, "ts")] for piece in rows]
    columns = [one[0] if len(one) == 1 else np.concatenate(one) for one in zip(*parts)]
    return [*columns[:-1], columns[-1].astype("datetime64[us]").astype("int64")]


class _TerminalStates(StatefulProcessor):
    """Four values a job: a cancel was requested, the last message, whether it is settled, the timer."""

    def __init__(self, timeout_ms: int, retain_ms: int):
        self.timeout_ms, self.retain_ms = timeout_ms, retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "asked boolean, last long, done boolean, timer long")

    def _due(self, last: int, done: bool) -> int:
        return last // 1000 + (self.retain_ms if done else self.timeout_ms)

    def _keep(self, asked: bool, last: int, done: bool, timer: int, watermark: int) -> None:
        """A timer that comes early only asks for the next one, so messages leave it alone; one that is late would not do."""
        wanted = max(self._due(last, done), watermark + 1)
        if not timer or wanted < timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
            timer = wanted
        self.job.update((asked, last, done, timer))

    def _verdict(self, key, state: str, us: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "state": [state], "ended_at": [pd.Timestamp(us, unit="us")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, last, done, timer = self.job.get() or (False, 0, False, 0)
        verdict = None
        # What came while the job was open is taken in the order of its time.
        for kind, us in _ordered(rows):
            if done and us - last >= self.retain_ms * 1000:
                asked, last, done = False, 0, False
            if not done and last and us - last >= self.timeout_ms * 1000:
                verdict, done = ("cancelled" if asked else "failed", last), True
            if not done and kind in TERMINAL:
                verdict, done = ("cancelled" if asked and kind == "completed" else kind, us), True
            asked, last = asked or kind == "cancel_requested", max(last, us)
        self._keep(asked, last, done, timer, timerValues.getCurrentWatermarkInMs())
        if verdict:
            yield self._verdict(key, *verdict)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, last, done, _ = self.job.get()
        watermark = timerValues.getCurrentWatermarkInMs()
        if self._due(last, done) > watermark:
            self._keep(asked, last, done, 0, watermark)
        elif done:
            self.job.clear()
        else:
            self._keep(asked, last, True, 0, watermark)
            yield self._verdict(key, "cancelled" if asked else "failed", last)

    def close(self) -> None:
        pass


def _ordered(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int]]:
    """(kind, microseconds) of one job's new messages by time and number."""
    kind, seq, us = _columns(rows, ["kind", "seq"])
    order = np.lexsort((seq, us))
    return zip(kind[order], us[order].tolist())


def _with_rocksdb(frame: DataFrame) -> DataFrame:
    """State with timers needs this provider; the query takes the setting when it starts."""
    frame.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    return frame


def terminal_state_stream(
    job_event: DataFrame, watermark: str = "10 minutes", timeout_ms: int = 600_000, retain_ms: int = 7 * 86_400_000
) -> DataFrame:
    """One terminal state per job; a job silent for ``timeout_ms`` of event time fails,
    or counts as cancelled when a cancel was requested.

    Silence is settled by an event-time timer once the watermark has passed it, or by the next
    message if that comes first; messages older than the watermark are dropped. A settled job is
    remembered for ``retain_ms`` of event time after its last message, so that later messages change
    nothing; then its state is deleted, and one that comes later still would open the job anew.
    """
    return (
        _with_rocksdb(job_event).withWatermark("ts", watermark).select("job_id", "ts", "seq", "kind")
        .groupBy("job_id")
        .transformWithStateInPandas(
            _TerminalStates(timeout_ms, retain_ms), "job_id long, state string, ended_at timestamp", "Append", "EventTime",
        )
    )


class _Newest(StatefulProcessor):
    """The greatest order of a key with its row; the row goes first, the order stays as a tombstone."""

    def __init__(self, fields: list[str], order: list[str], schema: str, retain_ms: int):
        self.fields, self.order, self.schema, self.retain_ms = fields, order, schema, retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.schema)
        self.mark = handle.getValueState("mark", f"{', '.join(f'o{k} long' for k in range(len(self.order)))}, last long, timer long")

    def _keep(self, order: tuple, last: int, timer: int, wait: int, watermark: int) -> None:
        wanted = max(last // 1000 + wait, watermark + 1)
        # A timer that comes early only asks for the next one, so messages leave it alone; one that is late would not do.
        if not timer or wanted < timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
            timer = wanted
        self.mark.update((*order, last, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *held, last, timer = self.mark.get() or (*[None] * len(self.order), 0, 0)
        pieces = list(rows)
        *columns, us = _columns(iter(pieces), self.order)
        at = int(np.lexsort(columns[::-1])[-1])
        order, last = tuple(int(c[at]) for c in columns), max(last, int(us.max()))
        better = held[0] is None or order > tuple(held)
        self._keep(order if better else tuple(held), last, timer, self.retain_ms, timerValues.getCurrentWatermarkInMs())
        if better:
            frame = pieces[0] if len(pieces) == 1 else pd.concat(pieces, ignore_index=True)
            # A whole row as one series would turn its numbers into one type.
            self.row.update(tuple(v.item() if hasattr(v, "item") else v for v in (frame[c].iat[at] for c in self.fields)))
            yield frame.iloc[at : at + 1][self.fields]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *held, last, _ = self.mark.get()
        watermark, there = timerValues.getCurrentWatermarkInMs(), self.row.exists()
        wait = self.retain_ms if there else 2 * self.retain_ms
        if last // 1000 + wait > watermark:
            self._keep(tuple(held), last, 0, wait, watermark)
        elif there:
            self.row.clear()
            self._keep(tuple(held), last, 0, 2 * self.retain_ms, watermark)
        else:
            self.mark.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_stream(
    events: DataFrame, key: list[str], order: list[str], watermark: str = "10 minutes", retain_ms: int = 7 * 86_400_000
) -> DataFrame:
    """J2 and J3 with bounded state: a row whenever a key's greatest ``order`` (whole numbers) rises (update mode).

    ``order`` is the generation and what decides within it (J2), or the reported progress (J3). A key
    without a message for ``retain_ms`` of event time keeps no row, only its order as a tombstone, so
    that a late superseded generation does not come back; after as long again that is deleted too.
    Within the retention the results are those of ``latest_generation`` and ``progress_stream``.
    ``events`` has ``ts``; messages older than the watermark are dropped.
    """
    fields = [c for c in events.columns if c != "ts"]
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in fields)
    return (
        _with_rocksdb(events).withWatermark("ts", watermark).groupBy(*key)
        .transformWithStateInPandas(_Newest(fields, order, schema, retain_ms), schema, "Update", "EventTime")
    )


def heartbeat_stream(ticks: DataFrame, gap_ms: int = timeline.RESPONSIVE_MS, watermark: str = "10 seconds") -> DataFrame:
    """Sessions of ticks less than ``gap_ms`` apart; each one after the first of a key is a
    stall of at least that long. Session windows that touch are merged, so the window is one
    microsecond shorter and a tick exactly ``gap_ms`` later starts a new session."""
    gap = f"{gap_ms * 1000 - 1} microseconds"
    return (
        ticks.withWatermark("ts", watermark)
        .groupBy("job_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("ticks"))
        .select("job_id", F.col("s.start").alias("first_tick"), "ticks")
    )


def run_available(stream: DataFrame, checkpoint: str, output: str, mode: str = "append") -> None:
    """Process everything available now and stop; results go to parquet, never to the driver.

    In update mode each micro-batch lands in its own folder with a ``batch_id``, so a
    replayed batch replaces itself and ``latest_generation`` picks the newest row per key.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", output).start()
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

        query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
