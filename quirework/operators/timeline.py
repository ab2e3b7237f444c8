"""Time-ordered series: growth curves, heartbeat gaps, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import chunks

# Fixed values ------------------------------------------------------------------
MIN_SPAN_DAYS = 6
RESPONSIVE_MS = 250
PROGRESS_CAP = 99
# -------------------------------------------------------------------------------

HOUR_MICROS = 3_600_000_000


def _hour(ts: str) -> Column:
    return chunks.by_width(F.unix_micros(F.col(ts)), HOUR_MICROS)


def growth_curve(
    events: DataFrame, ts: str, created: Column, tie: str, key: list[str] = [], generated_on: Column | None = None
) -> DataFrame:
    """Step points of a running count: value before and after each event.

    Adds one start point, at the earlier of ``created`` and the first event but at least
    six days before the end, and one end point. The curve ends with the day of ``generated_on``, and
    later events stand there; without it with the day of the last event.
    """
    counted = chunks.scan(
        events.select(*key, ts, tie), key, [F.col(ts), F.col(tie)], _hour(ts), after=chunks.count()
    )
    day_end = lambda c: F.date_trunc("day", c) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    at = F.col(ts) if generated_on is None else F.least(F.col(ts), day_end(generated_on))
    steps = counted.select(
        *key, at.alias("at"), F.explode(F.array(
            F.struct(F.lit("before").alias("point"), (F.col("after") - 1).alias("value")),
            F.struct(F.lit("after").alias("point"), F.col("after").alias("value")),
        )).alias("p"),
    ).select(*key, "at", "p.*")
    bounds = events.groupBy(*key).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    end = day_end(F.col("_last") if generated_on is None else generated_on)
    start = F.least(created, F.col("_first"), F.col("_end") - F.expr(f"INTERVAL '{MIN_SPAN_DAYS}' DAY"))
    ends = bounds.withColumn("_end", end).select(
        *key, F.explode(F.array(
            F.struct(start.alias("at"), F.lit("start").alias("point"), F.lit(0).cast("long").alias("value")),
            F.struct(F.col("_end").alias("at"), F.lit("end").alias("point"), F.col("_n").alias("value")),
        )).alias("p"),
    ).select(*key, "p.*")
    return steps.unionByName(ends)


def heartbeat_gaps(
    ticks: DataFrame, key: list[str], ts: str, context: str, tie: str, limit_ms: float = RESPONSIVE_MS
) -> DataFrame:
    """Ticks, largest gap with the context of the tick ending it, and responsiveness."""
    rows = chunks.scan(ticks, key, [F.col(ts), F.col(tie)], _hour(ts), _before=chunks.last_before(F.col(ts)))
    gap = (F.unix_micros(ts) - F.unix_micros("_before")) / 1000
    # The earliest of several equal gaps wins, as the largest so far is replaced only by a larger one.
    best = F.max_by(context, F.when(F.col("gap").isNotNull(), F.struct(F.col("gap"), -F.unix_micros(ts), -F.col(tie))))
    return (
        rows.withColumn("gap", gap).groupBy(*key)
        .agg(F.count(F.lit(1)).alias("ticks"), F.max("gap").alias("max_gap_ms"), best.alias("max_gap_context"))
        .withColumn("responsive", F.coalesce(F.col("max_gap_ms") < limit_ms, F.lit(True)))
    )


def monotonic_progress(events: DataFrame, key: list[str], seq: str = "seq", value: str = "progress") -> DataFrame:
    """Progress clamped to 0..100, reported as a running maximum of at most 99."""
    clamped = F.least(F.greatest(F.col(value), F.lit(0)), F.lit(100))
    rows = events.withColumn("_v", clamped)
    run = chunks.scan(
        rows, key, [F.col(seq)], chunks.by_width(F.col(seq)),
        reported=chunks.max_upto(F.least(F.col("_v"), F.lit(PROGRESS_CAP))),
        _before=chunks.last_before(F.col("_v")),
    )
    return run.withColumn("rises", F.coalesce(F.col("_v") >= F.col("_before"), F.lit(True))).drop("_v", "_before")


def progress_summary(progress: DataFrame, key: list[str]) -> DataFrame:
    """Updates, last reported value and whether the raw values never fell."""
    return progress.groupBy(*key).agg(
        F.count(F.lit(1)).alias("updates"), F.max("reported").alias("reported"),
        F.bool_and("rises").alias("monotonic"),
    )
