"""Rules for incoming files, queues, render tasks and payloads; bad rows keep a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import chunks, scalars

# Fixed values ------------------------------------------------------------------
MAX_INPUT_BYTES = 4 * scalars.GIB
MAX_TOTAL_BYTES = 16 * scalars.GIB
QUEUE_CAP = 100
MAX_ID = 1_000_000
DPI_RANGE, QUALITY_RANGE = (24, 1200), (35, 100)
MAX_COORDINATE = 1_000_000
MAX_TASK_PIXELS, MAX_BATCH_PIXELS, MAX_BATCH_TASKS = 100_000_000, 2_000_000_000, 4096
MIN_PAYLOAD, MAX_PAYLOAD = 4, 64 * scalars.MIB
JPEG_START, JPEG_END = "FFD8", "FFD9"
# -------------------------------------------------------------------------------


def preflight(files: DataFrame, max_bytes: int = MAX_INPUT_BYTES) -> DataFrame:
    """B1: the first rule a file breaks, or an empty reason; bad rows lose their page count.

    ``files`` has path, size_bytes (null when missing), pages, has_forms, needs_pass,
    is_pdf and the size/time seen after the inspection as size_after, modified_after.
    """
    reason = (
        F.when(F.col("size_bytes").isNull(), "missing")
        .when(~F.lower("path").endswith(".pdf"), "not_a_pdf_name")
        .when(F.col("size_bytes") > max_bytes, "too_large")
        .when(F.coalesce("needs_pass", F.lit(False)), "password")
        .when(~F.coalesce("is_pdf", F.lit(False)) | (F.coalesce("pages", F.lit(0)) <= 0), "no_pages")
        .when(
            ~F.col("size_bytes").eqNullSafe(F.col("size_after"))
            | ~F.col("modified_ns").eqNullSafe(F.col("modified_after")),
            "changed",
        )
        .otherwise("")
    )
    good = F.col("reason") == ""
    return (
        files.withColumn("reason", reason)
        .withColumn("pages", F.when(good, F.col("pages")).otherwise(F.lit(0)))
        .withColumn("has_forms", good & F.coalesce("has_forms", F.lit(False)))
    )


def admit(queue: DataFrame, incoming: DataFrame, cap: int = QUEUE_CAP) -> DataFrame:
    """Status of every incoming path: added, duplicate, invalid or overflow.

    ``queue`` has queue_id, path; ``incoming`` queue_id, ord, path, is_valid. Paths compare
    without case. Only the first valid occurrence of a new path can take a place.
    """
    held = queue.select("queue_id", F.lower("path").alias("_path")).distinct()
    known = held.withColumn("_held", F.lit(True))
    sizes = held.groupBy("queue_id").agg(F.count(F.lit(1)).alias("_size"))
    rows = incoming.withColumn("_path", F.lower("path")).join(known, ["queue_id", "_path"], "left")
    firsts = (
        rows.where("is_valid AND _held IS NULL").groupBy("queue_id", "_path").agg(F.min("ord").alias("_first"))
    )
    ranked = chunks.scan(
        firsts, ["queue_id"], [F.col("_first")], chunks.by_width(F.col("_first")), _rank=chunks.count()
    ).join(sizes, "queue_id", "left").select(
        "queue_id", "_path", "_first", (F.col("_rank") + F.coalesce("_size", F.lit(0)) <= cap).alias("_fits")
    )
    later = (F.col("ord") > F.col("_first")) & F.col("_fits")
    status = (
        F.when(F.col("_held") | F.coalesce(later, F.lit(False)), "duplicate")
        .when(~F.col("is_valid"), "invalid")
        .when(F.col("_fits"), "added")
        .otherwise("overflow")
    )
    return rows.join(ranked, ["queue_id", "_path"], "left").withColumn("status", status).select(
        *incoming.columns, "status"
    )


def admission_counts(admitted: DataFrame) -> DataFrame:
    """The four counters per queue."""
    return admitted.groupBy("queue_id").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("added", "duplicate", "invalid", "overflow"))
    )


def queue_summary(queue: DataFrame, inspected: DataFrame, key: list[str] = ["queue_id"]) -> DataFrame:
    """Ready, failed and pending inputs, pages, bytes and one status per queue.

    ``queue`` has the key, path, size_bytes; ``inspected`` has path, pages, reason.
    """
    known = inspected.select("path", F.col("pages").alias("_pages"), F.col("reason").alias("_reason"))
    ready = F.col("_reason") == ""
    totals = queue.join(known, "path", "left").groupBy(*key).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(ready).alias("ready"),
        F.count_if(F.col("_reason") != "").alias("failed"),
        F.count_if(F.col("_reason").isNull()).alias("pending"),
        F.coalesce(F.sum(F.when(ready, F.col("_pages"))), F.lit(0)).alias("pages"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
    )
    status = (
        F.when(F.col("files") < 2, "need_more")
        .when(F.col("failed") > 0, "has_failed")
        .when(F.col("bytes") > MAX_TOTAL_BYTES, "too_large")
        .when(F.col("pending") > 0, "pending")
        .otherwise("ready")
    )
    return totals.withColumn("status", status).withColumn("mergeable", F.col("status") == "ready")


def _between(name: str, limits: tuple[int, int]) -> Column:
    return F.coalesce(F.col(name).between(*limits), F.lit(False))


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """``reason`` per render task; rules on the whole batch are reported on its rows.

    Batch totals come from aggregates joined back, not from a window over the batch.
    """
    sides = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    finite = F.lit(True)
    for side in sides:
        finite = finite & F.coalesce(~F.isnan(side) & (F.abs(side) <= MAX_COORDINATE), F.lit(False))
    pixels = (F.col("x1") - F.col("x0")) * F.col("dpi") / 72 * ((F.col("y1") - F.col("y0")) * F.col("dpi") / 72)
    row = (
        F.when(~_between("id", (0, MAX_ID)), "task_id")
        .when(~_between("page_no", (0, MAX_ID)), "page_number")
        .when(~_between("group_id", (0, MAX_ID)), "group_id")
        .when(~_between("dpi", DPI_RANGE), "dpi")
        .when(~_between("quality", QUALITY_RANGE), "quality")
        .when(~finite, "coordinates")
        .when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "no_area")
        .when(pixels > MAX_TASK_PIXELS, "task_pixels")
    )
    checked = tasks.withColumn("_row", row)
    sound = checked.where("_row IS NULL")
    batch = (
        checked.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_tasks"))
        .join(sound.groupBy("batch_id").agg(F.sum(pixels).alias("_pixels")), "batch_id", "left")
    )
    repeated = checked.groupBy("batch_id", "id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    reason = (
        F.when(F.col("_tasks") > MAX_BATCH_TASKS, "batch_tasks")
        .when(F.col("_row").isNotNull(), F.col("_row"))
        .when(F.col("_n").isNotNull(), "duplicate_id")
        .when(F.col("_pixels") > MAX_BATCH_PIXELS, "batch_pixels")
        .otherwise("")
    )
    return (
        checked.join(batch, "batch_id").join(repeated, ["batch_id", "id"], "left")
        .withColumn("reason", reason).select(*tasks.columns, "reason")
    )


def check_payloads(binary_files: DataFrame) -> DataFrame:
    """Encoded images must have a sane length and the right first and last bytes; none at all has no length."""
    # right() would count characters: in FFD8FFD9 it takes the second and third byte for one.
    head, tail = F.hex(F.substring("content", 1, 2)), F.hex(F.substring("content", -2, 2))
    reason = (
        F.when(F.col("content").isNull() | ~F.col("length").between(MIN_PAYLOAD, MAX_PAYLOAD), "size")
        .when((head != JPEG_START) | (tail != JPEG_END), "format")
        .otherwise("")
    )
    return binary_files.withColumn("reason", reason).drop("content")
