"""Sinks (A4 - A6)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import chunks, intervals
from quirework.operators.audit import FORMATS, MAX_EXPORT_ITEMS


class PublishRefused(RuntimeError):
    """A check failed; the previous result is still the visible one."""


class PublishConflict(PublishRefused):
    """Another publisher was faster; its result is the visible one."""


def refused_manifests(assets: DataFrame, max_items: int = MAX_EXPORT_ITEMS) -> DataFrame:
    """A4: documents whose export is too large for a manifest, with their item count and the reason."""
    counts = assets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("item_count"))
    return counts.where(F.col("item_count") > max_items).withColumn("reason", F.lit("too_many_items"))


def build_manifests(assets: DataFrame, files: DataFrame, max_items: int = MAX_EXPORT_ITEMS) -> DataFrame:
    """A4: one nested row per document: counts, formats and items in index order.

    ``assets`` has doc_id, index, key, kind, page_runs or page_numbers, title; ``files`` has doc_id, key,
    format, name, bytes. A manifest is one document by nature, so an export above ``max_items``
    gets none; ``refused_manifests`` lists those.
    """
    refused = refused_manifests(assets, max_items).select("doc_id").checkpoint()
    # A null belongs to no file of an asset.
    written = files.where(F.col("format").isin(*FORMATS) & F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    if not refused.isEmpty():
        assets, written = (side.join(refused, "doc_id", "left_anti") for side in (assets, written))
    pages = intervals.numbers(F.col("page_runs")) if "page_runs" in assets.columns else F.col("page_numbers")
    # Assets and files of a document, few by now, meet in one shuffle that serves both groupings.
    listed = assets.select("doc_id", "key", F.struct("index", "kind", pages.alias("pages"), "title").alias("_asset"))
    named = written.select("doc_id", "key", F.struct("format", "name").alias("_file"), "bytes")
    together = chunks.spread(listed.unionByName(named, allowMissingColumns=True), ["doc_id"])
    matched = together.groupBy("doc_id", "key").agg(
        F.collect_list("_asset").alias("_assets"),
        F.map_from_entries(F.array_sort(F.collect_set("_file"))).alias("files"),
        F.sum("bytes").alias("_bytes"),
    ).select("doc_id", "key", "files", "_bytes", F.inline("_assets"))
    entry = F.struct(
        F.col("index").cast("int").alias("index"),
        F.col("key").alias("source_asset_key"),
        F.col("kind").alias("type"),
        F.transform("pages", lambda p: (p + 1).cast("int")).alias("source_pages"),
        F.nullif("title", F.lit("")).alias("title"),
        F.col("files"),
    )
    has = lambda f: F.count_if(F.map_contains_key("files", f)).cast("int")
    whole = matched.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("item_count"),
        F.count_if(F.col("kind") == "figure").cast("int").alias("figure_count"),
        F.count_if(F.col("kind") == "image").cast("int").alias("standalone_image_count"),
        *(has(f).alias(f"{f}_count") for f in FORMATS),
        F.coalesce(F.sum("_bytes"), F.lit(0)).alias("payload_bytes"),
        F.collect_list(F.struct(F.col("index"), entry.alias("e"))).alias("_items"),
    )
    formats = F.array_sort(F.array_compact(F.array(
        *(F.when(F.col(f"{f}_count") > 0, F.lit(f)) for f in FORMATS)
    )))
    by_index = lambda a, b: (a["index"] > b["index"]).cast("int") - (a["index"] < b["index"]).cast("int")
    ordered = F.transform(F.array_sort("_items", by_index), lambda i: i["e"])
    return whole.withColumn("requested_formats", formats).withColumn("items", ordered).drop("_items")


def write_manifest(assets: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """A4: manifests as JSON lines, one document per line; refuses an existing path.

    A document whose export is too large gets no manifest and keeps no other from having one; the
    result lists those documents with the reason.
    """
    write_manifests(build_manifests(assets, files), path)
    return refused_manifests(assets)


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """A5: write to a new destination, never over an existing one."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Manifests as compressed JSON lines: names and keys repeat, so a few parts in a hundred remain."""
    write_once(manifests, path, "json", compression="gzip")


LOG = "_log"
KEPT = 2  # versions that stay: the visible one and the one before, for readers that are still at it


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _commits(spark: SparkSession, dest: str) -> list[int]:
    """The numbers of the log, in order."""
    fs, folder = _hadoop(spark, f"{dest}/{LOG}")
    if not fs.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def _version(spark: SparkSession, dest: str, number: int) -> str | None:
    """The version that a commit names; none while it is not wholly written, or once it is deleted."""
    fs, entry = _hadoop(spark, f"{dest}/{LOG}/{number:020d}")
    if not fs.exists(entry):
        return None
    stream = fs.open(entry)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text.strip() if text.endswith("\n") else None


def _commit(spark: SparkSession, dest: str, number: int, version: str) -> bool:
    """Create the commit ``number``, unless there is one: the file system decides between publishers."""
    fs, entry = _hadoop(spark, f"{dest}/{LOG}/{number:020d}")
    try:
        out = fs.create(entry, False)
    except Py4JJavaError as error:
        if fs.exists(entry):
            return False
        raise error
    try:
        out.write(bytearray(f"{version}\n".encode()))
    finally:
        out.close()
    return True


def published_path(spark: SparkSession, dest: str) -> str:
    """The folder of the version that ``dest`` shows: that of the last whole commit."""
    for number in reversed(_commits(spark, dest)):
        version = _version(spark, dest, number)
        if version is not None:
            return f"{dest}/{version}"
    raise FileNotFoundError(f"nothing is published at {dest}")


def _delete_superseded(spark: SparkSession, dest: str) -> None:
    """Delete versions that the log names and that later commits have replaced, then their commits.

    A folder that no commit names may belong to a publisher that is still writing it; it stays.
    """
    whole = [(n, v) for n in _commits(spark, dest) if (v := _version(spark, dest, n)) is not None]
    for number, version in whole[:-KEPT]:
        for path in (f"{dest}/{version}", f"{dest}/{LOG}/{number:020d}"):
            fs, target = _hadoop(spark, path)
            fs.delete(target, True)


def publish(
    df: DataFrame,
    dest: str,
    checks: list[Callable[[DataFrame], DataFrame]],
    fmt: str = "parquet",
    max_bytes: int | None = None,
    unchanged: Callable[[], DataFrame] | None = None,
) -> str:
    """Write a new version below ``dest``, audit what was written, then make it the visible one.

    Versions never change. A log of numbered commits says which one is visible: the last. A publisher
    notes the last number when it begins and at the end creates the next one, if nobody has: of two
    that began at the same state one succeeds, the other raises ``PublishConflict`` and may begin
    again. That needs no rename and no lock. Whatever fails before leaves the old result visible, and
    there is no moment without one. Every check maps the written data to its violations and must come
    back empty. ``unchanged`` gives the sources that are no longer those that were inspected; it is
    asked right before the commit. The version before stays for readers that are still at it; older
    ones are deleted, if the log lists them.
    """
    spark = df.sparkSession
    seen = max(_commits(spark, dest), default=0)
    version = f"v-{uuid.uuid4().hex}"
    write_once(df, f"{dest}/{version}", fmt)
    fs, written_path = _hadoop(spark, f"{dest}/{version}")
    try:
        written = spark.read.schema(df.schema).format(fmt).load(f"{dest}/{version}")
        for check in checks:
            problem = check(written).head()
            if problem is not None:
                raise PublishRefused(f"check failed: {problem.asDict()}")
        if max_bytes is not None and fs.getContentSummary(written_path).getLength() > max_bytes:
            raise PublishRefused(f"result exceeds {max_bytes} bytes")
        changed = unchanged().head() if unchanged is not None else None
        if changed is not None:
            raise PublishRefused(f"source changed: {changed.asDict()}")
        if max(_commits(spark, dest), default=0) != seen or not _commit(spark, dest, seen + 1, version):
            raise PublishConflict(f"{dest} was published by another one meanwhile")
    except Exception:
        fs.delete(written_path, True)
        raise
    _delete_superseded(spark, dest)
    return version
