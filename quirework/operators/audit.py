"""Checks before anything is published: snapshots, manifests, fixtures, names, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import chunks, scalars

# Fixed values ------------------------------------------------------------------
MAX_EXPORT_ITEMS = 20_000
MAX_EXPORT_BYTES = 8 * scalars.GIB
FORMATS = ("svg", "png", "pdf")
# -------------------------------------------------------------------------------


def snapshot_diff(expected: DataFrame, actual: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Keys that are missing, extra or changed between two states (null equals null)."""
    left = expected.select(*on, F.struct(*fields).alias("_old"))
    right = actual.select(*on, F.struct(*fields).alias("_new"))
    status = (
        F.when(F.col("_new").isNull(), "missing")
        .when(F.col("_old").isNull(), "extra")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return left.join(right, on, "full").withColumn("status", status).where("status IS NOT NULL").select(*on, "status")


def same_sources(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row, whether both hold the same rows."""
    cols = expected.columns
    counted = lambda d, n: d.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    left, right = counted(expected, "_a").alias("l"), counted(actual.select(*cols), "_b").alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    both = left.join(right, same, "full")
    differs = F.coalesce("_a", F.lit(0)) != F.coalesce("_b", F.lit(0))
    return both.agg(F.count_if(differs).alias("differences")).select(
        (F.col("differences") == 0).alias("same"), "differences"
    )


def rows_minus(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def audit_manifest(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per document whether its manifest is complete and every listed file is sound.

    ``inventory`` has doc_id, name, size_bytes.
    """
    without_files = F.exists("items", lambda i: i.getField("files").isNull())
    head = F.struct(
        (F.col("item_count") != F.coalesce(F.size("items"), F.lit(0))).alias("_count_off"),
        F.coalesce(without_files, F.lit(False)).alias("_no_files"),
    )
    listed = F.flatten(F.transform("items", lambda i: F.coalesce(F.map_values(i.getField("files")), F.array().cast("array<string>"))))
    # One row a file, the first of a manifest with its head; a manifest without files has one row.
    entries = manifest.select("doc_id", head.alias("_head"), F.posexplode_outer(listed).alias("_at", "name")).withColumn(
        "_head", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_head"))
    )
    found = inventory.select("doc_id", "name", F.col("size_bytes").alias("_size"))
    named = F.col("_at").isNotNull()
    checked = entries.join(found, ["doc_id", "name"], "left").groupBy("doc_id").agg(
        F.count_if(named).alias("files"),
        F.count_if(named & (F.col("name").isNull() | F.col("name").rlike(r"[/\\]") | F.col("name").isin("", ".", ".."))).alias("unsafe"),
        F.count_if(named & F.col("_size").isNull()).alias("missing"),
        F.count_if(named & (F.col("_size") <= 0)).alias("empty"),
        F.collect_list("_head").alias("_heads"),
    )
    reason = (
        F.when(F.col("_count_off"), "item_count")
        .when(F.col("_no_files"), "files_missing_in_item")
        .when(F.col("unsafe") > 0, "unsafe_name")
        .when(F.col("missing") > 0, "file_missing")
        .when(F.col("empty") > 0, "file_empty")
        .otherwise("")
    )
    heads = checked.select("doc_id", "files", "unsafe", "missing", "empty", F.inline("_heads"))
    return heads.select("doc_id", "files", reason.alias("reason"))


def fixtures_match(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """C14: one row, whether every present fixture has the digest of its baseline.

    A fixture that is absent now (null digest) is ignored.
    """
    old = baseline.select("fixture", F.col("sha256").alias("_old"))
    equal = F.coalesce(F.upper("sha256") == F.upper("_old"), F.lit(False))
    return (
        current.where("sha256 IS NOT NULL").join(old, "fixture", "left")
        .agg(F.coalesce(F.bool_and(equal), F.lit(True)).alias("match"), F.count(F.lit(1)).alias("compared"))
    )


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Give every wanted name the next free form: ``name``, ``name (2)``, ``name (3)`` …

    ``wanted`` has base and ord, ``existing`` has name. The m-th request for a base gets its
    m-th free number, which is m and as many more as there are taken numbers below it: the i-th taken
    number t leaves t - i free ones before it, so those with t - i < m. No number is ever generated.
    """
    pattern = r"^(.*) \(([1-9][0-9]*)\)$"
    numbered = F.col("name").rlike(pattern) & (F.regexp_extract("name", pattern, 2) != "1")
    taken = existing.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("number")).unionByName(
        existing.where(numbered).select(
            F.regexp_extract("name", pattern, 1).alias("base"),
            F.regexp_extract("name", pattern, 2).try_cast("long").alias("number"),
        )
    ).where("number IS NOT NULL").distinct()
    requests = chunks.scan(
        wanted, ["base"], [F.col("ord")], chunks.by_width(F.col("ord")), _rank=chunks.count()
    )
    held = chunks.scan(
        taken, ["base"], [F.col("number")], chunks.by_width(F.col("number")), _i=chunks.count()
    )
    # At one place a request comes before the taken number, which is not below it.
    both = requests.select("base", "ord", F.col("_rank").alias("_place"), F.lit(0).alias("_taken")).unionByName(
        held.select("base", (F.col("number") - F.col("_i")).alias("_place"), F.lit(1).alias("_taken"), F.col("number").alias("ord")),
    )
    placed = chunks.scan(
        both, ["base"], [F.col("_place"), F.col("_taken"), F.col("ord")], chunks.by_width(F.col("_place")),
        _below=chunks.sum_before(F.col("_taken").cast("long")),
    )
    free = placed.where("_taken = 0").select("base", "ord", (F.col("_place") + F.col("_below")).alias("number"))
    name = F.when(F.col("number") == 1, F.col("base")).otherwise(
        F.concat(F.col("base"), F.lit(" ("), F.col("number").cast("string"), F.lit(")"))
    )
    return free.select("base", F.col("ord").cast(wanted.schema["ord"].dataType).alias("ord"), name.alias("name"))


def export_summary(
    files: DataFrame, max_items: int = MAX_EXPORT_ITEMS, max_bytes: int = MAX_EXPORT_BYTES
) -> DataFrame:
    """Items by kind, files by format, payload bytes and the export limits.

    ``files`` has doc_id, key, kind, format, bytes; one row per written file.
    """
    items = files.select("doc_id", "key", "kind").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("kind") == "figure").alias("figures"),
        F.count_if(F.col("kind") == "image").alias("images"),
    )
    formats = files.groupBy("doc_id").agg(
        *(F.count_if(F.col("format") == f).alias(f"{f}_count") for f in FORMATS),
        F.sum("bytes").alias("payload_bytes"),
    )
    return items.join(formats, "doc_id").withColumn(
        "within_limits", (F.col("items") <= max_items) & (F.col("payload_bytes") <= max_bytes)
    )


def batch_complete(requested: DataFrame, produced: DataFrame) -> DataFrame:
    """Per batch whether every task came back and each group was rendered once.

    ``requested`` has batch_id, id, group_id; ``produced`` batch_id, completed, variants, masters.
    """
    groups = requested.select("batch_id", "group_id").distinct().groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("groups")
    )
    wanted = requested.groupBy("batch_id").agg(F.count(F.lit(1)).alias("tasks")).join(groups, "batch_id")
    ok = (
        (F.col("completed") == F.col("tasks")) & (F.col("variants") == F.col("tasks"))
        & (F.col("masters") == F.col("groups"))
    )
    return wanted.join(produced, "batch_id", "left").select(
        "batch_id", "tasks", "groups", F.coalesce(ok, F.lit(False)).alias("complete")
    )
