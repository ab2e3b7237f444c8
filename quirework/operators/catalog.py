"""Images and the asset catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import chunks, intervals, rects, scalars
from quirework.session import stored

KIND_ORDER = ["figure", "image", "vector"]
# Ranks up to this are found by a limit in each task.
SMALL_K = 10_000


def image_catalog(image_placement: DataFrame) -> DataFrame:
    """One row per image object; mask and size come from its first placement.

    Its pages are ``page_runs`` (first, last) in order, and ``pages`` their number.
    """
    first = F.struct("page_no", "placement_no", "smask", "width", "height")
    real = image_placement.where("xref > 0")
    few = intervals.one_chunk(image_placement, "page_no")
    found = intervals.interval_sets(real, ["doc_id", "xref"], "page_no", "page_runs", few, f=first)
    return found.select(
        "doc_id", "xref", F.col("f.page_no").alias("first_page"), F.col("f.smask").alias("smask"),
        F.col("f.width").alias("width"), F.col("f.height").alias("height"), "page_runs",
        intervals.size(F.col("page_runs")).alias("pages"),
    )


def images_within(image_placement: DataFrame, allowed_pages: DataFrame) -> DataFrame:
    """Image objects whose every occurrence lies on an allowed page (relational division)."""
    allowed = allowed_pages.select("doc_id", "page_no").distinct().withColumn("_allowed", F.lit(True))
    return (
        image_placement.where("xref > 0")
        .join(allowed, ["doc_id", "page_no"], "left")
        .groupBy("doc_id", "xref")
        .agg(
            F.bool_and(F.coalesce("_allowed", F.lit(False))).alias("_all"),
            F.min(F.struct("page_no", "placement_no", "smask")).alias("f"),
        )
        .where("_all")
        .select("doc_id", "xref", F.col("f.page_no").alias("first_page"), F.col("f.smask").alias("smask"))
    )


def exclude_figure_images(images: DataFrame, inside: DataFrame) -> DataFrame:
    """Hide images that occur inside any figure of their document."""
    return images.join(inside.select("doc_id", "xref").distinct(), ["doc_id", "xref"], "left_anti")


def union_assets(*parts: DataFrame) -> DataFrame:
    """G1: union by name; columns a part lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def asset_catalog(figures: DataFrame, images: DataFrame) -> DataFrame:
    """Figures and remaining images under one schema, with their keys.

    Both are stored, one after the other, so the result is cheap to read more than once.
    """
    kept = figures.select(
        "doc_id",
        F.concat_ws(":", F.lit("figure"), F.col("page_no").cast("string"), F.col("caption_no").cast("string")).alias("key"),
        F.lit("figure").alias("kind"),
        F.array(F.struct(F.col("page_no").alias("first"), F.col("page_no").alias("last"))).alias("page_runs"),
        rects.rect_of().alias("rect"),
        F.col("label").alias("title"),
        "storage_bytes",
        F.lit(True).alias("storage_is_estimate"),
    )
    rest = images.select(
        "doc_id",
        F.concat_ws(":", F.lit("image"), F.col("xref").cast("string")).alias("key"),
        F.lit("image").alias("kind"),
        "page_runs", "xref", "smask", "width", "height", "storage_bytes",
        F.lit(False).alias("storage_is_estimate"),
    )
    return union_assets(stored(kept, "figures"), stored(rest, "images"))


def kind_rank(kind: Column) -> Column:
    rank = F.lit(len(KIND_ORDER))
    for position, name in reversed(list(enumerate(KIND_ORDER))):
        rank = F.when(kind == name, position).otherwise(rank)
    return rank


def catalog_order(assets: DataFrame) -> DataFrame:
    """``catalog_pos`` per document: first page, kind, then the key as text."""
    first_page = F.get("page_runs", F.lit(0))["first"]
    return chunks.scan(
        assets,
        ["doc_id"],
        [first_page, kind_rank(F.col("kind")), F.col("key")],
        F.struct(first_page.alias("page"), kind_rank(F.col("kind")).alias("kind"), F.substring("key", 1, 12).alias("head")),
        only_above=chunks.CHUNK_WIDTH,
        catalog_pos=chunks.count(),
    )


def selection_summary(assets: DataFrame, selection: DataFrame, key: list[str] = ["doc_id"]) -> DataFrame:
    """Selected and all assets, by kind, with bytes."""
    chosen = selection.select(*key, "key").distinct().withColumn("_chosen", F.lit(True))
    on = F.col("_chosen").isNotNull()
    return (
        assets.join(chosen, [*key, "key"], "left")
        .groupBy(*key)
        .agg(
            F.count_if(on).alias("selected"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(on & (F.col("kind") == "figure")).alias("figures"),
            F.count_if(on & (F.col("kind") == "image")).alias("images"),
            F.coalesce(F.sum(F.when(on, F.col("storage_bytes"))), F.lit(0)).alias("bytes"),
        )
    )


def _first_ranks(df: DataFrame, key: list[str], order: list[Column], leading: Column, k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with their rank.

    A small ``k`` is pushed into a limit per task before the shuffle, so no task reads a whole hot key.
    For a large one that saves nothing; keys with more rows than a chunk are then ranked in chunks of
    ``leading``, the number that the order begins with.
    """
    if k <= SMALL_K:
        ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    else:
        ranked = chunks.scan(df, key, order, chunks.by_magnitude(leading), only_above=chunks.CHUNK_WIDTH, **{name: chunks.count()})
    return ranked.where(F.col(name) <= k)


def largest_assets(assets: DataFrame, k: int, key: list[str] | None = None) -> DataFrame:
    """the k largest assets per key, or of the whole corpus."""
    tie = [F.col(c) for c in ("doc_id", "key") if c in assets.columns]
    if not key:
        return assets.orderBy(F.col("storage_bytes").desc(), *tie).limit(k)
    down = -F.col("storage_bytes").cast("double")
    order = [F.col("storage_bytes").desc(), *tie] if k <= SMALL_K else [-F.col("storage_bytes"), *tie]
    return _first_ranks(assets, key, order, down, k, "size_rank")


def smallest_regions(regions: DataFrame, k: int) -> DataFrame:
    """The k smallest figure regions per document, the ones granted a resolution step."""
    sized = regions.withColumn("area", F.greatest(F.lit(0.0), rects.area(rects.rect_of())))
    order = [F.col("area"), F.col("page_no"), F.col("region_no")]
    return _first_ranks(sized, ["doc_id"], order, F.col("area"), k, "area_rank")


def apply_selection(assets: DataFrame, selection: DataFrame | None, on: list[str] = ["doc_id", "key"]) -> DataFrame:
    """``None`` keeps everything, an empty selection keeps nothing."""
    if selection is None:
        return assets
    return assets.join(selection.select(*on).distinct(), on, "left_semi")


def asset_runs(assets: DataFrame) -> Column:
    """The page runs of assets that have them, or the runs of their ``page_numbers``."""
    if "page_runs" in assets.columns:
        return F.col("page_runs")
    return intervals.runs_of(F.array_sort(F.array_distinct("page_numbers")))


def asset_stem(assets: DataFrame) -> DataFrame:
    """Output file stem from ``index``, pages (``page_runs``, or a list ``page_numbers``), and title or pixel size."""
    runs = asset_runs(assets)
    pages = F.when(F.size(runs) > 0, intervals.text(runs, "_")).otherwise(F.lit("unknown"))
    head = F.format_string("%04d_page_%s", F.col("index").cast("int"), pages)
    sized = (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0)
    dims = F.when(
        sized,
        F.concat(
            F.lit("_"), F.greatest(F.lit(0), F.col("width")).cast("string"),
            F.lit("x"), F.greatest(F.lit(0), F.col("height")).cast("string"),
        ),
    ).otherwise(F.lit(""))
    stem = F.when(
        F.col("kind") == "figure",
        F.concat(head, F.lit("_figure_"), scalars.safe_fragment(F.coalesce("title", F.lit("")), "figure")),
    ).otherwise(F.concat(head, F.lit("_image"), dims))
    return assets.withColumn("stem", stem)


def preservation_mode(assets: DataFrame, overlaps: DataFrame) -> DataFrame:
    """How an exported asset keeps its content; ``overlaps`` holds figures with a raster."""
    raster = overlaps.select("doc_id", "key").distinct().withColumn("_raster", F.lit(True))
    mode = (
        F.when(F.col("kind") == "image", "original-raster-preserved")
        .when(F.col("_raster"), "mixed-vector-raster-preserved")
        .otherwise("native-vector-preserved")
    )
    return assets.join(raster, ["doc_id", "key"], "left").withColumn("preservation_mode", mode).drop("_raster")


def bounding_box(df: DataFrame, key: list[str]) -> DataFrame:
    """Union of all rectangles per key."""
    return df.groupBy(*key).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def format_ranges(df: DataFrame, key: list[str], col: str, sep: str = ", ") -> DataFrame:
    """Page-range text per key, from its runs of pages; a key without pages has an empty text."""
    return intervals.interval_sets(df, key, col).select(*key, intervals.text(F.col("runs"), sep).alias("ranges"))
