"""Page composition and merging: ranges, runs, offsets, links, reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import chunks, rects, scalars

# Fixed values ------------------------------------------------------------------
MAX_SOURCES = 100
MAX_INPUT_BYTES = 4 * scalars.GIB
MAX_TOTAL_BYTES = 16 * scalars.GIB
# -------------------------------------------------------------------------------

TARGET_POINT = ["target_x", "target_y"]


# Page-range text ----------------------------------------------------------------

def _number(c: Column) -> Column:
    """Page number of a digit run; null for anything else or absurdly long."""
    return scalars.plain_digits(c).try_cast("long")


def _spans(parts: Column, pattern: str) -> Column:
    """struct(first, last) per part; both null when the part does not match."""
    def span(p: Column) -> Column:
        second = F.regexp_extract(p, pattern, 2)
        first = F.regexp_extract(p, pattern, 1)
        return F.struct(
            _number(first).alias("first"),
            _number(F.when(second == "", first).otherwise(second)).alias("last"),
        )
    return F.transform(parts, span)


def parse_ranges_set(df: DataFrame, text: str, count: str) -> DataFrame:
    """H1: ascending one-based ranges to distinct zero-based pages.

    One row per page; an empty text gives one row without a page, an invalid text one row
    with a ``reason``.
    """
    pattern = r"(?U)^(\d+)(?:\s*-\s*(\d+))?$"
    cleaned = F.translate(F.col(text), "，—–", ",--")
    parts = F.filter(
        F.transform(F.split(cleaned, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")),
        lambda p: p != "",
    )
    good = F.forall("_spans", lambda s: F.coalesce(
        (s.getField("first") >= 1) & (s.getField("last") >= s.getField("first"))
        & (s.getField("last") <= F.col(count)), F.lit(False),
    ))
    pages = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(
        s.getField("first") - 1, s.getField("last") - 1
    ))))
    return _emit_pages(df, _spans(parts, pattern), good, pages).drop("entry_pos")


def parse_ranges_ordered(df: DataFrame, text: str, count: str) -> DataFrame:
    """H2: one-based ranges in entered order, descending allowed, first occurrence kept.

    Adds ``entry_pos`` (zero-based) and ``page_index``; empty and invalid texts as in H1.
    """
    pattern = r"^([0-9]+)(?:-([0-9]+))?$"
    parts = F.filter(F.split(F.col(text), r"(?U)[,，\s]+"), lambda p: p != "")
    inside = lambda n: (n >= 1) & (n <= F.col(count))
    good = F.forall("_spans", lambda s: F.coalesce(
        inside(s.getField("first")) & inside(s.getField("last")), F.lit(False)
    ))
    pages = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(
        s.getField("first") - 1, s.getField("last") - 1
    ))))
    return _emit_pages(df, _spans(parts, pattern), good, pages)


def _emit_pages(df: DataFrame, spans: Column, good: Column, pages: Column) -> DataFrame:
    checked = df.withColumn("_spans", spans).withColumn("_good", good)
    listed = checked.withColumn("_pages", F.when(F.col("_good"), pages))
    return listed.select(
        *df.columns,
        F.posexplode_outer("_pages").alias("entry_pos", "page_index"),
        F.when(F.col("_good"), "").otherwise("invalid").alias("reason"),
    )


# Merging ------------------------------------------------------------------------

def page_offsets(merge_input: DataFrame) -> DataFrame:
    """Pages that precede each input of a merge."""
    return chunks.scan(
        merge_input, ["merge_id"], [F.col("pos")], chunks.by_width(F.col("pos")),
        page_offset=chunks.sum_before(F.col("pages")),
    )


def offset_navigation(merge_input: DataFrame, toc: DataFrame, link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bookmarks and links of every input, shifted to the merged page numbers.

    Bookmarks without a page stay unshifted; all keep the point that they lead to. Named links and internal links that point
    outside their own document are dropped.
    """
    placed = page_offsets(merge_input).select("merge_id", "pos", "doc_id", "pages", "page_offset")
    marks = placed.join(toc.withColumnRenamed("pos", "toc_pos"), "doc_id").select(
        "merge_id", "pos", "toc_pos", "level", "title",
        F.when(F.col("page_no") > 0, F.col("page_no") + F.col("page_offset")).otherwise(F.col("page_no")).alias("page_no"),
        "dest_x", "dest_y",
    )
    goto = F.col("kind") == "goto"
    inside = (F.col("target_page") >= 0) & (F.col("target_page") < F.col("pages"))
    links = (
        placed.join(link.where("kind <> 'named'"), "doc_id")
        .where(~goto | F.coalesce(inside, F.lit(False)))
        .select(
            "merge_id", "pos", "link_no", "kind",
            (F.col("page_no") + F.col("page_offset")).alias("page_no"),
            *rects.SIDES,
            F.when(goto, F.col("target_page") + F.col("page_offset")).alias("target_page"),
            *(F.when(goto, F.col(c)).alias(c) for c in TARGET_POINT),
            "uri",
        )
    )
    return marks, links


def merge_summary(merge_input: DataFrame, distinct_sources: bool) -> DataFrame:
    """Totals of a merge; a composition counts each source once, a merge every time."""
    rows = merge_input
    if distinct_sources:
        rows = rows.dropDuplicates(["merge_id", "doc_id"])
    return rows.groupBy("merge_id").agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("pages").alias("pages"),
        F.sum("size_bytes").alias("input_bytes"),
    )


# Composition --------------------------------------------------------------------

def invalid_refs(page_ref: DataFrame, preflight: DataFrame) -> DataFrame:
    """C11: references whose source is unknown, has an error, or lacks the page."""
    known = preflight.select(
        F.col("doc_id").alias("source"), F.col("pages").alias("_pages"), F.col("reason").alias("_reason"),
        F.lit(True).alias("_known"),
    )
    why = (
        F.when(F.col("_known").isNull(), "unknown_source")
        .when(F.col("_reason") != "", "source_error")
        .when(F.col("page_index").isNull() | (F.col("page_index") < 0) | (F.col("page_index") >= F.col("_pages")), "no_such_page")
    )
    return page_ref.join(known, "source", "left").withColumn("ref_reason", why).where(
        "ref_reason IS NOT NULL"
    ).drop("_pages", "_reason", "_known")


def composition_summary(page_ref: DataFrame, preflight: DataFrame) -> DataFrame:
    """Pages, distinct sources and their bytes, invalid references, saveable."""
    used = page_ref.select("plan_id", "source").distinct()
    size = preflight.select(F.col("doc_id").alias("source"), "size_bytes")
    sources = (
        used.join(size, "source", "left").groupBy("plan_id")
        .agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("used_bytes"))
    )
    bad = invalid_refs(page_ref, preflight).groupBy("plan_id").agg(F.count(F.lit(1)).alias("invalid"))
    pages = page_ref.groupBy("plan_id").agg(F.count(F.lit(1)).alias("pages"))
    return (
        pages.join(sources, "plan_id").join(bad, "plan_id", "left")
        .withColumn("invalid", F.coalesce("invalid", F.lit(0)))
        .withColumn("saveable", (F.col("invalid") == 0) & (F.col("used_bytes") <= MAX_TOTAL_BYTES))
    )


def page_runs(page_ref: DataFrame) -> DataFrame:
    """Maximal runs of consecutive pages of one source; ``run_no`` counts from 1."""
    here = F.struct("pos", "source", "page_index")
    chunk = chunks.by_width(F.col("pos"))
    lagged = chunks.scan(page_ref, ["plan_id"], [F.col("pos")], chunk, _prev=chunks.last_before(here))
    goes_on = F.coalesce(
        (F.col("_prev.source") == F.col("source")) & (F.col("_prev.page_index") + 1 == F.col("page_index")),
        F.lit(False),
    )
    broken = lagged.withColumn("_break", (~goes_on).cast("long"))
    numbered = chunks.scan(
        broken, ["plan_id"], [F.col("pos")], chunk, run_no=chunks.sum_upto(F.col("_break"))
    )
    return numbered.groupBy("plan_id", "run_no").agg(
        F.min("pos").alias("first_pos"), F.min("source").alias("source"),
        F.min("page_index").alias("first_index"), F.count(F.lit(1)).alias("length"),
    )


def whole_documents(page_ref: DataFrame, preflight: DataFrame) -> DataFrame:
    """Plans that are complete documents one after the other, 2 to 100 of them.

    A page of index 0 always opens a document and a document ends after its last page, so
    the plan qualifies when every other page continues its predecessor and every predecessor
    of an opening page is the last page of its source.
    """
    sizes = preflight.select(F.col("doc_id").alias("source"), F.col("pages").alias("_pages"))
    sized = page_ref.join(sizes, "source", "left")
    here = F.struct("source", "page_index", "_pages")
    seen = chunks.scan(
        sized, ["plan_id"], [F.col("pos")], chunks.by_width(F.col("pos")), _prev=chunks.last_before(here)
    )
    opening = F.col("page_index") == 0
    prev_done = F.col("_prev").isNull() | (F.col("_prev.page_index") + 1 == F.col("_prev._pages"))
    follows = (F.col("_prev.source") == F.col("source")) & (F.col("_prev.page_index") + 1 == F.col("page_index"))
    fits = F.when(opening, prev_done).otherwise(follows & (F.col("page_index") < F.col("_pages")))
    last = F.max_by(F.col("page_index") + 1 == F.col("_pages"), F.col("pos"))
    return (
        seen.groupBy("plan_id")
        .agg(
            F.bool_and(F.coalesce(fits, F.lit(False))).alias("_fits"),
            F.coalesce(last, F.lit(False)).alias("_ends"),
            F.count_if(opening).alias("documents"),
        )
        .select(
            "plan_id", "documents",
            (F.col("_fits") & F.col("_ends")).alias("whole"),
            (F.col("_fits") & F.col("_ends") & F.col("documents").between(2, MAX_SOURCES)).alias("mergeable"),
        )
    )


def remap_links(page_ref: DataFrame, link: DataFrame) -> DataFrame:
    """Links of composed pages; internal targets go to their first output page.

    Links to omitted pages and named links are dropped, external ones kept; a page used
    several times carries its links each time. A link keeps its rectangle, an internal one the
    point that it leads to.
    """
    first = page_ref.groupBy("plan_id", "source", F.col("page_index").alias("target_page")).agg(
        F.min("pos").alias("mapped")
    )
    on_page = [F.col("doc_id").alias("source"), F.col("page_no").alias("page_index")]
    refs = page_ref.select("plan_id", "source", "page_index", "pos")
    # Targets are looked up by page, before any rectangle or address is multiplied by the uses of its page.
    targets = link.where("kind = 'goto'").select(*on_page, "target_page").distinct()
    reached = refs.join(targets, ["source", "page_index"]).join(first, ["plan_id", "source", "target_page"])
    inner = reached.join(
        link.where("kind = 'goto'").select(*on_page, "link_no", "kind", *rects.SIDES, "target_page", *TARGET_POINT, "uri"),
        ["source", "page_index", "target_page"],
    )
    outer = refs.join(
        link.where("kind NOT IN ('goto', 'named')").select(*on_page, "link_no", "kind", *rects.SIDES, "uri"), ["source", "page_index"]
    )
    nothing = {c: F.lit(None).cast(inner.schema[c].dataType) for c in ("mapped", *TARGET_POINT)}
    found = inner.drop("target_page").unionByName(outer.withColumns(nothing))
    return found.select(
        "plan_id", F.col("pos").alias("output_page"), "link_no", "kind", *rects.SIDES, F.col("mapped").alias("target_page"), *TARGET_POINT, "uri",
    )


def ordered_distinct(df: DataFrame, cols: list[str], ord: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(*cols).agg(F.min(ord).alias(ord))


# Reordering ---------------------------------------------------------------------

def reorder_block(df: DataFrame, key: list[str], ord: str, selected: str, direction: int) -> DataFrame:
    """Move the selected rows one place up (-1) or down (1) among their siblings.

    Closed form of repeated neighbour swaps: every selected island that has an unselected
    row in front moves by one, and that row lands just behind the island. Adds ``new_pos``,
    zero-based.
    """
    if direction not in (-1, 1):
        raise ValueError("direction must be -1 or 1")
    toward = F.col(ord) if direction == -1 else -F.col(ord)
    work = df.withColumn("_o", toward.cast("long"))
    placed = chunks.scan(
        work, key, [F.col("_o")], chunks.by_width(F.col("_o")),
        _pos=chunks.count(), _ahead=chunks.last_before(F.when(~F.col(selected), F.col("_o"))),
    )
    behind = (
        placed.where(F.col(selected) & F.col("_ahead").isNotNull())
        .groupBy(*key, F.col("_ahead").alias("_o")).agg(F.count(F.lit(1)).alias("_island"))
    )
    moved = placed.join(behind, [*key, "_o"], "left").withColumn(
        "_new",
        F.when(F.col(selected) & F.col("_ahead").isNotNull(), F.col("_pos") - 1)
        .when(~F.col(selected), F.col("_pos") + F.coalesce("_island", F.lit(0)))
        .otherwise(F.col("_pos")),
    )
    if direction == -1:
        return moved.select(*df.columns, (F.col("_new") - 1).alias("new_pos"))
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    return moved.join(sizes, key).select(*df.columns, (F.col("_size") - F.col("_new")).alias("new_pos"))


def natural_sort(queue: DataFrame, col: str, key: list[str] = ["queue_id"], ord: str = "ord") -> DataFrame:
    """``sorted_pos`` by natural name order; the input ordinal breaks ties."""
    keyed = queue.withColumn("_natural", scalars.natural_key(F.col(col)))
    return chunks.scan(
        keyed, key, [F.col("_natural"), F.col(ord)], scalars.natural_chunk(F.col("_natural")),
        sorted_pos=chunks.count(),
    ).drop("_natural")
