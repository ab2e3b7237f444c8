"""Geometry: which boxes belong to which caption, and what a figure weighs.

Joins on a page are interval joins. They always carry the equality on document and
page plus a horizontal band of the page, so a box meets only the regions in its band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import chunks, dominance, rects, scalars
from quirework.session import stored

# Detection tolerances in points ---------------------------------
CELL = 4.0
GROW = 6.0
LIMIT_STEP = 2.0
TOP_SLACK = 2.0
LANE_REACH = 8.0
SIDE_GAP, STACK_GAP = 42.0, 50.0
PANEL_SHARE = 0.45
PADDING = 3.0
MIN_WIDTH, MIN_HEIGHT = 18.0, 10.0
# ------------------------------------------------------------------------------

SIDES = rects.SIDES
PAGE = ["doc_id", "page_no"]
CAPTION_KEY = ["doc_id", "page_no", "caption_no"]
BAND = 72.0
FAR = 14_400.0  # coordinates beyond share the outermost bands
SALTS = 8
STACK_CELLS = 2_000_000  # grid cells labelled at once in a Python worker
FEW_BOXES = 256  # boxes of a caption up to which they are compared in pairs
PAIRS = 1 << 20  # pairs of boxes compared at once in a Python worker
IMAGE_SEQ = 2**62  # images come after drawings in the order boxes are seen


def band(y: Column) -> Column:
    """The band of a coordinate. Both sides of a join use it, so far coordinates still meet."""
    return F.floor(scalars.clamp(y, -FAR, FAR) / F.lit(BAND)).cast("int")


def bands(low: Column, high: Column) -> Column:
    """One row per band touched by the closed range; at most a few hundred whatever the range."""
    return F.explode(F.sequence(band(low), band(high)))


def graphics(drawing: DataFrame, image_placement: DataFrame) -> DataFrame:
    """All graphic boxes of a page; drawings come before images."""
    paths = drawing.select(
        *PAGE, F.lit(0).alias("src"), F.col("draw_no").cast("long").alias("box_no"), *rects.SIDES
    )
    images = image_placement.select(
        *PAGE, F.lit(1).alias("src"), F.col("placement_no").cast("long").alias("box_no"), *rects.SIDES
    )
    return paths.unionByName(images)


def caption_candidates(captions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes above a caption, below the lane limit and inside the lane.

    ``captions`` carries lane, lower_limit, caption_no and the page bounds px0..py1.
    """
    limit = F.col("lower_limit") + LIMIT_STEP
    middle = (F.col("px0") + F.col("px1")) / 2
    # A box hanging over the page bottom is clipped there, so only a caption at the very
    # bottom can take it; such a caption looks into all bands below.
    reach_down = F.col("caption_top") + TOP_SLACK
    deepest = F.when(reach_down >= F.col("py1"), F.greatest(reach_down, F.lit(FAR))).otherwise(reach_down)
    wanted = (
        captions.select(
            *CAPTION_KEY,
            F.col("y0").alias("caption_top"),
            limit.alias("limit"),
            *(F.col("p" + s) for s in rects.SIDES),
            F.when(F.col("lane") == "right", middle - LANE_REACH).otherwise(F.col("px0")).alias("lane_x0"),
            F.when(F.col("lane") == "left", middle + LANE_REACH).otherwise(F.col("px1")).alias("lane_x1"),
        )
        .where("limit <= caption_top + 2")
        .withColumn("band", bands(F.col("limit"), deepest))
    )
    offered = boxes.withColumn("band", band(F.col("y1")))
    clipped = rects.rect_intersection(rects.rect_of(), rects.rect_of("p"))
    reach = F.greatest(
        F.lit(0.0),
        F.least(F.col("c.x1"), F.col("lane_x1")) - F.greatest(F.col("c.x0"), F.col("lane_x0")),
    )
    return (
        offered.join(wanted, [*PAGE, "band"])
        .withColumn("c", clipped)
        .where(
            (F.col("c.y0") >= F.col("limit") - TOP_SLACK)
            & (F.col("c.y1") <= F.col("caption_top") + TOP_SLACK)
            & (F.col("c.y1") > F.col("limit"))
            & (F.col("c.x1") > F.col("c.x0"))
            & (F.col("c.y1") >= F.col("c.y0"))
            & (reach >= F.least(F.lit(4.0), F.greatest(F.lit(0.1), rects.width(F.col("c")) * 0.2)))
        )
        .select(*CAPTION_KEY, "src", "box_no", *rects.spread(F.col("c")))
    )


def _connected(mask: np.ndarray) -> np.ndarray:
    """Label the 4-connected regions of a stack of boolean grids; 0 is background."""
    begins = mask.copy()
    begins[:, :, 1:] &= ~mask[:, :, :-1]
    runs = np.where(mask, np.cumsum(begins.ravel(), dtype=np.int32).reshape(mask.shape), 0)
    touching = mask[:, :-1] & mask[:, 1:]
    root = np.arange(int(runs.max(initial=0)) + 1)
    codes = runs[:, :-1][touching].astype(np.int64) * len(root) + runs[:, 1:][touching]
    pairs = np.stack(np.divmod(np.unique(codes), len(root)))
    while pairs.size:
        ends = root[pairs]
        low, high = ends.min(axis=0), ends.max(axis=0)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root[runs]


def _whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup sorted Arrow batches so that no group is cut; yields rows and group numbers.

    Only the last group of a batch is held back, so memory stays at a batch plus a group.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if rows.num_rows == 0:
            continue
        number = _group_numbers(rows, key)
        cut = int(np.searchsorted(number, number[-1]))
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut), number[:cut]
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, dtype=np.int64)


def _group_numbers(rows: pa.Table, key: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    for name in key:
        values = rows[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _by_group(df: DataFrame, key: list[str]) -> DataFrame:
    """Whole groups per partition, in key order."""
    return chunks.spread(df, key).sortWithinPartitions(*key)


def graphic_components(candidates: DataFrame, key: list[str] = CAPTION_KEY, boxes: DataFrame | None = None) -> DataFrame:
    """Union boxes of graphics that touch on a coarse grid.

    Up to ``FEW_BOXES`` boxes of a caption meet in a group and are compared in pairs; boxes of a
    caption with more are summed per cell of the grid before any group is formed. With the ``boxes``
    that the candidates were found among, only those of pages that hold more are counted by caption.
    """
    counted = candidates
    if boxes is not None:
        pages = stored(boxes.groupBy(*PAGE).count().where(F.col("count") > FEW_BOXES).select(*PAGE), "crowded-pages")
        if pages.isEmpty():
            return _few_components(candidates, key)
        counted = candidates.join(pages, PAGE, "left_semi")
    crowded = stored(counted.groupBy(*key).count().where(F.col("count") > FEW_BOXES).select(*key), "crowded-captions")
    if crowded.isEmpty():
        return _few_components(candidates, key)
    same = _components_by_cell(candidates.join(crowded, key, "left_semi"), key)
    return _few_components(candidates.join(crowded, key, "left_anti"), key).unionByName(same)


def _components_schema(candidates: DataFrame, key: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema if f.name in key}
    return ", ".join([f"{k} {kinds[k]}" for k in key] + ["component_no int"] + [f"{s} double" for s in rects.SIDES])


def _few_components(candidates: DataFrame, key: list[str]) -> DataFrame:
    """``graphic_components`` of captions with few boxes."""
    boxes = candidates.select(*key, *rects.SIDES, (F.col("src") * F.lit(IMAGE_SEQ) + F.col("box_no")).alias("seen"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in _whole_groups(batches, key):
            size = np.bincount(number)
            part = (np.cumsum(size * size) // PAIRS)[number]
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows.num_rows]
            for low, high in zip(bounds, bounds[1:]):
                yield from _label_boxes(rows.slice(low, high - low), number[low:high] - number[low], key).to_batches()

    return _by_group(boxes, key).mapInArrow(label, _components_schema(candidates, key))


def _label_boxes(rows: pa.Table, number: np.ndarray, key: list[str]) -> pa.Table:
    """Components of several groups from the pairs of boxes of each; two touch if cells of theirs share a side."""
    col = {name: rows[name].to_numpy() for name in rows.column_names if name not in key}
    size = np.bincount(number)
    first = np.cumsum(size) - size
    left, top = (np.minimum.reduceat(col[side], first)[number] - GROW for side in ("x0", "y0"))

    def cell(value: np.ndarray, origin: np.ndarray) -> np.ndarray:
        return np.floor((value - origin) / CELL).astype(np.int64)

    a, b = cell(col["x0"] - GROW, left), cell(col["y0"] - GROW, top)
    c, d = cell(col["x1"] + GROW, left) + 1, cell(col["y1"] + GROW, top) + 1
    many = size[number]
    p = np.repeat(np.arange(len(number)), many)
    q = first[number[p]] + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
    once = p < q
    p, q = p[once], q[once]
    wide, tall = np.minimum(c[p], c[q]) - np.maximum(a[p], a[q]), np.minimum(d[p], d[q]) - np.maximum(b[p], b[q])
    touch = (wide >= 0) & (tall >= 0) & (wide + tall > 0)
    p, q = p[touch], q[touch]
    region = np.arange(len(number))
    while True:
        low, high = np.minimum(region[p], region[q]), np.maximum(region[p], region[q])
        if (low == high).all():
            break
        np.minimum.at(region, high, low)
        while (region[region] != region).any():
            region = region[region]
    # Boxes in the order they were first seen, equal numbers by the place of their centre.
    mx, my = (np.floor(np.floor((col[u] + col[v]) / 2 - origin) / CELL) for u, v, origin in (("x0", "x1", left), ("y0", "y1", top)))
    order = np.lexsort((mx, my, col["seen"], number))
    return _numbered(rows, key, col, order, region[order], number)


def _components_by_cell(candidates: DataFrame, key: list[str]) -> DataFrame:
    """``graphic_components`` of captions with any number of boxes.

    Boxes are reduced in Spark before any group is formed: each becomes four corner
    marks (whose running sums over both axes say how often a cell is covered) and one
    entry in the cell of its centre. Both are summed per cell with partial aggregation,
    so the group handed to Python holds at most a few rows per grid cell of the page,
    however many boxes the page has.
    """
    extent = candidates.groupBy(*key).agg(
        (F.min("x0") - GROW).alias("left"), (F.min("y0") - GROW).alias("top"),
        (F.max("x1") + GROW).alias("right"), (F.max("y1") + GROW).alias("bottom"),
    ).select(
        *key, "left", "top",
        F.greatest(F.lit(1), F.floor((F.col("right") - F.col("left")) / CELL).cast("int") + 2).alias("w"),
        F.greatest(F.lit(1), F.floor((F.col("bottom") - F.col("top")) / CELL).cast("int") + 2).alias("h"),
    )

    def cell(value: Column, origin: str) -> Column:
        return F.floor((value - F.col(origin)) / CELL).cast("int")

    def centre(low: str, high: str, origin: str, size: str) -> Column:
        at = F.floor(F.floor((F.col(low) + F.col(high)) / 2 - F.col(origin)) / 4).cast("int")
        return F.least(F.col(size) - 1, F.greatest(F.lit(0), at))

    # The extent is needed by every box: salting spreads the boxes of a crowded page, and as
    # the join key is not the grouping key, cells are summed before they are shuffled.
    salted = chunks.spread(extent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "salt"])
    placed = candidates.withColumn("salt", F.pmod(F.hash("box_no"), F.lit(SALTS))).join(salted, [*key, "salt"]).select(
        *key, "w", "h", *rects.SIDES, (F.col("src") * F.lit(IMAGE_SEQ) + F.col("box_no")).alias("seen"),
        cell(F.col("x0") - GROW, "left").alias("a"), cell(F.col("y0") - GROW, "top").alias("b"),
        (cell(F.col("x1") + GROW, "left") + 1).alias("c"), (cell(F.col("y1") + GROW, "top") + 1).alias("d"),
        centre("x0", "x1", "left", "w").alias("mx"), centre("y0", "y1", "top", "h").alias("my"),
    )

    def mark(x: str, y: str, step: int, is_box: bool) -> Column:
        return F.struct(
            F.lit(is_box).alias("is_box"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(step).alias("step")
        )

    marks = placed.withColumn(
        "m",
        F.explode(F.array(
            mark("a", "b", 1, False), mark("c", "b", -1, False), mark("a", "d", -1, False),
            mark("c", "d", 1, False), mark("mx", "my", 0, True),
        )),
    )
    cells = (
        marks.groupBy(*key, "w", "h", "m.is_box", "m.x", "m.y")
        .agg(
            F.sum("m.step").alias("step"), F.min("seen").alias("seen"),
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        )
        .where("is_box OR step <> 0")
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in _whole_groups(batches, key):
            bounds = _stacks(np.flatnonzero(np.diff(number, prepend=-1)), rows)
            for low, high in zip(bounds, bounds[1:]):
                yield from _label_stack(rows.slice(low, high - low), number[low:high] - number[low], key).to_batches()

    return _by_group(cells, key).mapInArrow(label, _components_schema(candidates, key))


def _stacks(heads: np.ndarray, rows: pa.Table) -> list[int]:
    """Row bounds of runs of groups whose grids, padded to the largest of them, stay small."""
    bounds, n, tall, wide = [0], 0, 0, 0
    sizes = zip(heads.tolist(), rows["h"].to_numpy()[heads].tolist(), rows["w"].to_numpy()[heads].tolist())
    for head, h, w in sizes:
        taller, wider = max(tall, h + 1), max(wide, w + 1)
        if n and (n + 1) * taller * wider > STACK_CELLS:
            bounds.append(head)
            n, taller, wider = 0, h + 1, w + 1
        n, tall, wide = n + 1, taller, wider
    return [*bounds, rows.num_rows]


def _label_stack(rows: pa.Table, number: np.ndarray, key: list[str]) -> pa.Table:
    """Components of several groups, one grid per group."""
    col = {name: rows[name].to_numpy() for name in rows.column_names if name not in key}
    is_box = col["is_box"].astype(bool)
    shape = (int(number[-1]) + 1, int(col["h"].max()) + 1, int(col["w"].max()) + 1)
    grid = np.zeros(shape, dtype=np.int32)
    np.add.at(grid, (number[~is_box], col["y"][~is_box], col["x"][~is_box]), col["step"][~is_box].astype(np.int32))
    regions = _connected(grid.cumsum(axis=1, dtype=np.int32).cumsum(axis=2, dtype=np.int32) > 0)
    region = regions[number[is_box], col["y"][is_box], col["x"][is_box]]
    # Boxes in the order they were first seen, equal numbers by the place of their centre.
    at = np.flatnonzero(is_box)[region > 0]
    order = np.lexsort((col["x"][at], col["y"][at], col["seen"][at], number[at]))
    return _numbered(rows, key, col, at[order], region[region > 0][order], number)


def _numbered(rows: pa.Table, key: list[str], col: dict, at: np.ndarray, region: np.ndarray, number: np.ndarray) -> pa.Table:
    """One row a component: the union of its boxes, which ``at`` lists in order; the first one gives the component its number."""
    _, first, member = np.unique(region, return_index=True, return_inverse=True)
    sorting = np.argsort(first)
    rank = np.empty(len(first), dtype=np.int64)
    rank[sorting] = np.arange(len(first))
    origin = at[first[sorting]]
    sides = {}
    for name in SIDES:
        lowest = name in ("x0", "y0")
        sides[name] = np.full(len(first), np.inf if lowest else -np.inf)
        (np.minimum if lowest else np.maximum).at(sides[name], rank[member], col[name][at])
    group = number[origin]
    within = np.arange(len(group)) - np.searchsorted(group, group) + 1
    return pa.table({
        **{k: rows[k].take(pa.array(origin)) for k in key},
        "component_no": pa.array(within.astype(np.int32)), **{n: pa.array(v) for n, v in sides.items()},
    })


def meaningful(components: DataFrame) -> DataFrame:
    """Components large enough to be a figure part."""
    return components.where(rects.big_enough(rects.rect_of(), MIN_WIDTH, MIN_HEIGHT))


def nearest_component(components: DataFrame, key: list[str] = CAPTION_KEY) -> DataFrame:
    """The component ending lowest; larger area, then earlier number wins a tie."""
    box = rects.rect_of()
    rank = F.struct(F.col("y1"), rects.area(box), -F.col("component_no"))
    best = meaningful(components).groupBy(*key).agg(
        F.max_by(F.struct("component_no", *rects.SIDES), rank).alias("best")
    )
    return best.select(*key, "best.*")


def _grow(parts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The lowest part of each caption (then its largest), grown over parts beside it or stacked on it.

    ``parts`` (x0, y0, x1, y1) are sorted by caption ``number`` and come in their own order. All
    captions of the batch take one step together: their first parts are tried, then their second
    ones, and so on, over and over until a whole turn joins nothing anywhere.
    """
    size = np.bincount(number)
    first = np.cumsum(size) - size
    area = (parts[:, 2] - parts[:, 0]) * (parts[:, 3] - parts[:, 1])
    order = np.lexsort((np.arange(len(parts)), -area, -parts[:, 3], number))
    box = parts[order[first]].copy()
    joined = (parts == box[number]).all(axis=1)
    active = np.arange(len(size))
    while len(active):
        grew = np.zeros(len(size), dtype=bool)
        for step in range(int(size[active].max())):
            who = active[step < size[active]]
            who = who[~joined[first[who] + step]]
            part, own = parts[first[who] + step], box[who]
            low, high = np.maximum(part[:, :2], own[:, :2]), np.minimum(part[:, 2:], own[:, 2:])
            shared = high - low
            short = np.maximum(1.0, np.minimum(part[:, 2:] - part[:, :2], own[:, 2:] - own[:, :2]))
            level = shared / short >= PANEL_SHARE
            fits = (level[:, 1] & (-shared[:, 0] <= SIDE_GAP)) | (level[:, 0] & (-shared[:, 1] <= STACK_GAP))
            took = who[fits]
            joined[first[took] + step] = True
            grew[took] = True
            box[took] = np.concatenate([np.minimum(own[fits, :2], part[fits, :2]), np.maximum(own[fits, 2:], part[fits, 2:])], axis=1)
        active = np.flatnonzero(grew)
    return box


def merge_panels(components: DataFrame, captions: DataFrame) -> DataFrame:
    """Grow the nearest component over its neighbouring panels, then pad and clamp.

    Parts of at least 18 x 10 points that do not touch fit only so often on a page, so the
    group per caption is bounded by the page size.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in _whole_groups(batches, CAPTION_KEY):
            order = np.lexsort((rows["component_no"].to_numpy(), number))
            parts = np.stack([rows[side].to_numpy()[order] for side in SIDES], axis=1)
            heads = np.flatnonzero(np.diff(number, prepend=-1))
            grown = _grow(parts, np.searchsorted(heads, np.arange(len(parts)), "right") - 1)
            yield from pa.table({
                **{k: rows[k].take(pa.array(heads)) for k in CAPTION_KEY},
                **{side: pa.array(grown[:, i], pa.float64()) for i, side in enumerate(SIDES)},
            }).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in components.schema if f.name in CAPTION_KEY}
    schema = ", ".join([f"{k} {kinds[k]}" for k in CAPTION_KEY] + [f"{s} double" for s in rects.SIDES])
    grown = _by_group(meaningful(components), CAPTION_KEY).mapInArrow(grow, schema)
    about = captions.select(
        *CAPTION_KEY, "label", F.col("y0").alias("caption_top"), *(F.col("p" + s) for s in rects.SIDES)
    )
    clamped = rects.pad_and_clamp(rects.rect_of(), rects.rect_of("p"), PADDING, F.col("caption_top") - 1)
    return (
        grown.join(about, CAPTION_KEY)
        .withColumn("r", clamped)
        .where(rects.big_enough(F.col("r"), MIN_WIDTH, MIN_HEIGHT))
        .select(*CAPTION_KEY, "label", *rects.spread(F.col("r")))
    )


# Figures of a page up to which each box meets all that hold it.
FEW_FIGURES = 128


def boxes_inside(boxes: DataFrame, regions: DataFrame, on: list[str] = PAGE) -> DataFrame:
    """Pairs of a box and a region of its page that holds the centre of the box.

    Where a page has at most ``FEW_FIGURES`` regions, a box meets all of them. On a more crowded
    page a region is offered in every tile it touches, a box in the tile of its centre, so a box
    meets only regions near it. Region columns keep their names; the sides of the region come out
    as rx0..ry1.
    """
    sound = regions.where("x1 > x0 AND y1 > y0")
    crowded = stored(sound.groupBy(*on).count().where(F.col("count") > FEW_FIGURES).select(*on), "crowded-pages")
    if crowded.isEmpty():
        return _inside_few(boxes, sound, on)
    wanted = (
        _offered(sound.join(crowded, on, "left_semi"), on)
        .withColumn("band", bands(F.col("ry0"), F.col("ry1")))
        .withColumn("strip", bands(F.col("rx0"), F.col("rx1")))
    )
    offered = boxes.join(crowded, on, "left_semi").withColumn("band", band(rects.center_y(rects.rect_of()))).withColumn(
        "strip", band(rects.center_x(rects.rect_of()))
    )
    near = offered.join(wanted, [*on, "band", "strip"]).where(rects.center_inside(rects.rect_of(), rects.rect_of("r")))
    return _inside_few(boxes, sound.join(crowded, on, "left_anti"), on).unionByName(near.drop("band", "strip"))


def _offered(regions: DataFrame, on: list[str]) -> DataFrame:
    own = [c for c in regions.columns if c not in on and c not in rects.SIDES]
    return regions.select(*on, *own, *(F.col(s).alias("r" + s) for s in rects.SIDES))


def _inside_few(boxes: DataFrame, regions: DataFrame, on: list[str] = PAGE) -> DataFrame:
    """``boxes_inside`` where a page has few regions."""
    inside = rects.center_inside(rects.rect_of(), rects.rect_of("r"))
    return boxes.join(_offered(regions.where("x1 > x0 AND y1 > y0"), on), on).where(inside)


def regions_with_raster(regions: DataFrame, image_placement: DataFrame) -> DataFrame:
    """C4: regions that share some area with an image of the same page."""
    images = (
        image_placement.select(*PAGE, *(F.col(s).alias("i" + s) for s in rects.SIDES))
        .where("ix1 > ix0 AND iy1 > iy0")
        .withColumn("band", bands(F.col("iy0"), F.col("iy1")))
    )
    banded = regions.where("x1 > x0 AND y1 > y0").withColumn("band", bands(F.col("y0"), F.col("y1")))
    same = [F.col(f"g.{c}") == F.col(f"i.{c}") for c in [*PAGE, "band"]]
    meets = (
        (F.least(F.col("g.x1"), F.col("i.ix1")) > F.greatest(F.col("g.x0"), F.col("i.ix0")))
        & (F.least(F.col("g.y1"), F.col("i.iy1")) > F.greatest(F.col("g.y0"), F.col("i.iy0")))
    )
    return (
        banded.alias("g").join(images.alias("i"), [*same, meets], "left_semi").drop("band").distinct()
    )


def with_stream_bytes(df: DataFrame, stream_size: DataFrame, cols: dict[str, str]) -> DataFrame:
    """For each ``{xref column: new column}`` look up the encoded size, 0 when missing."""
    for xref, name in cols.items():
        sizes = stream_size.select(
            F.col("doc_id"), F.col("xref").alias(xref), F.col("bytes").alias(name)
        )
        df = df.join(sizes, ["doc_id", xref], "left").withColumn(
            name, F.when(F.col(xref) > 0, F.coalesce(F.col(name), F.lit(0))).otherwise(F.lit(0)).cast("long")
        )
    return df


def image_storage(images: DataFrame, stream_size: DataFrame) -> DataFrame:
    """Exact bytes of an image and its soft mask, counted once when both are one object."""
    sized = with_stream_bytes(images, stream_size, {"xref": "_own", "smask": "_mask"})
    return sized.withColumn(
        "storage_bytes",
        F.col("_own") + F.when(F.col("smask") == F.col("xref"), F.lit(0)).otherwise(F.col("_mask")),
    ).drop("_own", "_mask")


def page_content_bytes(page_stream: DataFrame, stream_size: DataFrame) -> DataFrame:
    """Encoded bytes of the page content: every content stream, each form object once."""
    contents = page_stream.where("role = 'contents'")
    forms = page_stream.where("role = 'form' AND xref > 0").distinct()
    sized = with_stream_bytes(contents.unionByName(forms), stream_size, {"xref": "bytes"})
    return sized.groupBy(*PAGE).agg(F.sum("bytes").alias("content_bytes"))


def images_in_figures(figures: DataFrame, image_placement: DataFrame) -> DataFrame:
    """Distinct image objects per figure (by the centre of a placement)."""
    real = image_placement.where("xref > 0").select(*PAGE, "xref", *rects.SIDES)
    return boxes_inside(real, figures.select(*CAPTION_KEY, *rects.SIDES)).select(*CAPTION_KEY, "xref").distinct()


def inside_weights(weighted: DataFrame, figures: DataFrame) -> DataFrame:
    """D3: ``inside_weight`` per figure: the weight of the boxes whose centre it holds.

    Where a page has few figures a box meets each that holds it. On a page with more than
    ``FEW_FIGURES`` no pair is formed: the weights are dominance sums over its corners.
    """
    region = figures.select(*CAPTION_KEY, *rects.SIDES)
    crowded = stored(region.groupBy(*PAGE).count().where(F.col("count") > FEW_FIGURES).select(*PAGE), "crowded-pages")
    few = region.join(crowded, PAGE, "left_anti")
    sums = _inside_few(weighted, few).groupBy(*CAPTION_KEY).agg(F.sum("weight").alias("inside_weight"))
    if crowded.isEmpty():
        return sums
    points = weighted.join(crowded, PAGE, "left_semi").select(
        *PAGE, rects.center_x(rects.rect_of()).alias("x"), rects.center_y(rects.rect_of()).alias("y"), "weight"
    )
    many = dominance.region_sums(points, region.join(crowded, PAGE, "left_semi"), PAGE, CAPTION_KEY, F.col("weight"))
    return sums.unionByName(many.withColumnRenamed("total", "inside_weight"))


def figure_storage(
    figures: DataFrame,
    drawing: DataFrame,
    page_stream: DataFrame,
    stream_size: DataFrame,
    doc_page: DataFrame,
    image_placement: DataFrame,
) -> DataFrame:
    """D3: share of the page content by instruction weight, plus the images inside.

    Totals per page, weights and images inside are found one after the other and stored.
    """
    pages = figures.select(*PAGE).distinct()
    weighted = drawing.join(pages, PAGE, "left_semi").select(
        *PAGE, *rects.SIDES, scalars.path_weight(F.col("item_arity")).alias("weight")
    )
    totals = stored(
        pages.join(doc_page.select(*PAGE, "text_chars"), PAGE, "left")
        .join(weighted.groupBy(*PAGE).agg(F.sum("weight").alias("path_weight")), PAGE, "left")
        .join(page_content_bytes(page_stream.join(pages, PAGE, "left_semi"), stream_size), PAGE, "left")
        .select(
            *PAGE,
            F.coalesce("content_bytes", F.lit(0)).alias("content_bytes"),
            (F.coalesce("path_weight", F.lit(0)) + F.coalesce("text_chars", F.lit(0))).alias("total_weight"),
        ),
        "page-totals",
    )
    inside = stored(inside_weights(weighted, figures), "inside-weights")
    masks = image_placement.where("xref > 0").groupBy(*PAGE, "xref").agg(
        F.max_by("smask", F.struct("placement_no", "smask")).alias("smask")
    )
    held = stored(images_in_figures(figures, image_placement).join(masks, [*PAGE, "xref"]), "images-inside")
    images = stored(image_storage(held, stream_size).groupBy(*CAPTION_KEY).agg(F.sum("storage_bytes").alias("image_bytes")), "image-bytes")
    share = F.bround(
        F.col("content_bytes").cast("double") * F.coalesce("inside_weight", F.lit(0))
        / F.greatest(F.lit(1), F.col("total_weight"))
    ).cast("long")
    return (
        figures.join(totals, PAGE)
        .join(inside, CAPTION_KEY, "left")
        .join(images, CAPTION_KEY, "left")
        .withColumn("storage_bytes", share + F.coalesce("image_bytes", F.lit(0)))
        .withColumn("storage_is_estimate", F.lit(True))
        .drop("content_bytes", "total_weight", "inside_weight", "image_bytes")
    )
