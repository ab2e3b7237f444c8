import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.functions import chunks, scalars
from quirework.operators import catalog, figures, quality
from quirework.plans import flows
from quirework.schemas import TABLES

BOX = "doc_id long, page_no int, caption_no long, src int, box_no long, x0 double, y0 double, x1 double, y1 double"


def components(spark, boxes):
    df = spark.createDataFrame([(1, 0, 1, 0, i, *map(float, b)) for i, b in enumerate(boxes)], BOX)
    rows = figures.graphic_components(df).orderBy("component_no").collect()
    return [(r.x0, r.y0, r.x1, r.y1) for r in rows]


def brute_force(boxes):
    """Flood fill on an explicit set of covered cells."""
    left, top = min(b[0] for b in boxes) - 6, min(b[1] for b in boxes) - 6
    cell = lambda v, o: int((v - o) / 4)
    covered = {
        (x, y)
        for x0, y0, x1, y1 in boxes
        for x in range(cell(x0 - 6, left), cell(x1 + 6, left) + 1)
        for y in range(cell(y0 - 6, top), cell(y1 + 6, top) + 1)
    }
    label, count = {}, 0
    for start in sorted(covered):
        if start in label:
            continue
        count += 1
        stack = [start]
        while stack:
            x, y = stack.pop()
            if (x, y) in covered and (x, y) not in label:
                label[x, y] = count
                stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    groups = {}
    for b in boxes:
        spot = int((b[0] + b[2]) / 2 - left) // 4, int((b[1] + b[3]) / 2 - top) // 4
        groups.setdefault(label[spot], []).append(b)
    return [(min(b[0] for b in g), min(b[1] for b in g), max(b[2] for b in g), max(b[3] for b in g)) for g in groups.values()]


def test_crowded_curve_is_one_component(spark):
    spots = [(60 + i * 7 % 240, 300 + 80 * np.sin(i * 7 % 240 / 25)) for i in range(9000)]
    got = components(spark, [(x, y, x + 3.0, y + 3.0) for x, y in spots])
    assert len(got) == 1
    x0, y0, x1, y1 = got[0]
    assert x1 - x0 > 230 and y1 - y0 > 150


def test_components_match_flood_fill(spark):
    rng = random.Random(3)
    for size in (1, 5, 40):
        boxes = []
        for _ in range(size):
            x, y = rng.uniform(0, 560), rng.uniform(0, 740)
            boxes.append((x, y, x + rng.uniform(1, 60), y + rng.uniform(0, 40)))
        assert components(spark, boxes) == brute_force(boxes)


def table(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name])


def page_with_figure(spark):
    pages = table(spark, "doc_page", [(1, 0, 0.0, 0.0, 612.0, 792.0, 60), (1, 1, 0.0, 0.0, 612.0, 792.0, 10)])
    text = table(spark, "text_line", [
        (1, 0, 0, "Fig. 7: Flow", 120.0, 300.0, 380.0, 312.0), (1, 1, 0, "plain text", 50.0, 50.0, 90.0, 62.0)])
    drawing = table(spark, "drawing", [
        (1, 0, 0, 80.0, 60.0, 500.0, 280.0, [4]), (1, 0, 1, 100.0, 80.0, 450.0, 250.0, [6]), (1, 0, 2, 80.0, 600.0, 500.0, 600.0, [2])])
    images = table(spark, "image_placement", [
        (1, 0, 0, 31, 32, 90, 70, 150.0, 100.0, 400.0, 240.0), (1, 1, 0, 33, 0, 24, 16, 10.0, 10.0, 60.0, 60.0)])
    streams = table(spark, "page_stream", [(1, 0, 40, "contents"), (1, 0, 41, "form"), (1, 0, 41, "form")])
    sizes = table(spark, "stream_size", [(1, 31, 900), (1, 32, 40), (1, 33, 60), (1, 40, 350), (1, 41, 250)])
    return text, drawing, images, pages, streams, sizes


def test_figure_detection_and_catalog(spark):
    text, drawing, images, pages, streams, sizes = page_with_figure(spark)
    found = flows.detect_figures(text, drawing, images, pages, streams, sizes)
    rows = found.collect()
    assert len(rows) == 1
    fig = rows[0]
    assert (fig.label, fig.x0, fig.y0, fig.x1, fig.y1) == ("Fig. 7", 77.0, 57.0, 503.0, 283.0)
    # 600 content bytes; two of three paths lie inside, next to 60 text characters.
    weight = {r.draw_no: r.w for r in drawing.select("draw_no", scalars.path_weight(F.col("item_arity")).alias("w")).collect()}
    assert fig.storage_bytes == round(600 * (weight[0] + weight[1]) / (sum(weight.values()) + 60)) + 940
    assets = flows.list_assets(found, images, sizes).orderBy("catalog_pos").collect()
    assert [(a.key, a.storage_bytes, a.storage_is_estimate) for a in assets] == [
        ("figure:0:1", fig.storage_bytes, True), ("image:33", 60, False)]
    out = flows.export_graphics(flows.list_assets(found, images, sizes), images).orderBy("index").collect()
    assert [(o.stem, o.preservation_mode) for o in out] == [
        ("0001_page_1_figure_Fig._7", "mixed-vector-raster-preserved"), ("0002_page_2_image_24x16", "original-raster-preserved")]


def test_panels_merge_until_nothing_fits(spark):
    caption = spark.createDataFrame(
        [(1, 0, 1, "Fig. 1", 500.0, 0.0, 0.0, 600.0, 800.0)],
        "doc_id long, page_no int, caption_no long, label string, y0 double, px0 double, py0 double, px1 double, py1 double")
    parts = [(100, 400, 200, 480), (230, 400, 330, 480), (100, 300, 330, 360), (100, 10, 330, 100), (100, 385, 105, 390)]
    df = spark.createDataFrame(
        [(1, 0, 1, i, *map(float, p)) for i, p in enumerate(parts)],
        "doc_id long, page_no int, caption_no long, component_no int, x0 double, y0 double, x1 double, y1 double")
    r = figures.merge_panels(df, caption).head()
    assert (r.x0, r.y0, r.x1, r.y1) == (97.0, 297.0, 333.0, 483.0)
    assert figures.nearest_component(df).head().component_no == 0


def test_panel_growth_against_one_caption_at_a_time():
    rng = np.random.default_rng(12)
    sizes = rng.integers(1, 9, 60)
    corner = rng.uniform(0, 500, (int(sizes.sum()), 2))
    parts = np.concatenate([corner, corner + rng.uniform(18, 120, corner.shape)], axis=1)
    number = np.repeat(np.arange(60), sizes)
    got = figures._grow(parts, number)
    for c in range(60):
        mine = parts[number == c]
        assert (got[c] == figures._grow(mine, np.zeros(len(mine), np.int64))[0]).all()
        inside = (mine[:, :2] >= got[c, :2]).all(axis=1) & (mine[:, 2:] <= got[c, 2:]).all(axis=1)
        lowest = mine[mine[:, 3] == mine[:, 3].max()]
        assert inside.any() and (lowest[0, 3] <= got[c, 3])
        # What stayed outside is neither beside the result nor stacked on it.
        for p in mine[~inside]:
            shared = np.minimum(p[2:], got[c, 2:]) - np.maximum(p[:2], got[c, :2])
            short = np.maximum(1, np.minimum(p[2:] - p[:2], got[c, 2:] - got[c, :2]))
            beside = shared[1] / short[1] >= 0.45 and -shared[0] <= 42
            assert not (beside or (shared[0] / short[0] >= 0.45 and -shared[1] <= 50))


def test_far_coordinates_still_meet(spark):
    caption = spark.createDataFrame(
        [(1, 0, 1, 25_000.0, 22_000.0, "full", 0.0, 0.0, 600.0, 30_000.0), (1, 1, 1, 15_000.0, 12_000.0, "full", 0.0, 0.0, 600.0, 30_000.0)],
        "doc_id long, page_no int, caption_no long, y0 double, lower_limit double, lane string, px0 double, py0 double, px1 double, py1 double")
    boxes = spark.createDataFrame(
        [(1, 0, 0, 1, 100.0, 24_000.0, 300.0, 24_990.0), (1, 1, 0, 1, 100.0, 14_000.0, 300.0, 14_990.0)],
        "doc_id long, page_no int, src int, box_no long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.page_no for r in figures.caption_candidates(caption, boxes).collect()) == [0, 1]
    region = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 1e12, 1e12)], "doc_id long, page_no int, r int, x0 double, y0 double, x1 double, y1 double")
    far = spark.createDataFrame([(1, 0, 1, 1e11, 1e11, 2e11, 2e11)], "doc_id long, page_no int, n int, x0 double, y0 double, x1 double, y1 double")
    assert figures.boxes_inside(far, region).count() == 1
    images = spark.createDataFrame([(1, 0, 5.0, 5.0, 9.0, 1e12)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert figures.regions_with_raster(region, images).count() == 1


def test_centre_on_the_edge(spark):
    region = spark.createDataFrame([(1, 0, 7, 10.0, 10.0, 20.0, 20.0)], "doc_id long, page_no int, r int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame(
        [(1, 0, n, x - 1.0, y - 1.0, x + 1.0, y + 1.0) for n, (x, y) in enumerate([(10.0, 10.0), (20.0, 15.0), (15.0, 20.0), (19.9, 19.9)])],
        "doc_id long, page_no int, n int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.n for r in figures.boxes_inside(boxes, region).collect()) == [0, 3]


def filtered(page):
    want = page.copy()
    for y in range(1, page.shape[0] - 1):
        for x in range(1, page.shape[1] - 1):
            want[y, x] = np.clip(9 * page[y, x] - page[y - 1:y + 2, x - 1:x + 2].sum(), 0, 255)
    return want


TILE = "doc_id long, page_no int, page_width int, page_height int, x0 int, y0 int, width int, pixels array<int>"


def cut(page, wide, high, page_no=0):
    """The rows of a page in tiles."""
    height, width = page.shape
    return [
        (1, page_no, width, height, x, y, min(wide, width - x), [int(v) for v in page[y:y + high, x:x + wide].ravel()])
        for y in range(0, height, high) for x in range(0, width, wide)
    ]


def test_edge_filter_against_numpy(spark):
    rng = np.random.default_rng(5)
    page = rng.integers(0, 256, (6, 9))
    assert (quality._edges(page) == filtered(page)).all()
    assert (quality._edges(page[:2]) == page[:2]).all() and (quality._edges(page[:, :1]) == page[:, :1]).all()


@pytest.mark.parametrize("shape,tiles,cell", [
    ((6, 9), ((9, 6), (9, 6)), 64), ((6, 9), ((2, 3), (9, 1)), 4), ((13, 7), ((1, 1), (3, 5)), 1), ((1, 11), ((4, 4), (11, 1)), 2),
    ((40, 33), ((16, 7), (33, 40)), 16), ((17, 2), ((2, 2), (1, 17)), 5), ((8, 8), ((8, 8), (3, 3)), 8),
])
def test_any_tiles_give_the_same_sums(spark, shape, tiles, cell):
    rng = np.random.default_rng(sum(shape))
    ref, cand = (rng.integers(0, 256, shape) // (1 + 14 * (rng.random(shape) < 0.3)) for _ in range(2))
    sides = [spark.createDataFrame(cut(p, *t), TILE) for p, t in zip((ref, cand), tiles)]
    got = quality.page_sums(*sides, cell=cell).collect()
    assert len(got) == 1 and got[0].matched and got[0].same
    assert (got[0].pixels, got[0].error) == (ref.size, int(((ref - cand) ** 2).sum()))
    assert got[0].edge_error == int(((filtered(ref) - filtered(cand)) ** 2).sum())
    assert (got[0].reference_dark, got[0].candidate_dark) == (int((ref < 18).sum()), int((cand < 18).sum()))
    again = quality.page_sums(quality.cut_pages(sides[0], 4, 2), sides[1].union(sides[1]), cell=cell).collect()
    assert again == got


def test_pages_that_tiles_do_not_cover(spark):
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (10, 10))
    whole = [row for p in range(8) for row in cut(page, 4, 4, p)]
    odd = {
        0: cut(page, 4, 4, 0)[1:], 1: cut(page, 4, 4, 1) + [(1, 1, 10, 10, 3, 3, 2, [0] * 4)], 2: [(*r[:3], 11, *r[4:]) for r in cut(page, 4, 4, 2)],
        3: [(*r[:7], r[7][:-1]) if k == 4 else r for k, r in enumerate(cut(page, 4, 4, 3))], 4: [(*r[:7], None) if k == 0 else r for k, r in enumerate(cut(page, 4, 4, 4))],
        5: cut(page, 10, 10, 5), 6: [], 7: [(*r[:7], [300] * len(r[7])) if k == 2 else r for k, r in enumerate(cut(page, 4, 4, 7))],
    }
    odd[8] = cut(page, 4, 4, 8) + [(1, 8, 10, 10, 50, 3, 2, [0] * 4)]
    odd[9] = [(*r[:4], r[4] - 1, *r[5:]) for r in cut(page, 4, 4, 9)]
    whole += cut(page, 4, 4, 8) + cut(page, 4, 4, 9)
    sums = quality.page_sums(spark.createDataFrame(whole, TILE), spark.createDataFrame([r for rows in odd.values() for r in rows], TILE), cell=4)
    assert {r.page_no: (r.matched, r.same) for r in sums.collect()} == {p: (p != 6, p == 5) for p in range(10)}
    assert quality.fidelity_of_sums(sums).head().size_mismatch == 8
    nothing = spark.createDataFrame([], TILE)
    assert quality.fidelity_of_sums(quality.page_sums(nothing, nothing)).count() == 0


def test_identical_pages_are_perfect(spark):
    pages = spark.createDataFrame([(1, p, [p * 9 % 256] * 16, 4) for p in range(3)], "doc_id long, page_no int, pixels array<int>, width int")
    pairs = quality.pair_pages(pages, pages.where("page_no < 2"))
    counts = quality.page_counts(pairs).head()
    assert (counts.pages_compared, counts.page_count_preserved) == (2, False)
    assert quality.fidelity(pairs).head().psnr_db == 99.0
    assert quality.edge_similarity(pairs).head().edge_similarity == 1.0
    assert quality.dark_regression(pairs).head().dark_regression is False


def test_pages_of_different_size_have_no_score(spark):
    schema = "doc_id long, page_no int, pixels array<int>, width int"
    ref = spark.createDataFrame([(1, 0, [0] * 16, 4), (1, 1, [9] * 16, 4), (2, 0, [5] * 8, 4)], schema)
    cand = spark.createDataFrame([(1, 0, [255] * 9, 3), (1, 1, [9] * 16, 4), (2, 0, [5] * 8, 2)], schema)
    pairs = quality.pair_pages(ref, cand)
    for r in quality.fidelity(pairs).collect():
        assert (r.mse, r.psnr_db, r.size_mismatch) == (None, None, 1)
    assert {(r.edge_similarity, r.size_mismatch) for r in quality.edge_similarity(pairs).collect()} == {(None, 1)}
    assert {(r.max_dark_increase, r.dark_regression, r.size_mismatch) for r in quality.dark_regression(pairs).collect()} == {(None, None, 1)}


def test_text_survives_new_line_breaks(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 7)
    schema = "doc_id long, page_no int, line_no int, text string"
    ref = spark.createDataFrame([(1, 0, 0, "the quick brown"), (1, 1, 0, "fox jumps over"), (2, 0, 0, "abcdefghij"), (3, 0, 0, "same")], schema)
    cand = spark.createDataFrame([(1, 0, 0, "the quick"), (1, 0, 1, " brown fox"), (1, 1, 0, "jumps  over"), (2, 0, 0, "abcdefghiX"), (3, 0, 0, "same"), (3, 1, 0, " ")], schema)
    empty_page = spark.createDataFrame([(2, 7, 0, "")], schema)
    got = {r.doc_id: r for r in quality.text_preservation(ref, cand, ref.union(empty_page), cand.union(empty_page)).collect()}
    assert [got[i].text_exact for i in (1, 2, 3)] == [True, False, True]
    assert [got[i].page_count_preserved for i in (1, 2, 3)] == [True, True, False]
    assert got[1].length_ratio == 1.0


def test_ranks_of_a_hot_document(spark, monkeypatch):
    """Half of a large document by size, in chunks, equals a plain ranking; so do small and tied ones."""
    many = 300_000
    rows = spark.range(many + 900).select(
        F.when(F.col("id") < many, 1).otherwise(F.col("id") % 3 + 2).cast("long").alias("doc_id"), (F.col("id") * 7919 % 100_003).alias("storage_bytes"),
        F.col("id").cast("string").alias("key"), (F.col("id") % 50).cast("int").alias("page_no"), F.col("id").alias("region_no"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        (F.col("id") * 31 % 997 / 7).alias("x1"), (F.col("id") % 13 / 3).alias("y1"),
    )
    monkeypatch.setattr(catalog, "SMALL_K", 10)
    monkeypatch.setattr(catalog.chunks, "CHUNK_WIDTH", 5_000)
    k = many // 2
    rows.createOrReplaceTempView("hot_rows")
    order = {"size_rank": "storage_bytes DESC, doc_id, key", "area_rank": "greatest(0, x1 * y1), page_no, region_no"}
    for name, got in (("size_rank", catalog.largest_assets(rows, k, ["doc_id"])), ("area_rank", catalog.smallest_regions(rows, k))):
        want = spark.sql(f"SELECT key, row_number() OVER (PARTITION BY doc_id ORDER BY {order[name]}) AS r FROM hot_rows").where(F.col("r") <= k)
        same = got.select("key", F.col(name).alias("g")).join(want, "key", "full")
        assert same.where("g IS DISTINCT FROM r").count() == 0 and got.count() == k + 900
        assert {r["size_rank" if name == "size_rank" else "area_rank"] for r in (catalog.largest_assets(rows, 2, ["doc_id"]) if name == "size_rank" else catalog.smallest_regions(rows, 2)).collect()} == {1, 2}


def test_boxes_inside_on_crowded_and_other_pages(spark, monkeypatch):
    rng = random.Random(8)

    def some(n, wide):
        at = [(rng.randint(0, 1), float(rng.randint(0, 500)), float(rng.randint(0, 700)), rng.randint(1, wide)) for _ in range(n)]
        return [(1, p, i, x, y, x + w, y + w) for i, (p, x, y, w) in enumerate(at)] + [(1, 2, n, 10.0, 10.0, 90.0, 90.0)]

    boxes, regions = some(200, 30), some(30, 300)
    schema = "doc_id long, page_no int, {} int, x0 double, y0 double, x1 double, y1 double"
    b, r = spark.createDataFrame(boxes, schema.format("n")), spark.createDataFrame(regions, schema.format("m"))
    want = sorted((p[2], q[2]) for p in boxes for q in regions if p[1] == q[1]
                  and q[3] <= (p[3] + p[5]) / 2 < q[5] and q[4] <= (p[4] + p[6]) / 2 < q[6])
    for few in (128, 5, 0):
        monkeypatch.setattr(figures, "FEW_FIGURES", few)
        inside = figures.boxes_inside(b, r)
        assert sorted((x.n, x.m) for x in inside.collect()) == want
        if few == 128:  # no region is repeated for tiles where pages hold few
            assert "Generate" not in inside._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_boxes_and_cells_give_the_same_components(spark, monkeypatch):
    """Few boxes are compared in pairs, many are summed by cell; half of the captions take either way."""
    rng = random.Random(14)
    rows = []
    for caption in range(60):
        for box in range(rng.randrange(1, 30)):
            x, y = rng.randrange(0, 400) / 2, rng.randrange(0, 400) / 2
            rows.append((1, caption % 3, caption, box % 2, box // 2, float(x), float(y), x + rng.randrange(0, 60) / 2, y + rng.randrange(0, 60) / 2))
    df = spark.createDataFrame(rows, "doc_id long, page_no int, caption_no long, src int, box_no long, x0 double, y0 double, x1 double, y1 double")
    found = lambda frame: sorted(map(tuple, frame.collect()))
    expected = found(figures._components_by_cell(df, figures.CAPTION_KEY))
    monkeypatch.setattr(figures, "_components_by_cell", None)
    assert found(figures.graphic_components(df)) == expected == found(figures.graphic_components(df, boxes=df))
    monkeypatch.undo()
    monkeypatch.setattr(figures, "FEW_BOXES", 14)
    assert found(figures.graphic_components(df)) == expected == found(figures.graphic_components(df, boxes=df))


def test_running_values_of_small_keys_need_no_carry(spark):
    """Without a key above the limit the values are those of keys that are cut."""
    rng = random.Random(11)
    df = spark.createDataFrame([(rng.randrange(4), i, rng.choice([None, 1, 2, 5])) for i in range(200)], "k int, o long, v long")
    wanted = dict(
        n=chunks.count(), s=chunks.sum_upto(F.col("v")), b=chunks.sum_before(F.col("v")), m=chunks.max_upto(F.col("v")), p=chunks.last_before(F.col("v")),
    )
    found = [
        sorted(map(str, chunks.scan(df, ["k"], [F.col("o")], chunks.by_width(F.col("o"), 16), only_above=limit, **wanted).collect()))
        for limit in (None, 10, 1000)
    ]
    assert found[0] == found[1] == found[2]
