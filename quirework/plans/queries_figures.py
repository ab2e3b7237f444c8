"""Queries for page geometry, figures, images and the asset catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import rects
from quirework.operators import audit, captions, catalog, figures
from quirework.plans import flows
from quirework.plans.queries_scalar import CAPTION_SQL
from quirework.plans.registry import Tables, query
from quirework.session import stored

ANCHORED_VIEWS = ("text_line", "doc_page")
ANCHORED = rf"""
laned AS (
  SELECT c.*, p.x0 AS px0, p.y0 AS py0, p.x1 AS px1, p.y1 AS py1,
         regexp_extract(text, '{CAPTION_SQL}', 1, 'i') AS label,
         CASE WHEN c.x1 - c.x0 <= (p.x1 - p.x0) * 0.47::DOUBLE AND c.x1 <= (p.x0 + p.x1) / 2 + 10 THEN 'left'
              WHEN c.x1 - c.x0 <= (p.x1 - p.x0) * 0.47::DOUBLE AND c.x0 >= (p.x0 + p.x1) / 2 - 10 THEN 'right' ELSE 'full' END AS lane
  FROM text_line AS c JOIN doc_page AS p USING (doc_id, page_no) WHERE regexp_matches(text, '{CAPTION_SQL}', 'i')),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no) AS caption_no,
         coalesce(last_value(CASE WHEN lane <> 'right' THEN y1 END IGNORE NULLS) OVER w, py0) AS l,
         coalesce(last_value(CASE WHEN lane <> 'left' THEN y1 END IGNORE NULLS) OVER w, py0) AS r
  FROM laned WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
anchored AS (SELECT *, CASE lane WHEN 'left' THEN l WHEN 'right' THEN r ELSE greatest(l, r) END AS lower_limit FROM numbered)"""

GEOMETRY = ("text_line", "drawing", "image_placement", "doc_page", "page_stream", "stream_size")


@query("b6_caption_lane", "SELECT doc_id, page_no, line_no, lane FROM laned", ANCHORED_VIEWS, ANCHORED)
def _(t: Tables):
    found = captions.captions(t("text_line"))
    return captions.caption_lane(found, t("doc_page")).select("doc_id", "page_no", "line_no", "lane")


@query("f2_caption_order", "SELECT doc_id, page_no, line_no, caption_no FROM anchored", ANCHORED_VIEWS, ANCHORED)
def _(t: Tables):
    return captions.caption_order(captions.captions(t("text_line"))).select("doc_id", "page_no", "line_no", "caption_no")


@query("e5_lane_limits", "SELECT doc_id, page_no, caption_no, lane, lower_limit FROM anchored", ANCHORED_VIEWS, ANCHORED)
def _(t: Tables):
    return flows.anchored_captions(t("text_line"), t("doc_page")).select(
        "doc_id", "page_no", "caption_no", "lane", "lower_limit"
    )


CANDIDATES = """
candidates AS (
    SELECT doc_id, page_no, caption_no, src, box_no, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1 FROM (
      SELECT a.doc_id, a.page_no, caption_no, src, box_no, a.y0 AS top, lower_limit + 2 AS lim,
             CASE WHEN lane = 'right' THEN (px0 + px1) / 2 - 8 ELSE px0 END AS lx0, CASE WHEN lane = 'left' THEN (px0 + px1) / 2 + 8 ELSE px1 END AS lx1,
             greatest(b.x0, px0) AS cx0, greatest(b.y0, py0) AS cy0, least(b.x1, px1) AS cx1, least(b.y1, py1) AS cy1
      FROM anchored a JOIN (
        SELECT doc_id, page_no, 0 AS src, draw_no AS box_no, x0, y0, x1, y1 FROM drawing
        UNION ALL SELECT doc_id, page_no, 1, placement_no, x0, y0, x1, y1 FROM image_placement) b
      ON a.doc_id = b.doc_id AND a.page_no = b.page_no)
    WHERE cy0 >= lim - 2 AND cy1 <= top + 2 AND cy1 > lim AND cx1 > cx0 AND cy1 >= cy0
      AND greatest(0, least(cx1, lx1) - greatest(cx0, lx0)) >= least(4, greatest(0.1::DOUBLE, (cx1 - cx0) * 0.2::DOUBLE)))"""
CANDIDATE_VIEWS = (*ANCHORED_VIEWS, "drawing", "image_placement")

# Two boxes touch if their blocks of grid cells overlap or share a cell edge; components are counted
# in the order of their first boxes.
COMPONENTS = ANCHORED + "," + CANDIDATES + """,
extent AS (SELECT doc_id, page_no, caption_no, min(x0) - 6 AS ox, min(y0) - 6 AS oy FROM candidates GROUP BY ALL),
block AS MATERIALIZED (
  SELECT c.*, src::BIGINT * 4611686018427387904 + box_no AS seen, row_number() OVER () AS id,
         floor(floor((x0 + x1) / 2 - ox) / 4) AS mx, floor(floor((y0 + y1) / 2 - oy) / 4) AS my,
         CAST(floor((x0 - 6 - ox) / 4) AS INT) AS a, CAST(floor((y0 - 6 - oy) / 4) AS INT) AS b,
         CAST(floor((x1 + 6 - ox) / 4) AS INT) AS c, CAST(floor((y1 + 6 - oy) / 4) AS INT) AS d
  FROM candidates c JOIN extent USING (doc_id, page_no, caption_no)),
touching AS (
  SELECT p.doc_id, p.page_no, p.caption_no, p.id, q.id AS other FROM block p JOIN block q
  ON p.doc_id = q.doc_id AND p.page_no = q.page_no AND p.caption_no = q.caption_no
  AND (p.a <= q.c AND q.a <= p.c AND p.b <= q.d + 1 AND q.b <= p.d + 1 OR p.b <= q.d AND q.b <= p.d AND p.a <= q.c + 1 AND q.a <= p.c + 1)),
reach AS (
  SELECT doc_id, page_no, caption_no, id, id AS root FROM block
  UNION
  SELECT r.doc_id, r.page_no, r.caption_no, t.other, r.root FROM reach r JOIN touching t
  ON r.doc_id = t.doc_id AND r.page_no = t.page_no AND r.caption_no = t.caption_no AND r.id = t.id),
rooted AS (SELECT doc_id, page_no, caption_no, id, min(root) AS root FROM reach GROUP BY ALL),
components AS (
  SELECT doc_id, page_no, caption_no, row_number() OVER (PARTITION BY doc_id, page_no, caption_no ORDER BY first_box) AS component_no, x0, y0, x1, y1
  FROM (SELECT doc_id, page_no, caption_no, root, min((seen, my, mx)) AS first_box, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
        FROM block JOIN rooted USING (doc_id, page_no, caption_no, id) GROUP BY ALL)),
parts AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, caption_no ORDER BY component_no) AS i, count(*) OVER (PARTITION BY doc_id, page_no, caption_no) AS n
  FROM components WHERE x1 - x0 >= 18 AND y1 - y0 >= 10),
nearest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, caption_no ORDER BY y1 DESC, greatest(0, (x1 - x0) * (y1 - y0)) DESC, component_no) = 1),
grow AS (
  SELECT doc_id, page_no, caption_no, n, x0, y0, x1, y1, [i] AS joined, 1::BIGINT AS i, false AS grew FROM nearest
  UNION ALL
  SELECT doc_id, page_no, caption_no, n, CASE WHEN ok THEN least(x0, u0) ELSE x0 END, CASE WHEN ok THEN least(y0, v0) ELSE y0 END,
         CASE WHEN ok THEN greatest(x1, u1) ELSE x1 END, CASE WHEN ok THEN greatest(y1, v1) ELSE y1 END,
         CASE WHEN ok THEN list_append(joined, i) ELSE joined END,
         CASE WHEN i < n THEN i + 1 WHEN grew OR ok THEN 1 ELSE n + 1 END, i < n AND (grew OR ok)
  FROM (SELECT g.*, p.x0 AS u0, p.y0 AS v0, p.x1 AS u1, p.y1 AS v1, NOT list_contains(joined, g.i) AND (
          (least(g.y1, p.y1) - greatest(g.y0, p.y0)) / greatest(1, least(g.y1 - g.y0, p.y1 - p.y0)) >= 0.45::DOUBLE AND greatest(g.x0, p.x0) - least(g.x1, p.x1) <= 42
          OR (least(g.x1, p.x1) - greatest(g.x0, p.x0)) / greatest(1, least(g.x1 - g.x0, p.x1 - p.x0)) >= 0.45::DOUBLE AND greatest(g.y0, p.y0) - least(g.y1, p.y1) <= 50) AS ok
        FROM grow g JOIN parts p ON g.doc_id = p.doc_id AND g.page_no = p.page_no AND g.caption_no = p.caption_no AND g.i = p.i)),
page_region AS (
  SELECT * FROM (
    SELECT doc_id, page_no, caption_no AS region_no, label, greatest(px0, g.x0 - 3) AS x0, greatest(py0, g.y0 - 3) AS y0,
           least(px1, g.x1 + 3) AS x1, least(a.y0 - 1, g.y1 + 3) AS y1
    FROM grow g JOIN anchored a USING (doc_id, page_no, caption_no) WHERE g.i = g.n + 1)
  WHERE x1 - x0 >= 18 AND y1 - y0 >= 10)"""


@query("c2_caption_candidates", "SELECT * FROM candidates", CANDIDATE_VIEWS, ANCHORED + "," + CANDIDATES)
def _(t: Tables):
    found = flows.anchored_captions(t("text_line"), t("doc_page"))
    return figures.caption_candidates(found, figures.graphics(t("drawing"), t("image_placement")))


def _parts(t: Tables):
    found = flows.anchored_captions(t("text_line"), t("doc_page"))
    boxes = figures.graphics(t("drawing"), t("image_placement"))
    return found, figures.graphic_components(figures.caption_candidates(found, boxes), boxes=boxes)


@query("i1_graphic_components", "SELECT doc_id, page_no, caption_no, component_no::INT AS component_no, x0, y0, x1, y1 FROM components", CANDIDATE_VIEWS, COMPONENTS)
def _(t: Tables):
    return _parts(t)[1]


@query("e6_nearest_component", "SELECT doc_id, page_no, caption_no, component_no::INT AS component_no, x0, y0, x1, y1 FROM nearest", CANDIDATE_VIEWS, COMPONENTS)
def _(t: Tables):
    return figures.nearest_component(_parts(t)[1])


def _total_order(sql: str) -> str:
    """The same captions in the total order of ``captions``, as lines may share place and number."""
    return sql.replace("ORDER BY y0, x0, line_no", "ORDER BY y0, x0, line_no, x1, y1, text")


@query("i2_merge_panels", "SELECT doc_id, page_no, region_no AS caption_no, label, x0, y0, x1, y1 FROM page_region", CANDIDATE_VIEWS, _total_order(COMPONENTS))
def _(t: Tables):
    found, parts = _parts(t)
    return figures.merge_panels(parts, found)


def _regions(t: Tables):
    """Given regions in the role of detected figures."""
    return t("page_region").withColumnRenamed("region_no", "caption_no")


INSIDE = "(b.x0 + b.x1) / 2 >= g.x0 AND (b.x0 + b.x1) / 2 < g.x1 AND (b.y0 + b.y1) / 2 >= g.y0 AND (b.y0 + b.y1) / 2 < g.y1"


@query("c3_boxes_inside", f"""
    SELECT g.doc_id, g.page_no, g.region_no, g.x0, b.draw_no FROM page_region g JOIN drawing b
    ON g.doc_id = b.doc_id AND g.page_no = b.page_no AND {INSIDE}""", ("page_region", "drawing"))
def _(t: Tables):
    inside = figures.boxes_inside(t("drawing"), t("page_region").select("doc_id", "page_no", "region_no", *rects.SIDES))
    return inside.select("doc_id", "page_no", "region_no", F.col("rx0").alias("x0"), "draw_no")


@query("c4_regions_with_raster_b23_mode", """
    SELECT doc_id, region_no, x0, CASE WHEN kind = 'image' THEN 'original-raster-preserved'
           WHEN EXISTS (SELECT 1 FROM image_placement i WHERE i.doc_id = g.doc_id AND i.page_no = g.page_no
                        AND least(g.x1, i.x1) > greatest(g.x0, i.x0) AND least(g.y1, i.y1) > greatest(g.y0, i.y0))
           THEN 'mixed-vector-raster-preserved' ELSE 'native-vector-preserved' END AS preservation_mode
    FROM page_region g""", ("page_region", "image_placement"))
def _(t: Tables):
    regions = t("page_region").withColumn(
        "key", F.concat_ws(":", F.col("region_no").cast("string"), F.col("x0").cast("string"), F.col("y1").cast("string"))
    )
    return catalog.preservation_mode(regions, figures.regions_with_raster(regions, t("image_placement"))).select(
        "doc_id", "region_no", "x0", "preservation_mode"
    )


STORAGE = f"""
contents AS (
  SELECT doc_id, page_no, sum(CASE WHEN xref > 0 THEN coalesce(bytes, 0) ELSE 0 END) AS content_bytes FROM (
    SELECT doc_id, page_no, xref FROM page_stream WHERE role = 'contents'
    UNION ALL SELECT DISTINCT doc_id, page_no, xref FROM page_stream WHERE role = 'form' AND xref > 0)
  LEFT JOIN stream_size USING (doc_id, xref) GROUP BY doc_id, page_no),
weighted AS (SELECT *, greatest(1, list_sum(list_transform(item_arity, lambda n: greatest(12, 12 * (n - 1))))) AS weight FROM drawing),
totals AS (SELECT p.doc_id, p.page_no, text_chars + coalesce(w, 0) AS total FROM doc_page p
           LEFT JOIN (SELECT doc_id, page_no, sum(weight) AS w FROM weighted GROUP BY ALL) USING (doc_id, page_no)),
masks AS (SELECT doc_id, page_no, xref, arg_max(smask, placement_no) AS smask FROM image_placement WHERE xref > 0 GROUP BY ALL),
sized AS (SELECT m.*, coalesce(a.bytes, 0) + CASE WHEN smask > 0 THEN coalesce(b.bytes, 0) ELSE 0 END AS bytes FROM masks m
          LEFT JOIN stream_size a ON a.doc_id = m.doc_id AND a.xref = m.xref
          LEFT JOIN stream_size b ON b.doc_id = m.doc_id AND b.xref = m.smask),
inside_images AS (SELECT DISTINCT g.doc_id, g.page_no, region_no, b.xref FROM page_region g JOIN image_placement b
  ON g.doc_id = b.doc_id AND g.page_no = b.page_no AND b.xref > 0 AND {INSIDE}),
image_part AS (SELECT i.doc_id, i.page_no, region_no, sum(bytes) AS bytes FROM inside_images i JOIN sized USING (doc_id, page_no, xref) GROUP BY ALL),
vector_part AS (SELECT g.doc_id, g.page_no, region_no, sum(weight) AS w FROM page_region g JOIN weighted b
  ON g.doc_id = b.doc_id AND g.page_no = b.page_no AND {INSIDE} GROUP BY ALL),
figure_size AS (
  SELECT g.*, CAST(round_even(coalesce(content_bytes, 0)::DOUBLE * coalesce(w, 0) / greatest(1, total), 0) AS BIGINT) + coalesce(i.bytes, 0) AS storage_bytes
  FROM page_region g LEFT JOIN contents USING (doc_id, page_no) JOIN totals USING (doc_id, page_no)
  LEFT JOIN vector_part USING (doc_id, page_no, region_no) LEFT JOIN image_part i USING (doc_id, page_no, region_no))"""
STORAGE_VIEWS = ("page_region", "drawing", "page_stream", "stream_size", "doc_page", "image_placement")


def _stored(t: Tables):
    return figures.figure_storage(
        _regions(t), t("drawing"), t("page_stream"), t("stream_size"), t("doc_page"), t("image_placement")
    )


@query("d3_figure_storage", "SELECT doc_id, page_no, region_no, x0, storage_bytes FROM figure_size", STORAGE_VIEWS, STORAGE)
def _(t: Tables):
    return _stored(t).select("doc_id", "page_no", F.col("caption_no").alias("region_no"), "x0", "storage_bytes")


IMAGES = """
first_place AS (
  SELECT doc_id, xref, page_no AS first_page, smask, width, height FROM image_placement WHERE xref > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id, xref ORDER BY page_no, placement_no, smask, width, height) = 1),
seen AS (SELECT doc_id, xref, count(DISTINCT page_no) AS pages FROM image_placement WHERE xref > 0 GROUP BY ALL),
images AS (SELECT * FROM first_place JOIN seen USING (doc_id, xref)),
stored_images AS (
  SELECT i.*, coalesce(a.bytes, 0) + CASE WHEN i.smask > 0 AND i.smask <> i.xref THEN coalesce(b.bytes, 0) ELSE 0 END AS storage_bytes
  FROM images i LEFT JOIN stream_size a ON a.doc_id = i.doc_id AND a.xref = i.xref
  LEFT JOIN stream_size b ON b.doc_id = i.doc_id AND b.xref = i.smask)"""
IMAGE_VIEWS = ("image_placement", "stream_size")


@query("d1_image_catalog", "SELECT * FROM images", IMAGE_VIEWS, IMAGES)
def _(t: Tables):
    return catalog.image_catalog(t("image_placement")).withColumn("pages", F.col("pages").cast("int")).drop("page_runs")


@query("d2_images_within", """
    SELECT doc_id, xref, first_page, smask FROM (
      SELECT doc_id, xref, bool_and(text_chars >= 400) AS within, min(page_no) AS first_page, arg_min(smask, (page_no, placement_no, smask)) AS smask
      FROM image_placement JOIN doc_page USING (doc_id, page_no) WHERE xref > 0 GROUP BY ALL) WHERE within""",
    ("image_placement", "doc_page"))
def _(t: Tables):
    return catalog.images_within(t("image_placement"), t("doc_page").where("text_chars >= 400"))


@query("d4_image_storage_c6_lookup", "SELECT doc_id, xref, smask, storage_bytes FROM stored_images", IMAGE_VIEWS, IMAGES)
def _(t: Tables):
    images = catalog.image_catalog(t("image_placement"))
    return figures.image_storage(images, t("stream_size")).select("doc_id", "xref", "smask", "storage_bytes")


def _rest_images(t: Tables):
    inside = stored(figures.images_in_figures(_regions(t), t("image_placement")).select("doc_id", "xref").distinct(), "images-inside")
    return catalog.exclude_figure_images(catalog.image_catalog(t("image_placement")), inside)


@query("c5_exclude_figure_images", """
    SELECT doc_id, xref, first_page FROM images i WHERE NOT EXISTS (
      SELECT 1 FROM inside_images f WHERE f.doc_id = i.doc_id AND f.xref = i.xref)""",
    STORAGE_VIEWS, STORAGE + "," + IMAGES)
def _(t: Tables):
    return _rest_images(t).select("doc_id", "xref", "first_page")


CATALOG = STORAGE + "," + IMAGES + """,
assets AS (
  SELECT doc_id, concat('figure:', page_no, ':', region_no) AS key, 'figure' AS kind, page_no AS first_page, storage_bytes FROM figure_size
  UNION ALL SELECT doc_id, concat('image:', xref), 'image', first_page, storage_bytes FROM stored_images i WHERE NOT EXISTS (
      SELECT 1 FROM inside_images f WHERE f.doc_id = i.doc_id AND f.xref = i.xref))"""


def _assets(t: Tables):
    rows = _stored(t).withColumn("label", F.lit("Figure"))
    return catalog.asset_catalog(rows, figures.image_storage(_rest_images(t), t("stream_size")))


@query("d5_asset_catalog_g1_union", "SELECT * FROM assets", STORAGE_VIEWS, CATALOG)
def _(t: Tables):
    return _assets(t).select("doc_id", "key", "kind", F.get("page_runs", F.lit(0))["first"].alias("first_page"), "storage_bytes")


@query("f1_catalog_order", """
    SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY first_page, kind, key) AS catalog_pos FROM assets""",
    STORAGE_VIEWS, CATALOG)
def _(t: Tables):
    return catalog.catalog_order(_assets(t)).select("doc_id", "key", "catalog_pos")


def _figures(t: Tables):
    return flows.detect_figures(*(t(n) for n in GEOMETRY))


@query("i3_detect_figures", """
    SELECT doc_id, page_no, region_no AS caption_no, label, x0, y0, x1, y1, CAST(storage_bytes AS BIGINT) AS storage_bytes, true AS storage_is_estimate FROM figure_size""",
    GEOMETRY, _total_order(COMPONENTS) + "," + STORAGE)
def _(t: Tables):
    return _figures(t).select(
        "doc_id", "page_no", "caption_no", "label", *rects.SIDES, "storage_bytes", "storage_is_estimate"
    )


DETECTED = COMPONENTS + "," + CATALOG + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_page, kind, key) AS catalog_pos FROM assets)"""


@query("list_assets", """
    SELECT doc_id, catalog_pos, key, kind, CAST(storage_bytes AS BIGINT) AS storage_bytes, kind = 'figure' AS storage_is_estimate FROM ordered""",
    GEOMETRY, DETECTED)
def _(t: Tables):
    assets = flows.list_assets(_figures(t), t("image_placement"), t("stream_size"))
    return assets.select("doc_id", "catalog_pos", "key", "kind", "storage_bytes", "storage_is_estimate")


@query("export_graphics", """
    WITH spots AS (SELECT DISTINCT doc_id, xref, page_no + 1 AS p FROM image_placement WHERE xref > 0),
    islands AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, xref ORDER BY p) AS island FROM spots),
    pieces AS (SELECT doc_id, xref, min(p) AS low, CASE WHEN min(p) = max(p) THEN min(p)::VARCHAR ELSE min(p) || '-' || max(p) END AS piece FROM islands GROUP BY doc_id, xref, island),
    pages AS (SELECT doc_id, concat('image:', xref) AS key, string_agg(piece, '_' ORDER BY low) AS pages FROM pieces GROUP BY doc_id, xref),
    dims AS (SELECT doc_id, concat('image:', xref) AS key, width, height FROM images),
    named AS (SELECT doc_id, page_no, concat('figure:', page_no, ':', region_no) AS key, label, x0, y0, x1, y1 FROM page_region)
    SELECT o.doc_id, o.key,
           CASE WHEN kind = 'figure' THEN printf('%04d_page_%d_figure_', o.catalog_pos, n.page_no + 1) || regexp_replace(label, '\\s+', '_', 'g')
                ELSE printf('%04d_page_', o.catalog_pos) || pages || '_image' || CASE WHEN d.width <> 0 AND d.height <> 0 THEN '_' || d.width || 'x' || d.height ELSE '' END END AS stem,
           CASE WHEN kind = 'image' THEN 'original-raster-preserved'
                WHEN EXISTS (SELECT 1 FROM image_placement i WHERE i.doc_id = n.doc_id AND i.page_no = n.page_no
                             AND least(n.x1, i.x1) > greatest(n.x0, i.x0) AND least(n.y1, i.y1) > greatest(n.y0, i.y0))
                THEN 'mixed-vector-raster-preserved' ELSE 'native-vector-preserved' END AS preservation_mode
    FROM ordered o LEFT JOIN named n ON n.doc_id = o.doc_id AND n.key = o.key LEFT JOIN pages p ON p.doc_id = o.doc_id AND p.key = o.key
    LEFT JOIN dims d ON d.doc_id = o.doc_id AND d.key = o.key""", GEOMETRY, DETECTED)
def _(t: Tables):
    assets = flows.list_assets(_figures(t), t("image_placement"), t("stream_size"))
    return flows.export_graphics(assets, t("image_placement")).select("doc_id", "key", "stem", "preservation_mode")


@query("d6_selection_summary", """
    SELECT a.doc_id, count(s.key) AS selected, count(*) AS total, count(s.key) FILTER (kind = 'figure') AS figures,
           count(s.key) FILTER (kind = 'image') AS images, coalesce(sum(storage_bytes) FILTER (s.key IS NOT NULL), 0) AS bytes
    FROM asset a LEFT JOIN selection s ON a.doc_id = s.doc_id AND a.key = s.key GROUP BY a.doc_id""", ("asset", "selection"))
def _(t: Tables):
    return catalog.selection_summary(t("asset"), t("selection"))


@query("c10_apply_selection", """
    SELECT a.doc_id, a.key, a.xref FROM asset a SEMI JOIN selection s ON a.doc_id = s.doc_id AND a.key = s.key""", ("asset", "selection"))
def _(t: Tables):
    return catalog.apply_selection(t("asset"), t("selection")).select("doc_id", "key", "xref")


@query("f4_largest_assets_per_document", """
    SELECT doc_id, key, storage_bytes, size_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY storage_bytes DESC, doc_id, key) AS size_rank FROM asset) WHERE size_rank <= 3""",
    ("asset",))
def _(t: Tables):
    return catalog.largest_assets(t("asset"), 3, ["doc_id"]).select("doc_id", "key", "storage_bytes", "size_rank")


@query("f4_largest_assets_of_corpus", """
    SELECT doc_id, key, storage_bytes FROM asset ORDER BY storage_bytes DESC, doc_id, key LIMIT 100""", ("asset",))
def _(t: Tables):
    return catalog.largest_assets(t("asset"), 100).select("doc_id", "key", "storage_bytes")


@query("e7_smallest_regions", """
    SELECT doc_id, page_no, region_no, area, area_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area, page_no, region_no) AS area_rank
      FROM (SELECT *, greatest(0, (x1 - x0) * (y1 - y0)) AS area FROM page_region)) WHERE area_rank <= 5""", ("page_region",))
def _(t: Tables):
    return catalog.smallest_regions(t("page_region"), 5).select("doc_id", "page_no", "region_no", "area", "area_rank")


@query("d12_bounding_box", """
    SELECT doc_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM drawing GROUP BY ALL""", ("drawing",))
def _(t: Tables):
    return catalog.bounding_box(t("drawing"), ["doc_id", "page_no"])


@query("d11_export_summary", """
    SELECT doc_id, count(DISTINCT key) AS items, count(DISTINCT key) FILTER (kind = 'figure') AS figures,
           count(DISTINCT key) FILTER (kind = 'image') AS images, count(*) FILTER (format = 'svg') AS svg_count,
           count(*) FILTER (format = 'png') AS png_count, count(*) FILTER (format = 'pdf') AS pdf_count,
           sum(bytes) AS payload_bytes, count(DISTINCT key) <= 8 AND sum(bytes) <= 300000 AS within_limits
    FROM export_file GROUP BY doc_id""", ("export_file",))
def _(t: Tables):
    return audit.export_summary(t("export_file"), max_items=8, max_bytes=300_000)
