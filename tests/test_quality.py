from pyspark.sql import functions as F

from quirework.operators import compose, quality
from quirework.sources import sinks


def test_lines_are_joined_before_they_are_shuffled(spark):
    """Neighbours in a task become one row; a gap, another page or document, a slab's or a block's end begins a new one."""
    rows = [(1, 0, 0, "ab"), (1, 0, 1, ""), (1, 0, 2, "é c"), (1, 0, 4, "d"), (1, 1, 5, "e"), (2, 1, 6, "f"), (2, 1, 7, "g" * 5000), (2, 1, 8, "h")]
    rows += [(None, 0, 65_535, "i"), (3, 0, 65_535, "j"), (3, 0, 65_536, "k")]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_no long, t string").coalesce(1)
    assert [tuple(r) for r in quality._runs_of_lines(lines).collect()] == [
        (1, 0, 0, "abé c"), (1, 0, 4, "d"), (1, 1, 5, "e"), (2, 1, 6, "f" + "g" * 5000), (2, 1, 8, "h"), (None, 0, 65_535, "i"),
        (3, 0, 65_535, "j"), (3, 0, 65_536, "k"),
    ]


def test_manifests_are_shuffled_once(spark):
    assets = spark.createDataFrame([(1, 2, "b", "image", [1], ""), (1, 1, "a", "figure", [0], "t"), (2, 1, None, "image", [3], "")],
                                   "doc_id long, index int, key string, kind string, page_numbers array<int>, title string")
    files = spark.createDataFrame([(1, "a", "svg", "a.svg", 5), (1, "a", "png", "a.png", 6), (1, "x", "pdf", "x.pdf", 7), (2, None, "pdf", "n.pdf", 9)],
                                  "doc_id long, key string, format string, name string, bytes long")
    made = sinks.build_manifests(assets, files)
    found = {r.doc_id: r for r in made.collect()}
    assert [(i["index"], i["source_asset_key"], i["files"]) for i in found[1]["items"]] == [(1, "a", {"png": "a.png", "svg": "a.svg"}), (2, "b", {})]
    assert (found[1].payload_bytes, found[2].payload_bytes, found[2]["items"][0]["files"]) == (11, 0, {})
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_links_are_looked_up_before_they_are_widened(spark):
    """A page used twice carries its links twice; targets, rectangles and addresses as stated."""
    refs = spark.createDataFrame([(1, 0, 7, 1), (1, 1, 7, 0), (1, 2, 7, 1), (2, 0, 7, 1)], "plan_id long, pos int, source long, page_index long")
    link = spark.createDataFrame(
        [(7, 1, 1, "goto", 0, None), (7, 1, 2, "goto", 5, None), (7, 1, 3, "uri", None, "u"), (7, 1, 4, "named", 0, None), (7, 1, 5, None, 0, None), (7, 1, 6, "goto", 0, None)],
        "doc_id long, page_no long, link_no int, kind string, target_page long, uri string",
    ).select("*", *(F.lit(float(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1", "target_x", "target_y"))))
    made = compose.remap_links(refs, link)
    rows = sorted((r.plan_id, r.output_page, r.link_no, r.target_page, r.target_x, r.x1, r.uri) for r in made.collect())
    assert rows == [
        *((1, pos, n, *((None, None, 2.0, "u") if n == 3 else (1, 4.0, 2.0, None))) for pos in (0, 2) for n in (1, 3, 6)), (2, 0, 3, None, None, 2.0, "u"),
    ]
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lookups = [line for line in plan if "Join" in line and "plan_id" in line]
    assert lookups and not any("x0" in line or "uri" in line for line in lookups)
