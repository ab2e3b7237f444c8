"""Jobs of several steps keep the shuffle files of one step at a time."""

import subprocess
import time

import pytest
from pyspark.sql import functions as F

from quirework.operators import catalog
from quirework.plans.queries import QUERIES
from quirework.session import stored

SF_DIR = "/root/testdata/sf0.001"


def shuffle_files(spark):
    """Those that hold more than a few rows a task, as a total over a table does."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = subprocess.run(["find", *folders, "-name", "shuffle_*.data", "-size", "+1k", "-printf", "%f\n"], capture_output=True, text=True)
    return set(found.stdout.split())


def left_since(spark, before):
    """The files that are still there when Spark, which deletes them in the background, has had its time."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    return shuffle_files(spark) - before


def test_stored_rows_leave_no_shuffle_files(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"), F.array("id").alias("a"))
    before = shuffle_files(spark)
    kept = stored(rows.repartition(3, "id").join(rows.groupBy("k").agg(F.max("id").alias("most")), "k"), "test")
    assert not left_since(spark, before)
    assert kept.select("id", "k", "a").dtypes == rows.dtypes
    assert kept.agg(F.count("*"), F.sum("id")).first()[:] == (1000, 499_500)
    assert stored(rows.where("id < 0"), "test").count() == 0


@pytest.mark.parametrize("name, most", [
    ("compress_flow", 4), ("export_graphics", 2), ("f1_catalog_order", 1), ("d5_asset_catalog_g1_union", 0),
])
def test_last_step_shuffles_little(spark, name, most):
    """What earlier steps found is read from where it was stored, and their shuffle files are gone."""
    before = shuffle_files(spark)
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most
    assert not left_since(spark, before)


def test_pages_of_an_image_meet_once(spark):
    """where no page lies beyond the first chunk, images are grouped once; beyond it the result is the same."""
    fields = "doc_id long, page_no int, placement_no long, xref long, smask long, width int, height int"
    rows = [(d, (7 * i) % 50, i, i % 3, i % 2, 10 * i, i) for d in range(4) for i in range(40)]

    def images(far):
        placed = [(d, p + far * (p > 20), *rest) for d, p, *rest in rows]
        frame = catalog.image_catalog(spark.createDataFrame(placed, fields).repartition(3))
        exchanges = frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = {(r.doc_id, r.xref): (r.first_page, r.smask, r.width, r.pages, [n for a, b in r.page_runs for n in range(a, b + 1)]) for r in frame.collect()}
        expected = {}
        for d, x in {(d, x) for d, _, _, x, *_ in placed if x > 0}:
            mine = sorted((p, n, s, w) for e, p, n, y, s, w, _ in placed if (e, y) == (d, x))
            pages = sorted({p for p, *_ in mine})
            expected[d, x] = (mine[0][0], mine[0][2], mine[0][3], len(pages), pages)
        assert got == expected
        return exchanges

    assert images(0) == 1 and images(9000) == 2
