"""Sets of pages as runs."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import intervals
from quirework.operators import catalog


def plain_runs(values):
    out = []
    for v in sorted({v for v in values if v is not None}):
        if out and out[-1][1] == v - 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_runs_equal_sorted_sets(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "WIDTH", width)
    rng = random.Random(width)
    keys = {k: [rng.randint(-20, 40) for _ in range(rng.choice([1, 5, 60, 300]))] for k in range(12)}
    keys[12], keys[13] = [None], [None, 7, 7, None, 8]
    rows = [(k, v, str(v)) for k, some in keys.items() for v in some]
    got = intervals.interval_sets(spark.createDataFrame(rows, "k int, v int, t string").repartition(3), ["k"], "v", least=F.col("t")).collect()
    assert {r.k: [tuple(x) for x in r.runs] for r in got} == {k: plain_runs(v) for k, v in keys.items()}
    assert {r.k: r.least for r in got} == {k: min(map(str, some)) for k, some in keys.items()}
    one = spark.createDataFrame(rows, "k int, v int, t string")
    texts = {r.k: r.ranges for r in catalog.format_ranges(one, ["k"], "v", "; ").collect()}
    assert texts[13] == "8-9" and texts[12] == ""
    sizes = intervals.interval_sets(one, ["k"], "v").select("k", intervals.size(F.col("runs")).alias("n"), intervals.numbers(F.col("runs")).alias("all"))
    assert {r.k: (r.n, r["all"]) for r in sizes.collect()} == {k: (len(set(v) - {None}), sorted(set(v) - {None})) for k, v in keys.items()}


def test_an_image_on_ten_million_pages(spark):
    pages = spark.range(10_000_000).where("id <> 7000000").select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"), F.lit(0).cast("long").alias("placement_no"),
        F.lit(5).cast("long").alias("xref"), F.lit(0).cast("long").alias("smask"), F.lit(20).alias("width"), F.lit(10).alias("height"),
    )
    row = catalog.image_catalog(pages).head()
    assert [tuple(r) for r in row.page_runs] == [(0, 6_999_999), (7_000_001, 9_999_999)]
    assert (row.first_page, row.pages, row.width) == (0, 9_999_999, 20)
    stem = catalog.asset_stem(catalog.image_catalog(pages).select("page_runs", "width", "height", F.lit("image").alias("kind"), F.lit("").alias("title"), F.lit(3).alias("index")))
    assert stem.head().stem == "0003_page_1-7000000_7000002-10000000_image_20x10"
