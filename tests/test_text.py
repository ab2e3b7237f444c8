import pytest
from pyspark.sql import functions as F

from quirework.operators import captions, catalog, compose


def lines(spark, rows):
    return spark.createDataFrame(
        [(1, p, i, t, x0, y0, x1, y0 + 12.0) for i, (p, t, x0, y0, x1) in enumerate(rows)],
        "doc_id long, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("text,label", [
    ("Fig. 3: curve", "Fig. 3"), ("Figure 12a - curve", "Figure 12a"), ("　图 3：曲线", "图 3"), ("FIG 1.", "FIG 1"),
    ("figure 2 – x", "figure 2"), ("Figure 3 shows", None), ("see Fig. 3: x", None), ("Figure: x", None), ("Fig.４: x", "Fig.４"),
])
def test_caption_wording(spark, text, label):
    got = captions.captions(lines(spark, [(0, text, 0.0, 0.0, 10.0)])).collect()
    assert [r.label for r in got] == ([label] if label else [])


@pytest.mark.parametrize("text,start,end", [
    ("Results", True, False), (" 3.2 Results and Discussion ", True, False), ("实验结果", True, False), ("the results", False, False),
    ("4 Conclusions", False, True), ("参考文献", False, True), ("Acknowledgements", False, True), ("Acknowledgments", False, True), ("　结论　", False, True),
])
def test_headings(spark, text, start, end):
    row = captions.heading_flags(lines(spark, [(0, text, 0.0, 0.0, 10.0)])).head()
    assert (row.is_results, row.is_end) == (start, end)


def test_results_section(spark):
    rows = lines(spark, [(0, "Method", 0.0, 0.0, 9.0), (1, "Results and discussion", 0.0, 0.0, 9.0), (2, "More results", 0.0, 0.0, 9.0), (3, "Conclusion", 0.0, 0.0, 9.0)])
    pages = spark.range(4).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"))
    found = captions.section_pages(rows, pages)
    assert sorted(r.page_no for r in found.collect()) == [1, 2]
    assert catalog.format_ranges(found, ["doc_id"], "page_no").head().ranges == "2-3"


def test_lanes_remember_the_last_caption(spark):
    page = spark.createDataFrame([(1, 0, 0.0, 0.0, 600.0, 800.0)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    rows = lines(spark, [
        (0, "Fig. 1: a", 50.0, 100.0, 250.0), (0, "Fig. 2: b", 320.0, 300.0, 550.0), (0, "Fig. 3: c", 50.0, 350.0, 560.0),
        (0, "Fig. 4: d", 50.0, 500.0, 250.0), (0, "Fig. 5: e", 320.0, 600.0, 560.0)])
    got = captions.lane_limits(captions.caption_lane(captions.captions(rows), page)).orderBy("caption_no").collect()
    assert [r.lane for r in got] == ["left", "right", "full", "left", "right"]
    assert [r.lower_limit for r in got] == [0.0, 0.0, 312.0, 362.0, 362.0]


@pytest.mark.parametrize("text,pages", [
    ("4-2 9", [3, 2, 1, 8]), ("6，6-7", [5, 6]), ("8-8,1", [7, 0]), (" ", []), ("3,9-7,8", [2, 8, 7, 6]),
    ("10", None), ("0-3", None), ("2-", None), ("two", None), ("3-4-5", None), ("1/2", None), ("7-10", None), ("2,,x", None)])
def test_ordered_ranges(spark, text, pages):
    df = spark.createDataFrame([(text, 9)], "t string, n int")
    got = compose.parse_ranges_ordered(df, "t", "n").orderBy("entry_pos").collect()
    if pages is None:
        assert [(r.reason, r.page_index) for r in got] == [("invalid", None)]
    else:
        assert [r.page_index for r in got if r.page_index is not None] == pages and {r.reason for r in got} == {""}


@pytest.mark.parametrize("text,pages", [
    ("5,2-3", {4, 1, 2}), ("3—4，6", {2, 3, 5}), (" 2 - 2 ,", {1}), ("", set()), ("6-7", None), ("5-4", None), ("ten", None), ("1-2-3-4", None), ("7", None)])
def test_set_ranges(spark, text, pages):
    df = spark.createDataFrame([(text, 6)], "t string, n int")
    got = compose.parse_ranges_set(df, "t", "n").collect()
    if pages is None:
        assert [(r.reason, r.page_index) for r in got] == [("invalid", None)]
    else:
        assert {r.page_index for r in got if r.page_index is not None} == pages


def test_captions_with_one_place_and_number_have_an_order(spark):
    page = spark.createDataFrame([(1, 0, 0.0, 0.0, 600.0, 800.0)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, 0, 7, "Figure 2: b", 60.0, 50.0, 460.0, 62.0), (1, 0, 7, "Figure 1: a", 60.0, 50.0, 260.0, 62.0), (1, 0, 7, "Fig. 3: c", 60.0, 50.0, 260.0, 62.0)]
    schema = "doc_id long, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double"
    for order in (rows, rows[::-1]):
        found = captions.captions(spark.createDataFrame(order, schema).coalesce(1))
        got = captions.lane_limits(captions.caption_lane(found, page)).orderBy("caption_no").collect()
        assert [(r.label, r.lane, r.lower_limit) for r in got] == [("Fig. 3", "left", 0.0), ("Figure 1", "left", 62.0), ("Figure 2", "full", 62.0)]
