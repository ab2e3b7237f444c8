import pytest
from pyspark.sql import functions as F

from quirework.functions import chunks, scalars
from quirework.operators import budget, catalog, compose


def column(spark, values, kind, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr(F.col("v"))).orderBy("i").collect()]


def test_human_bytes_rounds_halves_to_even(spark):
    values = [0, 1023, 1024, 1280, 1536, 1024**2 - 1, 1024**2, 5 * 1024**2 + 5243]
    expected = [
        f"{v} B" if v < 1024 else f"{v / 1024:.1f} KB" if v < 1024**2 else f"{v / 1024**2:.2f} MB" for v in values
    ]
    assert column(spark, values, "long", scalars.human_bytes) == expected


def test_parse_size(spark):
    rows = [("3.12", "MB", 3271557), ("0.5", "KB", None), (" 2 ", "KB", 2048), ("1e3", "KB", 1024000), ("NaN", "MB", None),
            ("-1", "MB", None), ("abc", "MB", None), ("1_000", "KB", 1024000), ("", "KB", None), ("1.9999", "KB", 2047)]
    df = spark.createDataFrame([(i, v, u) for i, (v, u, _) in enumerate(rows)], "i int, v string, u string")
    got = df.select("i", scalars.parse_size(F.col("v"), F.col("u"))).orderBy("i").collect()
    assert [r[1] for r in got] == [r[2] for r in rows]


def test_quality_profile_ends(spark):
    got = column(spark, [-5.0, 0.0, 50.0, 100.0, 130.0], "double", scalars.quality_profile)
    assert [(p.image_scale, p.jpeg_quality, p.dpi) for p in got] == [
        (0.25, 45, 180), (0.25, 45, 180), (0.625, 72, 450), (1.0, 98, 720), (1.0, 98, 720)]


@pytest.mark.parametrize("step,levels", [(40, 14), (400, 2), (150, 4), (1000, 2)])
def test_quality_ladder(spark, step, levels):
    rows = budget.quality_ladder(spark, step).orderBy("level").collect()
    # With step 150 the scores are 0, 150, 300, 400: none lies in the fine-grained range.
    assert len(rows) == levels and rows[-1].score == 400 and rows[0].dpi == 180
    assert [r.level for r in rows] == list(range(levels))


def test_ladder_fine_steps(spark):
    rows = budget.quality_ladder(spark).collect()
    by_score = {r.score: r for r in rows}
    for score in (200, 240, 280):
        assert by_score[score + 10].jpeg_quality == by_score[score].jpeg_quality + 1
        assert by_score[score + 10].dpi == by_score[score].dpi


def test_path_weight(spark):
    assert column(spark, [[2, 5, 1], [], None, [None]], "array<int>", scalars.path_weight) == [72, 1, 1, 12]


def test_safe_fragment(spark):
    values = ["CON", " a/b:c . ", "ｆｏｏ\tbar", "...", "x" * 80, "Lpt9", "a\x01b"]
    expected = ["_CON", "a_b_c", "foobar", "figure", "x" * 64, "_Lpt9", "ab"]
    assert column(spark, values, "string", lambda c: scalars.safe_fragment(c, "figure")) == expected


def test_natural_sort(spark):
    names = ["5th.pdf", "2nd.pdf", "1st.pdf", "a10", "A2", "a02", "a1b", "a1", "straße", "strasse2"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "queue_id int, ord int, name string")
    got = [r.name for r in compose.natural_sort(df, "name").orderBy("sorted_pos").collect()]
    assert got == ["1st.pdf", "2nd.pdf", "5th.pdf", "a1", "a1b", "A2", "a02", "a10", "straße", "strasse2"]


def test_digest_and_whitespace(spark):
    assert column(spark, ["a" * 64, "A" * 63, "g" * 64, None, "a" * 64 + "\n"], "string", scalars.is_sha256) == [True, False, False, False, False]
    assert column(spark, ["a b　c\n\td\x1c"], "string", scalars.strip_whitespace) == ["abcd"]


def test_saved_ratio(spark):
    df = spark.createDataFrame([(0, 5), (10, 4), (10, 12)], "a long, b long")
    assert [round(r[0], 6) for r in df.select(scalars.saved_ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.6, 0.0]


def test_ranges_text(spark):
    assert column(spark, [[0, 1, 2, 4, 6, 7], [3], []], "array<int>", scalars.ranges_text) == ["1-3, 5, 7-8", "4", ""]


def test_asset_stem(spark):
    df = spark.createDataFrame(
        [("figure", [4, 2, 3], "Fig. 3", None, None, 7), ("image", [0], None, 20, 10, 12), ("image", [0], None, 0, 10, 3)],
        "kind string, page_numbers array<int>, title string, width int, height int, index int",
    )
    assert [r.stem for r in catalog.asset_stem(df).orderBy("index").collect()] == [
        "0003_page_1_image", "0007_page_3-5_figure_Fig._3", "0012_page_1_image_20x10"]


def test_scan_matches_plain_windows(spark):
    df = spark.range(3000).selectExpr("id % 3 AS k", "id", "CAST(id * 37 % 101 AS INT) AS v")
    for above in (None, 10, 10_000):
        got = chunks.scan(
            df, ["k"], [F.col("id")], chunks.by_width(F.col("id"), 64), only_above=above,
            n=chunks.count(), s=chunks.sum_upto(F.col("v")), b=chunks.sum_before(F.col("v")), m=chunks.max_upto(F.col("v")),
            last=chunks.last_before(F.when(F.col("v") == 7, F.col("id"))),
        )
        df.createOrReplaceTempView("scan_input")
        want = spark.sql("""SELECT k, id, v, row_number() OVER w AS n, sum(v) OVER w AS s, coalesce(sum(v) OVER b, 0) AS b, max(v) OVER w AS m,
            last(CASE WHEN v = 7 THEN id END, true) OVER b AS last FROM scan_input
            WINDOW w AS (PARTITION BY k ORDER BY id ROWS UNBOUNDED PRECEDING),
                   b AS (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_order_statistics_with_copies(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_WIDTH", 10)
    rows = [(1, float(v % 7)) for v in range(100)] + [(2, 5.0)] * 3 + [(2, -1e9), (3, 0.25)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = chunks.order_statistics(df, ["k"], "v", lo=F.floor((F.col("n") - 1) / 2), hi=F.floor(F.col("n") / 2))
    for r in got.collect():
        values = sorted(v for k, v in rows if k == r.k)
        assert (r.lo, r.hi) == (values[(len(values) - 1) // 2], values[len(values) // 2])
