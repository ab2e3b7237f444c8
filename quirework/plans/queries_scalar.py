"""Queries for sources, scalars, text and page ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import rects, scalars
from quirework.operators import budget, captions, catalog, compose, intake
from quirework.plans import flows
from quirework.plans.registry import Tables, query
from quirework.session import fresh_dir
from quirework.sources import files, sinks


@query("a1_file_inventory")
def _(t: Tables):
    return files.file_inventory(t.spark, t.sf_dir, "*.parquet").select("name", "size_bytes", "size_mib")


@query("a1_describe_documents", """
    SELECT doc_id, n_chars AS size_bytes, round_even(n_chars / 1048576.0, 3) AS size_mib, upper(sha256(text)) AS sha256
    FROM documents""")
def _(t: Tables):
    return t("documents").select("doc_id", *files.describe(F.col("n_chars"), F.sha2("text", 256)))


@query("a2_load_tables", """
    SELECT doc_id, count(*) AS boxes, sum(list_sum(item_arity)) AS items, max(x1) AS right_edge FROM drawing GROUP BY doc_id""",
    ("drawing",))
def _(t: Tables):
    base = fresh_dir(t.spark, "tables")
    t("drawing").write.parquet(f"{base}/drawing")
    loaded = files.load_table(t.spark, base, "drawing")
    items = F.aggregate("item_arity", F.lit(0).cast("long"), lambda a, x: a + x)
    return loaded.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.sum(items).alias("items"), F.max("x1").alias("right_edge")
    )


@query("a3_load_runs", """
    SELECT case_name, label, count(*) AS runs, sum(bytes) AS bytes, max(seconds) AS slowest FROM bench_run GROUP BY ALL""",
    ("bench_run",))
def _(t: Tables):
    base = fresh_dir(t.spark, "reports")
    run = F.struct(F.col("case_name").alias("case"), "label", "seconds", "bytes", "text_preserved")
    # One report per block of run numbers, so a report has a bounded number of runs.
    reports = t("bench_run").groupBy(F.floor(F.col("run_no") / 500).alias("block")).agg(F.collect_list(run).alias("runs"))
    reports.drop("block").write.json(base)
    return files.load_runs(t.spark, base, multi_line=False).groupBy("case_name", "label").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("bytes").alias("bytes"), F.max("seconds").alias("slowest")
    )


@query("a4_refused_manifests", """
    SELECT doc_id, count(*) AS item_count, 'too_many_items' AS reason FROM asset GROUP BY doc_id HAVING count(*) > 8""", ("asset",))
def _(t: Tables):
    return sinks.refused_manifests(t("asset"), 8)


@query("a4_write_manifest", """
    SELECT doc_id, count(*) AS item_count, count(*) FILTER (kind = 'figure') AS figure_count,
           count(*) FILTER (format = 'svg') AS svg_count, count(*) FILTER (format = 'pdf') AS pdf_count,
           sum(bytes) AS payload_bytes, count(DISTINCT format) AS formats, sum(l_linenumber) AS pages
    FROM (SELECT *, CAST(string_split(key, ':')[2] AS BIGINT) + 1 AS l_linenumber FROM export_file) GROUP BY doc_id HAVING count(*) <= 20000""",
    ("export_file",))
def _(t: Tables):
    files_ = t("export_file")
    assets = t("asset").select(
        "doc_id", (F.col("page_no") + 1).alias("index"), "key", "kind", F.array("page_no").alias("page_numbers"),
        F.lit("").alias("title"),
    )
    path = fresh_dir(t.spark, "manifest")
    sinks.write_manifests(sinks.build_manifests(assets, files_), path)
    from quirework.schemas import MANIFEST

    pages = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.get(i["source_pages"], F.lit(0)))
    return t.spark.read.schema(MANIFEST).json(path).select(
        "doc_id", "item_count", "figure_count", "svg_count", "pdf_count", "payload_bytes",
        F.size("requested_formats").alias("formats"), pages.alias("pages"),
    )


@query("a5_write_once", "SELECT doc_id, n_chars FROM documents")
def _(t: Tables):
    path = fresh_dir(t.spark, "once")
    sinks.write_once(t("documents").select("doc_id", "n_chars"), path)
    return t.spark.read.schema("doc_id BIGINT, n_chars BIGINT").parquet(path)


@query("a6_publish", "SELECT doc_id, original_bytes, target_bytes FROM target", ("target",))
def _(t: Tables):
    base = fresh_dir(t.spark, "publish")
    rows = t("target").select("doc_id", "original_bytes", "target_bytes")
    oversized = lambda d: d.where("target_bytes < 0")
    snapshot = t("target").select("doc_id", F.col("original_bytes").alias("size_bytes"), *(F.lit(0).alias(c) for c in ("modified_ns", "device", "inode")))
    sinks.publish(rows, base, [oversized], unchanged=lambda: flows.changed_sources(snapshot, snapshot))
    return t.spark.read.schema(rows.schema).parquet(sinks.published_path(t.spark, base))



@query("b2_human_bytes", f"""
    SELECT n, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0)
                   ELSE printf('%.2f MB', n / 1048576.0) END AS human
    FROM (SELECT CAST(floor(l_extendedprice * l_quantity * l_linenumber) AS BIGINT) AS n FROM lineitem
          UNION ALL SELECT l_partkey FROM lineitem)""")
def _(t: Tables):
    li = t("lineitem")
    n = li.select(F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_linenumber")).alias("n"))
    return n.unionByName(li.select(F.col("l_partkey").alias("n"))).select(
        "n", scalars.human_bytes(F.col("n")).alias("human")
    )


SIZE_TEXT = """SELECT l_orderkey, l_partkey,
    CASE l_linenumber WHEN 7 THEN 'abc' WHEN 6 THEN concat('-', CAST(l_partkey AS STRING))
         ELSE concat(' ', CAST(l_partkey AS STRING), '.', CAST(l_linenumber AS STRING)) END AS value,
    CASE WHEN l_returnflag = 'A' THEN 'KB' ELSE 'MB' END AS unit, l_linenumber FROM """


@query("b3_parse_size", f"""
    SELECT value, unit, CASE WHEN l_linenumber < 6 AND size >= 1024 THEN size END AS bytes FROM (
      SELECT *, CAST(floor(TRY_CAST(value AS DECIMAL(18, 3)) * CASE unit WHEN 'MB' THEN 1048576 ELSE 1024 END) AS BIGINT) AS size
      FROM ({SIZE_TEXT} lineitem))""")
def _(t: Tables):
    texts = t.spark.sql(SIZE_TEXT + "{li}", li=t("lineitem"))
    return texts.select("value", "unit", scalars.parse_size(F.col("value"), F.col("unit")).alias("bytes"))


# The same words, as the checking engine reads patterns.
CAPTION_SQL = captions.caption_pattern("(?i)")


@query("b4_captions", f"""
    SELECT doc_id, page_no, line_no, text, regexp_extract(text, '{CAPTION_SQL}', 1, 'i') AS label
    FROM text_line WHERE regexp_matches(text, '{CAPTION_SQL}', 'i')""", ("text_line",))
def _(t: Tables):
    return captions.captions(t("text_line")).select("doc_id", "page_no", "line_no", "text", "label")


RESULTS_SQL = captions.heading_pattern(captions.RESULTS_WORDS, "(?i)")
END_SQL = captions.heading_pattern(captions.END_WORDS, "(?i)")


@query("b5_heading_flags", f"""
    SELECT doc_id, page_no, regexp_matches(text, '{RESULTS_SQL}', 'i') AS is_results,
           regexp_matches(text, '{END_SQL}', 'i') AS is_end, count(*) AS lines
    FROM text_line GROUP BY ALL""", ("text_line",))
def _(t: Tables):
    return captions.heading_flags(t("text_line")).groupBy("doc_id", "page_no", "is_results", "is_end").agg(
        F.count(F.lit(1)).alias("lines")
    )


@query("b7_quality_profile", """
    SELECT score, 0.25::DOUBLE + 0.75::DOUBLE * s / 100 AS image_scale, CAST(round_even(45 + 53 * s / 100, 0) AS INT) AS jpeg_quality,
           CAST(round_even(180 + 540 * s / 100, 0) AS INT) AS dpi, n
    FROM (SELECT score, least(greatest(score, 0), 100)::DOUBLE AS s, n FROM
          (SELECT l_quantity * 3 - 10 AS score, count(*) AS n FROM lineitem GROUP BY 1))""")
def _(t: Tables):
    scored = t("lineitem").groupBy((F.col("l_quantity") * 3 - 10).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return scored.select("score", scalars.quality_profile(F.col("score")).alias("p"), "n").select("score", "p.*", "n")


@query("b8_quality_ladder", """
    SELECT level, score, image_scale, jpeg_quality, dpi, count(*) AS variants, sum(width) AS width
    FROM asset CROSS JOIN ladder GROUP BY ALL""", ("asset",), extra="""
    ladder AS (
      SELECT row_number() OVER (ORDER BY score) - 1 AS level, score, image_scale, jpeg_quality + extra AS jpeg_quality, dpi FROM (
        SELECT CASE WHEN extra = 1 THEN least(399, b + 10) ELSE b END AS score, extra, 0.25::DOUBLE + 0.75::DOUBLE * (b / 4.0) / 100 AS image_scale,
               CAST(round_even(45 + 53 * (b / 4.0::DOUBLE) / 100, 0) AS INT) AS jpeg_quality,
               CAST(round_even(180 + 540 * (b / 4.0::DOUBLE) / 100, 0) AS INT) AS dpi
        FROM (SELECT unnest(range(0, 401, 40)) AS b) CROSS JOIN (SELECT unnest([0, 1]) AS extra)
        WHERE extra = 0 OR b BETWEEN 200 AND 280)
      )""")
def _(t: Tables):
    return budget.ladder_variants(t("asset")).groupBy("level", "score", "image_scale", "jpeg_quality", "dpi").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("width").alias("width")
    )


@query("b9_path_weight", """
    SELECT doc_id, draw_no, x0, CAST(greatest(1, list_sum(list_transform(item_arity, lambda n: greatest(12, 12 * (n - 1))))) AS BIGINT) AS weight
    FROM drawing""", ("drawing",))
def _(t: Tables):
    return t("drawing").select("doc_id", "draw_no", "x0", scalars.path_weight(F.col("item_arity")).alias("weight"))


@query("b10_rect_algebra", """
    SELECT d.doc_id, d.draw_no, d.x0, least(d.x0, 100) AS ux0, greatest(d.y1, 300) AS uy1,
           greatest(0, least(d.x1, 400) - greatest(d.x0, 100)) AS overlap_x,
           greatest(0, least(d.y1, 300) - greatest(d.y0, 50)) AS overlap_y,
           NOT (d.x1 + 12 < 100 OR 400 + 12 < d.x0 OR d.y1 + 12 < 50 OR 300 + 12 < d.y0) AS near,
           (d.x0 + d.x1) / 2 >= 100 AND (d.x0 + d.x1) / 2 < 400 AND (d.y0 + d.y1) / 2 >= 50 AND (d.y0 + d.y1) / 2 < 300 AS inside,
           least(302, d.y1 + 3) AS padded_bottom, (d.x1 - d.x0 >= 18 AND d.y1 - d.y0 >= 10) AS big_enough
    FROM drawing AS d""", ("drawing",))
def _(t: Tables):
    box, frame = rects.rect_of(), rects.rect(F.lit(100), F.lit(50), F.lit(400), F.lit(300))
    page = rects.rect(F.lit(0), F.lit(0), F.lit(612), F.lit(792))
    union = rects.rect_union(box, frame)
    return t("drawing").select(
        "doc_id", "draw_no", "x0", union["x0"].alias("ux0"), union["y1"].alias("uy1"),
        rects.overlap_x(box, frame).alias("overlap_x"), rects.overlap_y(box, frame).alias("overlap_y"),
        rects.near(box, frame).alias("near"), rects.center_inside(box, frame).alias("inside"),
        rects.pad_and_clamp(box, page, 3.0, F.lit(302.0))["y1"].alias("padded_bottom"),
        rects.big_enough(box).alias("big_enough"),
    )


NAMES = r"""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'con' WHEN o_orderkey % 49 = 0 THEN ' ._ '
    ELSE concat('  ', o_orderpriority, ':  <', CAST(o_orderkey AS STRING), '> a|b?', CAST(o_custkey AS STRING), ' .') END AS title FROM """


@query("b11_safe_fragment", rf"""
    SELECT o_orderkey, CASE WHEN upper(s) = 'CON' THEN concat('_', s) WHEN s = '' THEN 'figure' ELSE s END AS fragment FROM (
      SELECT o_orderkey, rtrim(substr(trim(regexp_replace(regexp_replace(title, '[<>:"/\\|?*]+', '_', 'g'), '\s+', '_', 'g'), ' ._'), 1, 16), ' ._') AS s
      FROM ({NAMES} orders))""")
def _(t: Tables):
    return t.spark.sql(NAMES + "{o}", o=t("orders")).select(
        "o_orderkey", scalars.safe_fragment(F.col("title"), "figure", 16).alias("fragment")
    )


@query("b12_asset_stem", """
    SELECT doc_id, key, concat(lpad(CAST(page_no + 1 AS STRING), 4, '0'), '_page_', page_no + 1, CASE WHEN kind = 'figure' THEN concat('_figure_Fig__', xref)
           ELSE concat('_image_', width, 'x', height) END) AS stem FROM asset""", ("asset",))
def _(t: Tables):
    assets = t("asset").withColumns({
        "index": F.col("page_no") + 1, "page_numbers": F.array("page_no"),
        "title": F.concat(F.lit("Fig: "), F.col("xref").cast("string")),
    })
    return catalog.asset_stem(assets).select("doc_id", "key", "stem")


@query("b13_natural_key_f3_natural_sort", """
    SELECT p_size AS queue_id, p_partkey AS ord, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS sorted_pos FROM part""")
def _(t: Tables):
    queue = t("part").select(
        F.col("p_size").alias("queue_id"), F.col("p_partkey").alias("ord"),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "Part").otherwise("part"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("name"),
    )
    return compose.natural_sort(queue, "name").select("queue_id", "ord", "sorted_pos")


@query("b18_is_sha256", """
    SELECT doc_id, n_chars % 5 <> 0 AS valid FROM documents""")
def _(t: Tables):
    digest = F.sha2("text", 256)
    broken = F.when(F.col("n_chars") % 5 == 0, F.concat(F.substring(digest, 1, 63), F.lit("g"))).otherwise(F.upper(digest))
    return t("documents").select("doc_id", scalars.is_sha256(broken).alias("valid"))


@query("b20_strip_whitespace", r"""
    SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS kept, md5(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents""")
def _(t: Tables):
    plain = scalars.strip_whitespace(F.col("text"))
    return t("documents").select("doc_id", F.length(plain).alias("kept"), F.md5(plain).alias("digest"))


@query("b24_saved_ratio", """
    SELECT doc_id, CASE WHEN original_bytes = 0 THEN 0 ELSE greatest(0, 1 - target_bytes::DOUBLE / original_bytes) END AS saved FROM target""",
    ("target",))
def _(t: Tables):
    return t("target").select("doc_id", scalars.saved_ratio(F.col("original_bytes"), F.col("target_bytes")).alias("saved"))


@query("e1_format_ranges", """
    WITH d AS (SELECT DISTINCT doc_id, page_no, xref FROM image_placement),
    runs AS (SELECT doc_id, xref, min(page_no) + 1 AS a, max(page_no) + 1 AS b FROM (
      SELECT *, page_no - row_number() OVER (PARTITION BY doc_id, xref ORDER BY page_no) AS g FROM d) GROUP BY doc_id, xref, g)
    SELECT doc_id, xref, string_agg(CASE WHEN a = b THEN CAST(a AS STRING) ELSE concat(a, '-', b) END, ', ' ORDER BY a) AS ranges
    FROM runs GROUP BY doc_id, xref""", ("image_placement",))
def _(t: Tables):
    return catalog.format_ranges(t("image_placement"), ["doc_id", "xref"], "page_no")


@query("e13_section_pages", f"""
    WITH s AS (SELECT doc_id, min(page_no) AS a FROM text_line WHERE regexp_matches(text, '{RESULTS_SQL}', 'i') GROUP BY doc_id),
    e AS (SELECT t.doc_id, min(page_no) AS b FROM text_line t JOIN s USING (doc_id)
          WHERE regexp_matches(text, '{END_SQL}', 'i') AND page_no > a GROUP BY t.doc_id)
    SELECT p.doc_id, p.page_no FROM doc_page p JOIN s USING (doc_id) LEFT JOIN e USING (doc_id)
    WHERE p.page_no >= a AND (b IS NULL OR p.page_no < b)""", ("text_line", "doc_page"))
def _(t: Tables):
    return captions.section_pages(t("text_line"), t("doc_page"))


RANGE_TEXT = """SELECT l_orderkey, l_suppkey, l_partkey, 20 AS pages,
    concat(CAST(l_linenumber AS STRING), '-', CAST(l_linenumber + 2 AS STRING), '， ', CAST(l_partkey % 21 AS STRING)) AS up,
    concat(CAST(l_linenumber + 2 AS STRING), '-', CAST(l_linenumber AS STRING), '，', CAST(l_partkey % 21 AS STRING), ' ', CAST(l_linenumber AS STRING)) AS down,
    l_linenumber AS n FROM """


@query("h1_parse_ranges_set", f"""
    SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, up, CASE WHEN ok THEN p - 1 END AS page_index, CASE WHEN ok THEN '' ELSE 'invalid' END AS reason
    FROM (SELECT *, l_partkey % 21 BETWEEN 1 AND 20 AS ok, unnest(CASE WHEN l_partkey % 21 = 0 THEN [0] ELSE [n, n + 1, n + 2, l_partkey % 21] END) AS p
          FROM ({RANGE_TEXT} lineitem))""")
def _(t: Tables):
    # A text's pages are distinct, so equal rows are dropped before each becomes a row a page.
    texts = t.spark.sql(RANGE_TEXT + "{li}", li=t("lineitem")).select("l_orderkey", "l_suppkey", "l_partkey", "up", "pages").distinct()
    return compose.parse_ranges_set(texts, "up", "pages").select(
        "l_orderkey", "l_suppkey", "l_partkey", "up", "page_index", "reason"
    )


@query("h2_parse_ranges_ordered", f"""
    SELECT l_orderkey, l_suppkey, l_partkey, down, CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE i END AS entry_pos,
           CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE p - 1 END AS page_index,
           CASE WHEN l_partkey % 21 = 0 THEN 'invalid' ELSE '' END AS reason
    FROM (SELECT *, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM (
      SELECT *, CASE WHEN l_partkey % 21 = 0 THEN [0] WHEN l_partkey % 21 BETWEEN n AND n + 2 THEN [n + 2, n + 1, n]
                     ELSE [n + 2, n + 1, n, l_partkey % 21] END AS l
      FROM ({RANGE_TEXT} lineitem)))""")
def _(t: Tables):
    texts = t.spark.sql(RANGE_TEXT + "{li}", li=t("lineitem"))
    return compose.parse_ranges_ordered(texts, "down", "pages").select(
        "l_orderkey", "l_suppkey", "l_partkey", "down", "entry_pos", "page_index", "reason"
    )


@query("b1_preflight", """
    SELECT doc_id, reason, CASE WHEN reason = '' THEN pages ELSE 0 END AS pages, reason = '' AND has_forms AS has_forms FROM (
      SELECT *, CASE WHEN size_bytes IS NULL THEN 'missing' WHEN NOT lower(path) LIKE '%.pdf' THEN 'not_a_pdf_name'
        WHEN size_bytes > 4294967296 THEN 'too_large' WHEN needs_pass THEN 'password' WHEN NOT is_pdf OR pages <= 0 THEN 'no_pages'
        WHEN size_bytes <> size_after OR modified_ns <> modified_after THEN 'changed' ELSE '' END AS reason FROM doc_file)""",
    ("doc_file",))
def _(t: Tables):
    return intake.preflight(t("doc_file")).select("doc_id", "reason", "pages", "has_forms")


@query("b1_c1_recheck", """
    WITH verdict AS (SELECT doc_id, size_bytes, modified_ns, reason, CASE WHEN reason = '' THEN pages ELSE 0 END AS pages, reason = '' AND has_forms AS has_forms FROM (
      SELECT *, CASE WHEN size_bytes IS NULL THEN 'missing' WHEN NOT lower(path) LIKE '%.pdf' THEN 'not_a_pdf_name'
        WHEN size_bytes > 4294967296 THEN 'too_large' WHEN needs_pass THEN 'password' WHEN NOT is_pdf OR pages <= 0 THEN 'no_pages'
        WHEN size_bytes <> size_after OR modified_ns <> modified_after THEN 'changed' ELSE '' END AS reason FROM doc_file))
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN modified_ns - 1 ELSE modified_ns END AS modified_ns, 'missing' AS reason, 0 AS pages, false AS has_forms, true AS rechecked
      FROM verdict WHERE doc_id % 9 = 1 AND doc_id % 8 <> 3
    UNION ALL SELECT doc_id, modified_ns, reason, pages, has_forms, doc_id % 8 = 3 OR doc_id % 11 = 0 FROM verdict WHERE doc_id % 9 <> 1""", ("doc_file",))
def _(t: Tables):
    files = t("doc_file")
    # The earlier state lacks some files, has others that are gone now, and some were written since.
    before = intake.preflight(files).where("doc_id % 8 <> 3").withColumn("modified_ns", F.expr("CASE WHEN doc_id % 11 = 0 THEN modified_ns - 1 ELSE modified_ns END"))
    return flows.recheck(before, files.where("doc_id % 9 <> 1")).drop("size_bytes")


@query("b17_validate_tasks", """
    WITH r AS (SELECT *, CASE WHEN dpi NOT BETWEEN 24 AND 1200 THEN 'dpi' WHEN quality NOT BETWEEN 35 AND 100 THEN 'quality'
        WHEN x1 <= x0 OR y1 <= y0 THEN 'no_area' WHEN px > 100000000 THEN 'task_pixels' END AS row_reason
      FROM (SELECT *, (x1 - x0) * dpi / 72 * ((y1 - y0) * dpi / 72) AS px FROM render_task)),
    w AS (SELECT *, count(*) OVER (PARTITION BY batch_id, id) AS same, sum(CASE WHEN row_reason IS NULL THEN px END) OVER (PARTITION BY batch_id) AS total FROM r)
    SELECT batch_id, id, x1, dpi, quality, CASE WHEN row_reason IS NOT NULL THEN row_reason WHEN same > 1 THEN 'duplicate_id'
      WHEN total > 2000000000 THEN 'batch_pixels' ELSE '' END AS reason FROM w""", ("render_task",))
def _(t: Tables):
    return intake.validate_tasks(t("render_task")).select("batch_id", "id", "x1", "dpi", "quality", "reason")


@query("b21_check_payloads", """
    SELECT doc_id, CASE WHEN n IS NULL OR n NOT BETWEEN 4 AND 67108864 THEN 'size' WHEN marked THEN '' ELSE 'format' END AS reason
    FROM (SELECT doc_id, coalesce(lang = 'en', false) AS marked, octet_length(encode(text)) + CASE WHEN lang = 'en' THEN 4 ELSE 0 END AS n FROM documents)""")
def _(t: Tables):
    marks = F.unhex(F.lit("FFD8")), F.unhex(F.lit("FFD9"))
    body = F.col("text").cast("binary")
    content = F.when(F.col("lang") == "en", F.concat(marks[0], body, marks[1])).otherwise(body)
    payloads = t("documents").select("doc_id", content.alias("content")).withColumn("length", F.octet_length("content"))
    return intake.check_payloads(payloads).select("doc_id", "reason")


@query("e8_admit", """
    WITH held AS (SELECT DISTINCT queue_id, lower(path) AS p FROM queue), size AS (SELECT queue_id, count(*) AS n FROM held GROUP BY 1),
    r AS (SELECT i.*, lower(i.path) AS p, h.p IS NOT NULL AS known FROM incoming i LEFT JOIN held h ON h.queue_id = i.queue_id AND h.p = lower(i.path)),
    f AS (SELECT queue_id, p, min(ord) AS first FROM r WHERE is_valid AND NOT known GROUP BY 1, 2),
    k AS (SELECT f.*, row_number() OVER (PARTITION BY f.queue_id ORDER BY first) + coalesce(n, 0) <= 25 AS fits FROM f LEFT JOIN size USING (queue_id))
    SELECT r.queue_id, ord, CASE WHEN known OR (fits AND ord > first) THEN 'duplicate' WHEN NOT is_valid THEN 'invalid'
      WHEN fits THEN 'added' ELSE 'overflow' END AS status
    FROM r LEFT JOIN k ON k.queue_id = r.queue_id AND k.p = r.p""", ("queue", "incoming"))
def _(t: Tables):
    return intake.admit(t("queue"), t("incoming"), cap=25).select("queue_id", "ord", "status")


@query("d7_queue_summary", """
    SELECT *, status = 'ready' AS mergeable FROM (
      SELECT *, CASE WHEN files < 2 THEN 'need_more' WHEN failed > 0 THEN 'has_failed' WHEN bytes > 17179869184 THEN 'too_large'
             WHEN pending > 0 THEN 'pending' ELSE 'ready' END AS status FROM (
        SELECT q.queue_id, count(*) AS files, count(*) FILTER (i.reason = '') AS ready, count(*) FILTER (i.reason <> '') AS failed,
               count(*) FILTER (i.reason IS NULL) AS pending, coalesce(sum(i.pages) FILTER (i.reason = ''), 0) AS pages,
               sum(coalesce(q.size_bytes, 0)) AS bytes
        FROM queue_file q LEFT JOIN inspected i USING (path) GROUP BY q.queue_id))""", ("queue_file", "inspected"))
def _(t: Tables):
    return intake.queue_summary(t("queue_file"), t("inspected"))
