"""Projections of the driver tables onto the logical tables, in SQL both engines run.

``{name}`` refers to another projection or a driver table. ``ARRAY_OF(...)`` is the only
construct spelled differently by the two engines. No projection filters rows away.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

PAGE_OF = "CAST(l_orderkey % 40 AS INT)"
BOX_NO = "l_orderkey * 8 + l_linenumber"
KIND = "CASE WHEN l_returnflag = 'R' THEN 'figure' ELSE 'image' END"
ASSET_KEY = (
    f"concat({KIND}, ':', CAST(l_linenumber - 1 AS STRING), ':', CAST(l_partkey AS STRING), ':', "
    "CAST(l_suppkey AS STRING), ':', CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING))"
)

PROJECTIONS = {
    # Assets and budgets ---------------------------------------------------------
    "asset": f"""
        SELECT l_orderkey AS doc_id, {ASSET_KEY} AS key, {KIND} AS kind,
               CAST(l_linenumber - 1 AS INT) AS page_no, l_partkey AS xref,
               CAST(l_quantity AS INT) * 16 AS width, CAST(l_quantity AS INT) * 10 AS height,
               CAST(floor(l_extendedprice) AS BIGINT) AS storage_bytes,
               l_partkey * 8 + l_linenumber AS asset_ord
        FROM {{lineitem}}""",
    "target": """
        SELECT doc_id, sum(storage_bytes) + 10000 AS original_bytes,
               CAST(sum(storage_bytes) + 10000 - floor(sum(storage_bytes) / 20) AS BIGINT) AS lossless_bytes,
               CAST(10000 AS BIGINT) AS overhead_bytes,
               CAST(floor((sum(storage_bytes) + 10000) * (CASE WHEN doc_id % 11 = 0 THEN 1.01 WHEN doc_id % 7 = 0 THEN 0.97
                    WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0.6 END)) AS BIGINT) AS target_bytes
        FROM {asset} GROUP BY doc_id""",
    "budget": """
        SELECT doc_id, target_bytes, original_bytes AS size_bytes, original_bytes - overhead_bytes AS stream_bytes
        FROM {target}""",
    "candidate": """
        SELECT l_orderkey AS doc_id, CASE WHEN l_linestatus = 'O' THEN 'images' ELSE 'combined' END AS stage,
               CAST(l_partkey % 400 AS INT) AS score, CAST(floor(l_extendedprice) AS BIGINT) * 3 AS size_bytes,
               CAST(l_suppkey % 3 AS INT) AS images, CAST(0 AS INT) AS vectors,
               CASE WHEN l_linestatus = 'O' THEN 0 ELSE CAST(l_linenumber % 3 AS INT) END AS figures
        FROM {lineitem}""",
    "selection": """
        SELECT DISTINCT doc_id, key FROM {asset} WHERE storage_bytes > 20000""",
    # Page objects ---------------------------------------------------------------
    "doc_page": f"""
        SELECT l_suppkey AS doc_id, {PAGE_OF} AS page_no, CAST(0 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0,
               CAST(612 AS DOUBLE) AS x1, CAST(792 AS DOUBLE) AS y1, count(*) * 30 AS text_chars
        FROM {{lineitem}} GROUP BY l_suppkey, {PAGE_OF}""",
    "text_line": f"""
        SELECT doc_id, page_no, line_no, text, x0, y0, x0 + wide AS x1, y0 + 12 AS y1 FROM (
          SELECT l_suppkey AS doc_id, {PAGE_OF} AS page_no, {BOX_NO} AS line_no,
                 CASE WHEN l_partkey % 240 IN (3, 123) THEN '3.1 Results and discussion'
                      WHEN l_partkey % 240 = 63 THEN 'experimental results '
                      WHEN l_partkey % 240 IN (5, 125) THEN 'Conclusion'
                      WHEN l_partkey % 240 = 65 THEN '7 References'
                      WHEN l_partkey % 24 = 0 THEN concat('Figure ', CAST(l_linenumber AS STRING), ': plot')
                      WHEN l_partkey % 24 = 1 THEN concat('  Fig. ', CAST(l_linenumber AS STRING), 'a - curve')
                      WHEN l_partkey % 24 = 2 THEN concat('图 ', CAST(l_linenumber AS STRING), '：曲线')
                      WHEN l_partkey % 24 = 7 THEN concat('Figure ', CAST(l_linenumber AS STRING), ' shows results')
                      ELSE 'plain text line' END AS text,
                 CAST(CASE l_suppkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 330 ELSE 100 END + (l_partkey % 7) AS DOUBLE) AS x0,
                 CAST(CASE WHEN l_partkey % 5 = 0 THEN 400 ELSE 200 END AS DOUBLE) AS wide,
                 CAST(100 + (l_orderkey * 11 + l_linenumber * 5) % 640 AS DOUBLE) AS y0
          FROM {{lineitem}}) AS t""",
    "drawing": f"""
        SELECT doc_id, page_no, draw_no, x0, y0, x0 + w AS x1, y0 + w / 2 AS y1, item_arity FROM (
          SELECT l_suppkey AS doc_id, {PAGE_OF} AS page_no, {BOX_NO} AS draw_no,
                 CAST((l_partkey * 7) % 560 AS DOUBLE) AS x0,
                 CAST((l_orderkey * 7 + l_linenumber * 31) % 720 AS DOUBLE) AS y0, l_quantity AS w,
                 ARRAY_OF(2, CAST(l_linenumber AS INT), 5) AS item_arity
          FROM {{lineitem}}) AS t""",
    "image_placement": f"""
        SELECT doc_id, page_no, placement_no, xref, smask, width, height, x0, y0, x0 + w * 2 AS x1, y0 + w AS y1 FROM (
          SELECT l_suppkey AS doc_id, {PAGE_OF} AS page_no, {BOX_NO} AS placement_no,
                 CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE l_partkey END AS xref,
                 CASE WHEN l_partkey % 5 = 0 THEN l_partkey + 1000000000000 ELSE 0 END AS smask,
                 CAST(l_quantity AS INT) * 16 AS width, CAST(l_quantity AS INT) * 10 AS height,
                 CAST((l_partkey * 13) % 520 AS DOUBLE) AS x0,
                 CAST((l_orderkey * 29 + l_linenumber * 17) % 680 AS DOUBLE) AS y0, l_quantity AS w
          FROM {{lineitem}}) AS t""",
    "page_stream": """
        SELECT doc_id, page_no, 2000000000000 + page_no AS xref, 'contents' AS role FROM {doc_page}
        UNION ALL SELECT doc_id, page_no, 3000000000000 + page_no % 7 AS xref, 'form' AS role FROM {doc_page}
        UNION ALL SELECT doc_id, page_no, 3000000000000 + page_no % 7 AS xref, 'form' AS role FROM {doc_page}""",
    "stream_size": """
        SELECT l_suppkey AS doc_id, l_partkey AS xref, CAST(max(floor(l_extendedprice)) AS BIGINT) AS bytes
        FROM {lineitem} GROUP BY l_suppkey, l_partkey
        UNION ALL
        SELECT l_suppkey AS doc_id, l_partkey + 1000000000000 AS xref, CAST(max(floor(l_extendedprice / 10)) AS BIGINT) AS bytes
        FROM {lineitem} WHERE l_partkey % 3 <> 0 GROUP BY l_suppkey, l_partkey
        UNION ALL
        SELECT doc_id, xref, CAST(max(page_no * 100 + 5000) AS BIGINT) AS bytes FROM {page_stream} GROUP BY doc_id, xref""",
    "page_region": f"""
        SELECT doc_id, page_no, region_no, kind, x0, y0, x0 + w * 3 AS x1, y0 + w * 4 AS y1 FROM (
          SELECT l_suppkey AS doc_id, {PAGE_OF} AS page_no, ({BOX_NO}) * 1000003 + l_partkey AS region_no, {KIND} AS kind,
                 CAST((l_partkey * 3) % 450 AS DOUBLE) AS x0,
                 CAST((l_orderkey * 5 + l_linenumber * 41) % 580 AS DOUBLE) AS y0, l_quantity AS w
          FROM {{lineitem}}) AS t""",
    # Composition ----------------------------------------------------------------
    "source_file": """
        SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(1 + n_nationkey % 3 AS INT) AS pages,
               CASE WHEN n_nationkey = 5 THEN 'password' ELSE '' END AS reason,
               CAST(n_nationkey + 1 AS BIGINT) * 2000000000 AS size_bytes
        FROM {nation}""",
    "page_ref": """
        SELECT o_custkey AS plan_id, o_orderkey AS pos, o_custkey % 3 + 3 * (o_orderkey % 2) AS source,
               CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE o_orderkey % (1 + o_custkey % 3) END AS page_index
        FROM {orders}""",
    "compose_ref": """
        SELECT o_custkey AS plan_id, o_orderkey AS pos, CAST(floor(o_custkey / 15) AS BIGINT) AS source,
               o_orderkey % 40 AS page_index
        FROM {orders}""",
    "link": f"""
        SELECT l_suppkey AS doc_id, l_orderkey % 40 AS page_no, {BOX_NO} AS link_no,
               CASE l_linenumber % 3 WHEN 0 THEN 'goto' WHEN 1 THEN 'uri' ELSE 'named' END AS kind,
               CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_orderkey % 700 AS DOUBLE) AS y0,
               CAST(l_partkey % 500 + 40 AS DOUBLE) AS x1, CAST(l_orderkey % 700 + 12 AS DOUBLE) AS y1,
               l_partkey % 60 AS target_page, CAST(l_partkey % 300 AS DOUBLE) AS target_x, CAST(l_orderkey % 800 AS DOUBLE) AS target_y,
               CASE WHEN l_linenumber % 3 = 1 THEN concat('https://example.com/', CAST(l_partkey AS STRING)) END AS uri
        FROM {{lineitem}}""",
    "toc": f"""
        SELECT l_suppkey AS doc_id, {BOX_NO} AS pos, CAST(l_linenumber AS INT) AS level,
               concat('Section ', CAST(l_partkey AS STRING)) AS title, l_orderkey % 41 AS page_no,
               CAST(l_partkey % 200 AS DOUBLE) AS dest_x, CAST(l_orderkey % 800 AS DOUBLE) AS dest_y
        FROM {{lineitem}}""",
    "merge_input": """
        SELECT CAST(s_nationkey AS BIGINT) AS merge_id, s_suppkey AS pos, s_suppkey AS doc_id,
               CAST(40 AS BIGINT) AS pages, CAST(floor(abs(s_acctbal)) AS BIGINT) AS size_bytes
        FROM {supplier}""",
    "merge_row": """
        SELECT o_custkey AS merge_id, o_orderkey AS pos, o_orderkey % 5 AS doc_id, 1 + o_orderkey % 5 AS pages,
               (o_orderkey % 5) * 1000 + 500 AS size_bytes
        FROM {orders}""",
    "plan_node": """
        SELECT CAST(r_regionkey AS BIGINT) AS plan_id, concat('r', CAST(r_regionkey AS STRING)) AS uid,
               CAST(NULL AS STRING) AS parent_uid, CAST(r_regionkey AS BIGINT) AS ord, r_name AS title,
               CAST(NULL AS STRING) AS source, CAST(NULL AS BIGINT) AS page_index
        FROM {region}
        UNION ALL
        SELECT n_regionkey, concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)),
               CAST(n_nationkey AS BIGINT), CASE WHEN n_nationkey % 4 = 0 THEN '  ' ELSE n_name END, NULL, NULL
        FROM {nation}
        UNION ALL
        SELECT n_regionkey, concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)),
               c_custkey, c_name, NULL, NULL
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION ALL
        SELECT n_regionkey, concat('o', CAST(o_orderkey AS STRING)), concat('c', CAST(c_custkey AS STRING)),
               o_orderkey, NULL, o_orderstatus, o_orderkey
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "tree_selection": """
        SELECT plan_id, uid FROM {plan_node}
        WHERE uid LIKE 'n%4' OR uid LIKE 'c%7' OR uid LIKE 'o%3'""",
    # Intake ---------------------------------------------------------------------
    "doc_file": """
        SELECT doc_id, concat('/corpus/', source, '/doc', CAST(doc_id AS STRING),
                              CASE WHEN doc_id % 17 = 0 THEN '.txt' ELSE '.PDF' END) AS path,
               CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN 5000000000 ELSE n_chars END AS size_bytes,
               doc_id * 1000 AS modified_ns, n_chars % 50 AS pages, n_chars % 3 = 0 AS has_forms,
               doc_id % 13 = 0 AS needs_pass, lang <> 'zz' AS is_pdf, n_chars AS size_after,
               CASE WHEN doc_id % 29 = 0 THEN 1 ELSE doc_id * 1000 END AS modified_after
        FROM {documents}""",
    "incoming": """
        SELECT user_id AS queue_id, event_id AS ord,
               concat(CASE WHEN event_id % 2 = 0 THEN '/In/Doc' ELSE '/in/doc' END, CAST(CAST(floor(value / 2) AS BIGINT) AS STRING), '.pdf') AS path,
               event_type <> 'error' AS is_valid
        FROM {events}""",
    "queue": """
        SELECT user_id AS queue_id, concat('/IN/doc', CAST(max(event_id) % 40 AS STRING), '.pdf') AS path
        FROM {events} GROUP BY user_id, event_type""",
    "queue_file": """
        SELECT doc_id % 37 AS queue_id, path, size_bytes FROM {doc_file}""",
    "inspected": """
        SELECT d.path, d.pages, CASE WHEN d.needs_pass THEN 'password' ELSE '' END AS reason
        FROM {doc_file} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id""",
    "render_task": f"""
        SELECT l_orderkey AS batch_id, CAST(l_linenumber AS INT) AS id, CAST(l_linenumber - 1 AS INT) AS page_no,
               CAST(0 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, l_quantity * 20 - 20 AS x1, l_quantity * 30 AS y1,
               CAST(24 + l_partkey % 1300 AS INT) AS dpi, CAST(30 + l_suppkey % 75 AS INT) AS quality,
               CAST(l_partkey % 3 AS INT) AS group_id
        FROM {{lineitem}}""",
    "produced": """
        SELECT batch_id, count(*) AS completed, count(*) AS variants, count(DISTINCT dpi % 3) AS masters
        FROM {render_task} GROUP BY batch_id""",
    "export_file": f"""
        SELECT l_orderkey AS doc_id, {ASSET_KEY} AS key, {KIND} AS kind,
               CASE l_partkey % 3 WHEN 0 THEN 'svg' WHEN 1 THEN 'png' ELSE 'pdf' END AS format,
               concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '.bin') AS name,
               CASE WHEN l_partkey % 101 = 0 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS bytes
        FROM {{lineitem}}""",
    # Time series ----------------------------------------------------------------
    "job_event": """
        SELECT user_id AS job_id, event_id AS seq, ts, CAST(event_id % 4 AS INT) AS generation,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled'
                    WHEN 'view' THEN 'cancel_requested' ELSE 'progress' END AS kind,
               CAST(floor(value) AS INT) AS progress
        FROM {events}""",
    "bench_run": """
        SELECT event_type AS case_name, CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'current' END AS label,
               event_id AS run_no, value AS seconds, CASE WHEN event_type = 'click' THEN 'same' ELSE props END AS comparable,
               CAST(floor(value) AS BIGINT) AS bytes, CASE WHEN event_type = 'view' THEN 100000 ELSE 50 END AS target_bytes,
               CASE WHEN event_type = 'signup' THEN user_id END AS link_count, CAST(800 AS BIGINT) AS expected_links,
               event_type <> 'error' AS text_preserved
        FROM {events}""",
}


def _references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a projection of it as a DataFrame."""
    if name in DRIVER_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = PROJECTIONS[name].replace("ARRAY_OF(", "array(")
    return spark.sql(sql, **{ref: frame(spark, sf_dir, ref) for ref in _references(sql)})


def sql_views(*names: str) -> str:
    """Common table expressions of the projections, for the SQL check."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in DRIVER_TABLES or name in done:
            return
        sql = PROJECTIONS[name].replace("ARRAY_OF(", "list_value(")
        for ref in _references(sql):
            add(ref)
        done[name] = re.sub(r"\{(\w+)\}", r"\1", sql)

    for name in names:
        add(name)
    return ",\n".join(f"{name} AS ({sql})" for name, sql in done.items())
