"""Queries for composition trees, merging, links and queue order."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import compose, tree
from quirework.plans import flows
from quirework.plans.registry import Tables, query


@query("c8_remap_links", """
    WITH first_use AS (SELECT plan_id, source, page_index, min(pos) AS mapped FROM compose_ref GROUP BY ALL)
    SELECT r.plan_id, r.pos AS output_page, l.link_no, l.kind, l.x0, l.y0, l.x1, l.y1, f.mapped AS target_page,
           CASE WHEN l.kind = 'goto' THEN l.target_x END AS target_x, CASE WHEN l.kind = 'goto' THEN l.target_y END AS target_y, l.uri
    FROM compose_ref r JOIN link l ON l.doc_id = r.source AND l.page_no = r.page_index AND l.kind <> 'named'
    LEFT JOIN first_use f ON l.kind = 'goto' AND f.plan_id = r.plan_id AND f.source = r.source AND f.page_index = l.target_page
    WHERE l.kind <> 'goto' OR f.mapped IS NOT NULL""", ("compose_ref", "link"))
def _(t: Tables):
    return compose.remap_links(t("compose_ref"), t("link"))


OFFSETS = """
offsets AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY merge_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_offset
            FROM merge_input)"""


@query("e2_page_offsets", "SELECT merge_id, pos, page_offset FROM offsets", ("merge_input",), OFFSETS)
def _(t: Tables):
    return compose.page_offsets(t("merge_input")).select("merge_id", "pos", "page_offset")


@query("c9_offset_bookmarks", """
    SELECT merge_id, o.pos, t.pos AS toc_pos, level, title, CASE WHEN page_no > 0 THEN page_no + page_offset ELSE page_no END AS page_no, dest_x, dest_y
    FROM offsets o JOIN toc t USING (doc_id)""", ("merge_input", "toc"), OFFSETS)
def _(t: Tables):
    return flows.merge_documents(t("merge_input"), t("toc"), t("link"))["bookmarks"]


@query("c9_offset_links", """
    SELECT merge_id, o.pos, link_no, kind, page_no + page_offset AS page_no, x0, y0, x1, y1, CASE WHEN kind = 'goto' THEN target_page + page_offset END AS target_page,
           CASE WHEN kind = 'goto' THEN target_x END AS target_x, CASE WHEN kind = 'goto' THEN target_y END AS target_y, uri
    FROM offsets o JOIN link l USING (doc_id) WHERE kind = 'uri' OR (kind = 'goto' AND target_page BETWEEN 0 AND pages - 1)""",
    ("merge_input", "link"), OFFSETS)
def _(t: Tables):
    return flows.merge_documents(t("merge_input"), t("toc"), t("link"))["links"]


@query("d9_merge_summary", """
    SELECT merge_id, count(*) AS sources, sum(pages) AS pages, sum(size_bytes) AS input_bytes FROM merge_row GROUP BY merge_id""", ("merge_row",))
def _(t: Tables):
    return compose.merge_summary(t("merge_row"), distinct_sources=False)


@query("d9_compose_summary", """
    SELECT merge_id, count(*) AS sources, sum(pages) AS pages, sum(size_bytes) AS input_bytes
    FROM (SELECT DISTINCT merge_id, doc_id, pages, size_bytes FROM merge_row) GROUP BY merge_id""", ("merge_row",))
def _(t: Tables):
    return compose.merge_summary(t("merge_row"), distinct_sources=True)


INVALID = """
checked AS (SELECT r.*, CASE WHEN f.doc_id IS NULL THEN 'unknown_source' WHEN f.reason <> '' THEN 'source_error'
              WHEN page_index < 0 OR page_index >= f.pages THEN 'no_such_page' END AS ref_reason, f.size_bytes
            FROM page_ref r LEFT JOIN source_file f ON f.doc_id = r.source)"""


@query("c11_invalid_refs", "SELECT plan_id, pos, source, page_index, ref_reason FROM checked WHERE ref_reason IS NOT NULL",
       ("page_ref", "source_file"), INVALID)
def _(t: Tables):
    return compose.invalid_refs(t("page_ref"), t("source_file")).select("plan_id", "pos", "source", "page_index", "ref_reason")


@query("d8_composition_summary", """
    WITH p AS (SELECT plan_id, count(*) AS pages, count(ref_reason) AS invalid FROM checked GROUP BY 1),
    s AS (SELECT plan_id, count(*) AS sources, coalesce(sum(size_bytes), 0) AS used_bytes FROM (SELECT DISTINCT plan_id, source, size_bytes FROM checked) GROUP BY 1)
    SELECT plan_id, pages, sources, used_bytes, invalid, invalid = 0 AND used_bytes <= 17179869184 AS saveable FROM p JOIN s USING (plan_id)""",
    ("page_ref", "source_file"), INVALID)
def _(t: Tables):
    return compose.composition_summary(t("page_ref"), t("source_file"))


@query("e3_page_runs", """
    WITH l AS (SELECT *, lag(source) OVER w AS ps, lag(page_index) OVER w AS pp FROM page_ref WINDOW w AS (PARTITION BY plan_id ORDER BY pos)),
    r AS (SELECT *, sum(CASE WHEN ps = source AND pp + 1 = page_index THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY pos) AS run_no FROM l)
    SELECT plan_id, run_no, min(pos) AS first_pos, min(source) AS source, min(page_index) AS first_index, count(*) AS length FROM r GROUP BY plan_id, run_no""",
    ("page_ref",))
def _(t: Tables):
    return compose.page_runs(t("page_ref"))


@query("e4_whole_documents", """
    WITH l AS (SELECT r.*, f.pages, lag(source) OVER w AS ps, lag(page_index) OVER w AS pp, lead(pos) OVER w AS nxt, lead(page_index) OVER w AS np
               FROM page_ref r LEFT JOIN source_file f ON f.doc_id = r.source WINDOW w AS (PARTITION BY plan_id ORDER BY pos)),
    d AS (SELECT *, sum(CASE WHEN page_index = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY pos) AS doc_no FROM l),
    g AS (SELECT plan_id, doc_no, min(page_index) = 0 AND bool_and(page_index = 0 OR (ps = source AND pp + 1 = page_index))
                 AND count(*) = max(pages) AND min(source) = max(source) AS complete FROM d GROUP BY ALL)
    SELECT plan_id, count(*) FILTER (doc_no > 0) AS documents, coalesce(bool_and(coalesce(complete, false)), false) AS whole,
           coalesce(bool_and(coalesce(complete, false)), false) AND count(*) FILTER (doc_no > 0) BETWEEN 2 AND 100 AS mergeable FROM g GROUP BY plan_id""",
    ("page_ref", "source_file"))
def _(t: Tables):
    return compose.whole_documents(t("page_ref"), t("source_file"))


@query("g2_ordered_distinct", "SELECT plan_id, source, min(pos) AS pos FROM page_ref GROUP BY ALL", ("page_ref",))
def _(t: Tables):
    return compose.ordered_distinct(t("page_ref"), ["plan_id", "source"], "pos")


def _reorder_sql(direction: int) -> str:
    order = "o_orderkey" if direction == -1 else "-o_orderkey"
    moved = f"""
    WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS sel, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) - 1 AS pos,
                      count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    u AS (SELECT *, lead(pos) OVER (PARTITION BY o_custkey ORDER BY pos) AS nxt FROM p WHERE NOT sel),
    f AS (SELECT o_custkey, min(pos) AS first_free FROM u GROUP BY 1),
    m AS (SELECT o_custkey, o_orderkey, n, coalesce(nxt, n) - 1 AS place FROM u
          UNION ALL SELECT p.o_custkey, o_orderkey, n, CASE WHEN pos > first_free THEN pos - 1 ELSE pos END FROM p LEFT JOIN f USING (o_custkey) WHERE sel)"""
    return moved + f" SELECT o_custkey, o_orderkey, {'place' if direction == -1 else 'n - 1 - place'} AS new_pos FROM m"


def _reorder(t: Tables, direction: int):
    rows = t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("sel"))
    return compose.reorder_block(rows, ["o_custkey"], "o_orderkey", "sel", direction).drop("sel")


@query("e9_reorder_up", _reorder_sql(-1))
def _(t: Tables):
    return _reorder(t, -1)


@query("e9_reorder_down", _reorder_sql(1))
def _(t: Tables):
    return _reorder(t, 1)


# The checking engine sees the tree of the test data as its three joins.
LEAVES = """
leaf AS (SELECT n_regionkey AS plan_id, n_nationkey, c_custkey, o_orderkey, o_orderstatus,
           row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey, o_orderkey) - 1 AS pos
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
PICKED = LEAVES + """,
node AS (SELECT plan_id, uid, parent_uid, ord, title, source, page_index FROM plan_node),
anc AS (SELECT n.plan_id, n.uid, p1.uid AS a1, p2.uid AS a2 FROM node n
        LEFT JOIN node p1 ON p1.plan_id = n.plan_id AND p1.uid = n.parent_uid LEFT JOIN node p2 ON p2.plan_id = n.plan_id AND p2.uid = p1.parent_uid),
s AS (SELECT * FROM tree_selection),
top AS (SELECT a.plan_id, a.uid FROM anc a SEMI JOIN s ON s.plan_id = a.plan_id AND s.uid = a.uid
        WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.plan_id = a.plan_id AND x.uid = a.a1) AND NOT EXISTS (SELECT 1 FROM s x WHERE x.plan_id = a.plan_id AND x.uid = a.a2))"""
TREE = ("plan_node", "tree_selection")


@query("i4_flatten_tree", """
    SELECT plan_id, pos, concat('o', o_orderkey) AS uid, 3 AS depth, o_orderstatus AS source, o_orderkey AS page_index FROM leaf""",
    ("plan_node",), LEAVES)
def _(t: Tables):
    return tree.flatten_tree(t("plan_node"))


@query("i5_tree_bookmarks", """
    SELECT plan_id, concat('n', n_nationkey) AS uid, 1 AS level, CASE WHEN n_nationkey % 4 = 0 THEN '分组' ELSE n_name END AS title, min(pos) + 1 AS page_no
    FROM leaf JOIN nation USING (n_nationkey) GROUP BY ALL
    UNION ALL SELECT plan_id, concat('c', c_custkey), 2, c_name, min(pos) + 1 FROM leaf JOIN customer USING (c_custkey) GROUP BY ALL""",
    ("plan_node",), LEAVES)
def _(t: Tables):
    return tree.tree_bookmarks(t("plan_node"))


@query("i6_validate_tree", """
    SELECT plan_id, count(*) + CASE plan_id WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 14 ELSE 0 END AS nodes,
           count(page_index) + CASE plan_id WHEN 1 THEN 1 ELSE 0 END AS pages,
           CASE plan_id WHEN 4 THEN 14 ELSE max(CASE WHEN uid LIKE 'o%' THEN 3 WHEN uid LIKE 'c%' THEN 2 WHEN uid LIKE 'n%' THEN 1 ELSE 0 END) END AS depth,
           CASE plan_id WHEN 1 THEN 'duplicate_uid' WHEN 2 THEN 'page_with_children' WHEN 3 THEN 'cycle_or_orphan' WHEN 4 THEN 'too_deep'
                ELSE CASE WHEN count(page_index) > 200 THEN 'too_many_pages' ELSE '' END END AS reason FROM plan_node GROUP BY plan_id""", ("plan_node",))
def _(t: Tables):
    nodes = t("plan_node")
    rest = ("parent_uid", "ord", "title", "source", "page_index")
    leaf = nodes.where("page_index IS NOT NULL").groupBy("plan_id").agg(F.min(F.struct("uid", *rest)).alias("n")).select("plan_id", "n.*")

    def group(of, uid, parent):
        return of.select("plan_id", uid.alias("uid"), parent.alias("parent_uid"), *(nodes_of(c) for c in rest[1:]))

    def nodes_of(column):
        return F.lit(None).cast(nodes.schema[column].dataType).alias(column)

    # Each plan breaks another rule: a repeated page, a group below a page, a cycle, a long chain.
    nested = group(leaf.where("plan_id = 2"), F.lit("below"), F.col("uid"))
    circle = leaf.where("plan_id = 3").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    circle = group(circle, F.concat(F.lit("turn"), F.col("i")), F.concat(F.lit("turn"), 1 - F.col("i")))
    chain = nodes.where("plan_id = 4 AND parent_uid IS NULL").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(14))))
    chain = group(chain, F.concat(F.lit("deep"), F.col("i")), F.when(F.col("i") == 1, F.col("uid")).otherwise(F.concat(F.lit("deep"), F.col("i") - 1)))
    broken = nodes
    for more in (leaf.where("plan_id = 1"), nested, circle, chain):
        broken = broken.unionByName(more)
    return tree.validate_tree(broken, max_pages=200)


@query("i7_top_selected", "SELECT * FROM top", TREE, PICKED)
def _(t: Tables):
    return tree.top_selected(t("plan_node"), t("tree_selection")).select("plan_id", "uid")


@query("i8_remove_subtrees", """
    SELECT plan_id, uid FROM anc a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.plan_id = a.plan_id AND s.uid IN (a.uid, a.a1, a.a2))""", TREE, PICKED)
def _(t: Tables):
    return tree.remove_subtrees(t("plan_node"), t("tree_selection")).select("plan_id", "uid")


@query("i9_move_subtrees", """
    WITH node_no AS (SELECT plan_id, uid, row_number() OVER (PARTITION BY plan_id ORDER BY n, c NULLS FIRST, o NULLS FIRST) AS pre FROM (
        SELECT DISTINCT plan_id, concat('n', n_nationkey) AS uid, n_nationkey AS n, NULL AS c, NULL AS o FROM leaf
        UNION ALL SELECT n_regionkey, concat('c', c_custkey), n_nationkey, c_custkey, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT plan_id, concat('o', o_orderkey), n_nationkey, c_custkey, o_orderkey FROM leaf)),
    moved AS (SELECT top.plan_id, uid, row_number() OVER (PARTITION BY top.plan_id ORDER BY pre) - 1 AS r FROM top JOIN node_no USING (plan_id, uid)),
    kept AS (SELECT n.plan_id, n.uid, row_number() OVER (PARTITION BY n.plan_id ORDER BY n.ord) - 1 AS r,
                    count(*) FILTER (old < 2) OVER (PARTITION BY n.plan_id) AS cut
             FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY ord) - 1 AS old FROM node WHERE parent_uid LIKE 'r%') n
             ANTI JOIN moved m ON m.plan_id = n.plan_id AND m.uid = n.uid),
    sizes AS (SELECT plan_id, count(*) AS moved_n FROM moved GROUP BY 1),
    cuts AS (SELECT plan_id, max(cut) AS cut FROM kept GROUP BY 1)
    SELECT n.plan_id, n.uid, CASE WHEN m.uid IS NOT NULL THEN concat('r', n.plan_id) ELSE n.parent_uid END AS parent_uid,
           CASE WHEN m.uid IS NOT NULL THEN coalesce(c.cut, 0) + m.r WHEN k.uid IS NOT NULL THEN k.r + CASE WHEN k.r >= k.cut THEN z.moved_n ELSE 0 END ELSE n.ord END AS ord,
           '' AS reason
    FROM node n LEFT JOIN moved m ON m.plan_id = n.plan_id AND m.uid = n.uid LEFT JOIN kept k ON k.plan_id = n.plan_id AND k.uid = n.uid
    LEFT JOIN sizes z ON z.plan_id = n.plan_id LEFT JOIN cuts c ON c.plan_id = n.plan_id""", TREE, PICKED)
def _(t: Tables):
    moves = t("plan_node").where("parent_uid IS NULL").select(
        "plan_id", F.col("uid").alias("parent_uid"), F.lit(2).alias("index")
    )
    return tree.move_subtrees(t("plan_node"), moves, t("tree_selection")).select("plan_id", "uid", "parent_uid", "ord", "reason")
