import itertools
import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import compose, tree
from quirework.plans import flows
from quirework.schemas import TABLES


def swap_model(n, chosen, direction):
    """Neighbour swaps, one selected row after the other."""
    rows = list(range(n))
    for value in sorted(chosen, reverse=direction > 0):
        at = rows.index(value)
        other = at + direction
        if 0 <= other < n and rows[other] not in chosen:
            rows[at], rows[other] = rows[other], rows[at]
    return rows


@pytest.mark.parametrize("direction", [-1, 1])
def test_reorder_every_subset(spark, direction):
    n, rows = 6, []
    subsets = [s for k in range(n + 1) for s in itertools.combinations(range(n), k)]
    for key, subset in enumerate(subsets):
        rows += [(key, i * 3, i in subset) for i in range(n)]
    df = spark.createDataFrame(rows, "key int, ord int, sel boolean")
    got = {}
    for r in compose.reorder_block(df, ["key"], "ord", "sel", direction).orderBy("key", "new_pos").collect():
        got.setdefault(r.key, []).append(r.ord // 3)
    assert got == {k: swap_model(n, s, direction) for k, s in enumerate(subsets)}


REFS = "plan_id long, pos int, source long, page_index long"


def test_links_of_composed_pages(spark):
    refs = spark.createDataFrame([(1, 0, 7, 1), (1, 1, 7, 0), (1, 2, 7, 1), (1, 3, 8, 0)], REFS)
    link = spark.createDataFrame([
        (7, 0, 0, "goto", 3.0, 4.0, 11.0, 12.0, 1, 7.0, 8.0, None), (7, 0, 1, "goto", 3.0, 4.0, 11.0, 12.0, 5, 7.0, 8.0, None),
        (7, 1, 0, "uri", 0.0, 0.0, 1.0, 1.0, None, None, None, "u"), (8, 0, 0, "named", 0.0, 0.0, 1.0, 1.0, None, None, None, None), (9, 0, 0, "uri", 0.0, 0.0, 1.0, 1.0, None, None, None, "x")], TABLES["link"])
    got = sorted((r.output_page, r.kind, r.target_page, r.uri) for r in compose.remap_links(refs, link).collect())
    assert got == [(0, "uri", None, "u"), (1, "goto", 0, None), (2, "uri", None, "u")]


def test_merge_offsets_and_totals(spark):
    merge = spark.createDataFrame([(1, 0, 5, 3, 100), (1, 1, 6, 2, 50), (1, 2, 5, 3, 100)], TABLES["merge_input"])
    toc = spark.createDataFrame([(5, 0, 1, "A", 2, 30.0, 40.0), (6, 0, 1, "B", 0, None, None)], TABLES["toc"])
    link = spark.createDataFrame([
        (5, 0, 0, "goto", 3.0, 4.0, 11.0, 12.0, 2, 7.0, 8.0, None), (5, 0, 1, "goto", 3.0, 4.0, 11.0, 12.0, 3, 7.0, 8.0, None), (6, 1, 0, "uri", 0.0, 0.0, 1.0, 1.0, None, None, None, "u")], TABLES["link"])
    marks, links = compose.offset_navigation(merge, toc, link)
    assert sorted((r.pos, r.title, r.page_no) for r in marks.collect()) == [(0, "A", 2), (1, "B", 0), (2, "A", 7)]
    assert sorted((r.pos, r.page_no, r.target_page) for r in links.collect() if r.kind == "goto") == [(0, 0, 2), (2, 5, 7)]
    assert [r.page_no for r in links.collect() if r.kind == "uri"] == [4]
    assert {(r.x0, r.y0, r.x1, r.y1, r.target_x, r.target_y) for r in links.collect()} == {(3.0, 4.0, 11.0, 12.0, 7.0, 8.0), (0.0, 0.0, 1.0, 1.0, None, None)}
    assert sorted({(r.title, r.dest_x, r.dest_y) for r in marks.collect()}) == [("A", 30.0, 40.0), ("B", None, None)]
    assert compose.merge_summary(merge, False).head()[1:] == (3, 8, 250)
    assert compose.merge_summary(merge, True).head()[1:] == (2, 5, 150)


PREFLIGHT = [(1, 2, "", 10), (2, 1, "", 20), (3, 4, "password", 30)]


def test_runs_and_whole_documents(spark):
    pre = spark.createDataFrame(PREFLIGHT, "doc_id long, pages int, reason string, size_bytes long")
    plans = {
        1: [(1, 0), (1, 1), (2, 0)], 2: [(1, 0), (1, 1)], 3: [(1, 1), (1, 0)], 4: [(1, 0), (2, 0)],
        5: [(2, 0), (2, 0), (2, 0)], 6: [(1, 0), (1, 1), (1, 2)], 7: [(9, 0)], 8: [(1, 0), (1, 1), (1, 0)]}
    refs = spark.createDataFrame([(p, i, s, x) for p, pages in plans.items() for i, (s, x) in enumerate(pages)], REFS)
    whole = {r.plan_id: (r.whole, r.mergeable) for r in compose.whole_documents(refs, pre).collect()}
    assert whole == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (True, True),
                     6: (False, False), 7: (False, False), 8: (False, False)}
    runs = [(r.plan_id, r.first_pos, r.first_index, r.length) for r in compose.page_runs(refs).orderBy("plan_id", "run_no").collect()]
    assert runs[:5] == [(1, 0, 0, 2), (1, 2, 0, 1), (2, 0, 0, 2), (3, 0, 1, 1), (3, 1, 0, 1)]
    bad = {(r.plan_id, r.pos): r.ref_reason for r in compose.invalid_refs(refs, pre).collect()}
    assert bad == {(6, 2): "no_such_page", (7, 0): "unknown_source"}
    summary = {r.plan_id: r for r in compose.composition_summary(refs, pre).collect()}
    assert (summary[1].pages, summary[1].sources, summary[1].used_bytes, summary[1].saveable) == (3, 2, 30, True)
    assert (summary[6].invalid, summary[6].saveable) == (1, False)


# Trees: a nested list model, (uid, children) for groups and a page index for pages.

def nodes(spark, tree_, plan=1, extra=()):
    rows = []

    def visit(node, parent, ord_):
        uid, body = node
        page = None if isinstance(body, list) else body
        rows.append((plan, uid, parent, ord_, "" if uid == "g0" else f" {uid} ", None if page is None else "s", page))
        for i, child in enumerate(body if isinstance(body, list) else []):
            visit(child, uid, i)

    visit(tree_, None, 0)
    return spark.createDataFrame(rows + list(extra), TABLES["plan_node"])


SAMPLE = ("root", [("g0", [("p0", 2), ("p1", 0), ("g1", [("p2", 1)])]), ("empty", []), ("p3", 4), ("g2", [("g3", [("p4", 5), ("p5", 6)]), ("p6", 7)])])


def listing(df):
    """Pages of a returned adjacency list in depth-first order."""
    kids = {}
    for r in df.collect():
        kids.setdefault(r.parent_uid, []).append((r.ord, r.uid, r.page_index))
    out = []

    def visit(uid):
        for _ord, child, page in sorted(kids.get(uid, [])):
            out.append(child) if page is not None else visit(child)

    visit("root")
    return out


def test_flatten_and_bookmarks(spark):
    df = nodes(spark, SAMPLE)
    flat = tree.flatten_tree(df).orderBy("pos").collect()
    assert [(r.pos, r.uid) for r in flat] == [(i, f"p{i}") for i in range(7)]
    marks = sorted((r.page_no, r.level, r.title) for r in tree.tree_bookmarks(df).collect())
    assert marks == [(1, 1, "分组"), (3, 2, "g1"), (5, 1, "g2"), (5, 2, "g3")]


def test_validation_reports_bad_trees(spark):
    good = nodes(spark, SAMPLE)
    deep = ("root", [])
    level = deep
    for i in range(13):
        level[1].append((f"d{i}", []))
        level = level[1][0]
    frames = [
        good, nodes(spark, deep, 2),
        nodes(spark, ("root", [("a", [])]), 3, [(3, "x", "y", 0, "", None, None), (3, "y", "x", 0, "", None, None)]),
        nodes(spark, ("root", [("a", 1)]), 4, [(4, "b", "a", 0, "", "s", 3)]),
        nodes(spark, ("root", [("a", 1), ("a", 2)]), 5),
        nodes(spark, ("root", [(f"q{i}", i) for i in range(9)]), 6),
    ]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    got = {r.plan_id: r.reason for r in tree.validate_tree(df, max_pages=8).collect()}
    assert got == {1: "", 2: "too_deep", 3: "cycle_or_orphan", 4: "page_with_children", 5: "duplicate_uid", 6: "too_many_pages"}


def test_deep_trees_lose_nothing(spark):
    deep = ("root", [])
    level = deep
    for i in range(40):
        level[1].append((f"d{i}", []))
        level = level[1][0]
    level[1].append(("page", 5))
    df = nodes(spark, deep)
    assert [(r.uid, r.pos, r.depth) for r in tree.flatten_tree(df).collect()] == [("page", 0, 41)]
    facts = tree.validate_tree(df).head()
    assert (facts.reason, facts.depth) == ("too_deep", 41)
    assert [r.uid for r in tree.remove_subtrees(df, pick(spark, "d0")).collect()] == ["root"]
    assert [r.uid for r in tree.top_selected(df, pick(spark, "d30", "page", "d39")).collect()] == ["d30"]
    assert tree.tree_bookmarks(df).count() == 40


def test_a_path_of_a_hundred_thousand_levels(spark):
    n = 100_000
    path = spark.range(n).select(
        F.lit(1).cast("long").alias("plan_id"), F.concat(F.lit("d"), "id").alias("uid"), F.when(F.col("id") > 0, F.concat(F.lit("d"), F.col("id") - 1)).alias("parent_uid"),
        F.lit(1).alias("ord"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("page_index"),
    )
    page = spark.createDataFrame([(1, "first", "d5", 0, None, "s", 3), (1, "last", f"d{n - 1}", 9, None, "s", 4)], TABLES["plan_node"])
    df = path.unionByName(page)
    levels = tree.tree_levels(df).checkpoint()
    assert {r.uid: (r.pos, r.depth) for r in tree.flatten_tree(df, levels).collect()} == {"first": (0, 6), "last": (1, n)}
    assert levels.where("rooted").count() == n + 2 and levels.where("uid = 'd5'").head().pages == 2
    kept = tree.remove_subtrees(df, pick(spark, "d70000"))
    assert kept.count() == 70_001


def random_plan(seed):
    """Parents of nodes, with orphans, a cycle and pages in between."""
    rng = random.Random(seed)
    rows, groups = [(1, "root", None, 0, "", None, None)], ["root"]
    for i in range(60):
        name, parent = f"n{i}", rng.choice(groups)
        if i in (20, 40):
            parent = "missing"
        leaf = rng.random() < 0.5
        rows.append((1, name, parent, rng.randint(0, 5), "t", "s" if leaf else None, i if leaf else None))
        if not leaf:
            groups.append(name)
    rows += [(1, "c0", "c1", 0, "", None, None), (1, "c1", "c0", 0, "", None, None), (1, "c2", "c1", 0, "", None, None), (1, "cp", "c2", 0, "", "s", 7)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_against_plain_walks(spark, seed):
    rows = random_plan(seed)
    df = spark.createDataFrame(rows, TABLES["plan_node"])
    parent, kids, page = {r[1]: r[2] for r in rows}, {}, {r[1]: r[6] for r in rows}
    for r in rows:
        kids.setdefault(r[2], []).append((r[3], r[1]))
    order = []

    def walk(uid, depth):
        order.append((uid, depth))
        for _, child in sorted(kids.get(uid, [])):
            walk(child, depth + 1)

    walk("root", 0)
    pages = [(u, d) for u, d in order if page[u] is not None]
    assert [(r.uid, r.depth) for r in tree.flatten_tree(df).orderBy("pos").collect()] == pages
    before = {u: sum(page[v] is not None for v, _ in order[:k]) for k, (u, _) in enumerate(order)}
    below = lambda u: (page[u] is not None) + sum(below(c) for _, c in kids.get(u, []))
    marks = {(u, d, before[u] + 1) for u, d in order if u != "root" and page[u] is None and below(u)}
    assert {(r.uid, r.level, r.page_no) for r in tree.tree_bookmarks(df).collect()} == marks
    levels = {r.uid: r for r in tree.tree_levels(df).collect()}
    assert {u for u, r in levels.items() if r.rooted} == {u for u, _ in order}
    assert all(levels[u].depth == d and levels[u].pages == below(u) for u, d in order)
    rng = random.Random(seed)
    picked = set(rng.sample([r[1] for r in rows], 12)) | {"c1"}

    def above(uid):
        seen = []
        while (uid := parent.get(uid)) is not None and uid not in seen:
            seen.append(uid)
        return set(seen)

    chosen = picked - {"root"}
    tops = {u for u, _ in order if u in chosen and not above(u) & chosen}
    assert {r.uid for r in tree.top_selected(df, pick(spark, *picked)).collect()} == tops
    assert {r.uid for r in tree.remove_subtrees(df, pick(spark, *picked)).collect()} == {u for u in parent if u not in chosen and not above(u) & chosen}


def test_several_roots_are_reported(spark):
    df = nodes(spark, ("root", [("p", 1)]), 1, [(1, "other", None, 1, "", None, None)])
    assert tree.validate_tree(df).head().reason == "several_roots"


def pick(spark, *uids):
    return spark.createDataFrame([(1, u) for u in uids], "plan_id long, uid string")


def test_select_and_remove(spark):
    df = nodes(spark, SAMPLE)
    assert sorted(r.uid for r in tree.top_selected(df, pick(spark, "root", "g0", "p1", "p6", "g1")).collect()) == ["g0", "p6"]
    assert listing(tree.remove_subtrees(df, pick(spark, "root", "g3", "p0"))) == ["p1", "p2", "p3", "p6"]


@pytest.mark.parametrize("uids,parent,index,expected", [
    (["p1", "g1"], "root", 99, ["p0", "p3", "p4", "p5", "p6", "p1", "p2"]),
    (["g2", "p6"], "root", 0, ["p4", "p5", "p6", "p0", "p1", "p2", "p3"]),
    (["p0", "p1"], "g0", 3, ["p2", "p0", "p1", "p3", "p4", "p5", "p6"]),
    (["p3"], "g3", 1, ["p0", "p1", "p2", "p4", "p3", "p5", "p6"]),
    (["p6", "p0"], "empty", 0, ["p1", "p2", "p0", "p6", "p3", "p4", "p5"]),
    (["g2"], "g3", 0, None), (["p0"], "p3", 0, None), (["p0"], "nowhere", 0, None),
])
def test_move(spark, uids, parent, index, expected):
    df = nodes(spark, SAMPLE)
    moves = spark.createDataFrame([(1, parent, index)], "plan_id long, parent_uid string, index int")
    moved = tree.move_subtrees(df, moves, pick(spark, *uids))
    reasons = {r.reason for r in moved.collect()}
    assert reasons == ({""} if expected else {"inside_selection" if parent == "g3" else "invalid_target"})
    assert listing(moved) == (expected or [f"p{i}" for i in range(7)])
    orders = {}
    for r in moved.collect():
        orders.setdefault(r.parent_uid, []).append(r.ord)
    assert sorted(orders[parent if expected else "root"]) == list(range(len(orders[parent if expected else "root"])))


def test_composed_document_end_to_end(spark):
    rows = [
        (1, "root", None, 0, "", None, None), (1, "g", "root", 0, "Main", None, None), (1, "a", "g", 0, None, "1", 0), (1, "b", "g", 1, None, "1", 1),
        (1, "c", "root", 1, None, "2", 0), (2, "root", None, 0, "", None, None), (2, "x", "root", 0, None, "nowhere", 0)]
    node = spark.createDataFrame(rows, TABLES["plan_node"])
    pre = spark.createDataFrame(PREFLIGHT, "doc_id long, pages int, reason string, size_bytes long")
    link = spark.createDataFrame([(2, 0, 0, "goto", 3.0, 4.0, 11.0, 12.0, 0, 7.0, 8.0, None)], TABLES["link"])
    out = flows.compose_document(node, pre, link)
    assert out["problems"].count() == 0
    assert [(r.plan_id, r.ref_reason) for r in out["invalid_refs"].collect()] == [(2, "unknown_source")]
    assert [(r.level, r.title, r.page_no) for r in out["bookmarks"].collect()] == [(1, "Main", 1)]
    # The refused plan is reported and has no runs, links or bookmarks.
    assert {r.plan_id: r.mergeable for r in out["whole"].collect()} == {1: True}
    assert {r.plan_id for r in out["runs"].collect()} == {1}
    assert [(r.output_page, r.target_page) for r in out["links"].collect()] == [(2, 2)]
    assert {r.plan_id: r.saveable for r in out["summary"].collect()} == {1: True, 2: False}


def test_a_move_sums_over_ancestors_three_times(spark, monkeypatch):
    """depths, marks, pages and weights of groups share their rounds."""
    calls, doubled = [], tree._doubled
    monkeypatch.setattr(tree, "_doubled", lambda *a: calls.append(a[1:]) or doubled(*a))
    rows = [(1, "r", None, 0, None), (1, "a", "r", 0, None), (1, "b", "r", 1, None), (1, "c", "a", 0, None), (1, "p", "c", 0, 7), (1, "q", "b", 0, 8)]
    nodes = spark.createDataFrame([(p, u, up, o, "t", "s", i) for p, u, up, o, i in rows], "plan_id long, uid string, parent_uid string, ord long, title string, source string, page_index long")
    moves = spark.createDataFrame([(1, "r", 9)], "plan_id long, parent_uid string, index int")
    picked = spark.createDataFrame([(1, "c"), (1, "p")], "plan_id long, uid string")
    moved = {r["uid"]: (r["parent_uid"], r["ord"]) for r in tree.move_subtrees(nodes, moves, picked).collect()}
    assert moved == {"r": (None, 0), "a": ("r", 0), "b": ("r", 1), "c": ("r", 2), "p": ("c", 0), "q": ("b", 0)}
    assert len(calls) == 3
