"""Composition trees as an adjacency list: plan_id, uid, parent_uid, ord, title, source, page_index.

Nodes with a ``page_index`` are pages (leaves), the others groups. What depends on ancestors or
descendants is found for groups only, by pointer jumping: a group keeps a pointer to the ancestor
2^k levels up and a few numbers, and each round doubles how far both reach, so the rounds are the
logarithm of the depth and no list of ancestors exists anywhere. How deep a tree may be is a rule
that validation reports; no other operator cuts by it. Output positions are sums of sibling
prefixes over the ancestors, so no plan is ever sorted as one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import chunks

# Fixed values ------------------------------------------------------------------
MAX_DEPTH = 12
MAX_PAGES = 20_000
DEFAULT_TITLE = "分组"
# -------------------------------------------------------------------------------

NODE = ["plan_id", "uid"]


def _doubled(groups: DataFrame, up: tuple[str, ...] = (), down: tuple[str, ...] = ()) -> DataFrame:
    """Sums over each group and its ancestors (columns ``up``) or its descendants (``down``), and ``rooted``.

    ``groups`` has plan_id, uid, parent_uid and the columns. A group whose line of parents ends at one
    that does not exist is not rooted, nor is one on or below a cycle: its pointer still moves when it
    has passed more levels than its plan has groups. Its sums then count nodes more than once, but are
    zero only if all nodes that they reach are.
    """
    state = groups.select(
        *NODE, F.col("parent_uid").alias("jump"), F.col("parent_uid").isNull().alias("rooted"),
        *(F.col(c).cast("long").alias(c) for c in (*up, *down)),
    ).checkpoint()
    many = state.groupBy("plan_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    reach = 1
    while reach <= 2 * many and not state.where("jump IS NOT NULL").isEmpty():
        target = state.select(
            "plan_id", F.col("uid").alias("_at"), F.col("jump").alias("_jump"), F.col("rooted").alias("_rooted"),
            F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in up),
        ).dropDuplicates(["plan_id", "_at"])  # a repeated uid is for validation to report
        # Pointers that have arrived get a key of their own, so they neither match nor pile up.
        at = F.coalesce("jump", F.concat(F.lit("\u0000"), F.col("uid")))
        moved = state.withColumn("_at", at).join(target, ["plan_id", "_at"], "left")
        there = F.coalesce("_there", F.lit(False))
        # Each pointer jumps on; a pointer into the air stops there.
        after = moved.select(
            *NODE, F.when(there, F.col("_jump")).alias("jump"), (F.col("rooted") | (there & F.coalesce("_rooted", F.lit(False)))).alias("rooted"),
            *(F.when(there, F.col(c) + F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in up), *down,
        )
        if down:
            sent = state.where("jump IS NOT NULL").groupBy("plan_id", F.col("jump").alias("uid")).agg(*(F.sum(c).alias(f"_{c}") for c in down))
            after = after.join(sent, NODE, "left").select(
                *NODE, "jump", "rooted", *up, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in down),
            )
        state, reach = after.checkpoint(), 2 * reach
    return state.select(*NODE, (F.col("rooted") & F.col("jump").isNull()).alias("rooted"), *up, *down)


def _with_group(nodes: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """Attach to each node the columns of its parent, as ``_<column>``."""
    parents = groups.select("plan_id", F.col("uid").alias("parent_uid"), *(F.col(c).alias(f"_{c}") for c in columns))
    return nodes.join(parents.dropDuplicates(["plan_id", "parent_uid"]), ["plan_id", "parent_uid"], "left")


def _weighted_groups(plan_node: DataFrame) -> DataFrame:
    """Groups with ``depth`` 1, the ``pages`` directly in them, and ``held``: those and themselves."""
    own = plan_node.where("page_index IS NOT NULL").groupBy("plan_id", F.col("parent_uid").alias("uid")).agg(F.count(F.lit(1)).alias("pages"))
    groups = plan_node.where("page_index IS NULL").join(own, NODE, "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    return groups.withColumn("depth", F.lit(1)).withColumn("held", F.col("pages") + 1)


def tree_levels(plan_node: DataFrame) -> DataFrame:
    """``depth`` and ``rooted`` of every node, and ``pages``: the pages at or below it.

    A node is rooted if its line of parents ends at a root; the depth of others is null.
    """
    return _levels(plan_node, _doubled(_weighted_groups(plan_node), ("depth",), ("pages",)))


def _levels(plan_node: DataFrame, found: DataFrame) -> DataFrame:
    """``tree_levels`` from the sums of depths and pages over the groups."""
    below = found.select("plan_id", F.col("uid").alias("_uid"), F.col("pages").alias("_pages")).dropDuplicates(["plan_id", "_uid"])
    # Pages have no entry of their own there.
    key = F.when(F.col("page_index").isNull(), F.col("uid"))
    rooted = F.col("parent_uid").isNull() | F.coalesce("_rooted", F.lit(False))
    return (
        _with_group(plan_node, found, "depth", "rooted")
        .withColumn("rooted", rooted)
        .withColumn("depth", F.when(rooted, F.coalesce("_depth", F.lit(0))).cast("int"))
        .withColumn("_uid", F.coalesce(key, F.concat(F.lit("\u0000"), F.col("uid"))))
        .join(below, ["plan_id", "_uid"], "left")
        .withColumn("pages", F.when(F.col("page_index").isNull(), F.coalesce("_pages", F.lit(0))).otherwise(1))
        .select(*plan_node.columns, "rooted", "depth", "pages")
    )


def _with_preorder(levels: DataFrame, weight: Column, of: Column, name: str) -> DataFrame:
    """The rooted nodes that ``of`` selects, with the weight of all nodes visited before each, ancestors excluded.

    ``weight`` is what a node and everything below it weighs. Earlier siblings are summed first, then
    the sums of all ancestors; a node needs one join to its parent.
    """
    placed = chunks.scan(
        levels.where("rooted").withColumn("_w", weight.cast("long")), ["plan_id", "parent_uid"], [F.col("ord"), F.col("uid")],
        chunks.by_width(F.col("ord")), _before=chunks.sum_before(F.col("_w")),
    ).checkpoint()
    above = _doubled(placed.where("page_index IS NULL").withColumnRenamed("_before", "above"), ("above",))
    return (
        _with_group(placed.where(of), above, "above")
        .withColumn(name, F.col("_before") + F.coalesce("_above", F.lit(0)))
        .drop("_before", "_above", "_w")
    )


def flatten_tree(plan_node: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """I4: pages in depth-first order; ``pos`` is the zero-based output page."""
    levels = tree_levels(plan_node) if levels is None else levels
    return _with_preorder(levels, F.col("pages"), F.col("page_index").isNotNull(), "pos").select(
        "plan_id", "pos", "uid", "depth", "source", "page_index"
    )


def tree_bookmarks(plan_node: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Depth, title and first one-based page of every non-empty group below the root."""
    levels = tree_levels(plan_node) if levels is None else levels
    groups = F.col("page_index").isNull() & F.col("parent_uid").isNotNull() & (F.col("pages") > 0)
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)^\s+|\s+$", "")
    return _with_preorder(levels, F.col("pages"), groups, "_pages_before").select(
        "plan_id", "uid", F.col("depth").alias("level"),
        F.when(title == "", DEFAULT_TITLE).otherwise(title).alias("title"),
        (F.col("_pages_before") + 1).alias("page_no"),
    )


def validate_tree(
    plan_node: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES, levels: DataFrame | None = None
) -> DataFrame:
    """Per plan the first broken rule, or an empty reason. A plan has exactly one root."""
    levels = tree_levels(plan_node) if levels is None else levels
    repeated = plan_node.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("plan_id").distinct()
    parents = plan_node.where("parent_uid IS NOT NULL").select("plan_id", F.col("parent_uid").alias("uid")).distinct()
    pages_with_children = plan_node.where("page_index IS NOT NULL").join(parents, NODE, "left_semi").select("plan_id").distinct()
    facts = levels.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("page_index").isNotNull()).alias("pages"),
        F.max("depth").alias("depth"),
        F.bool_and("rooted").alias("_reached"),
        F.count_if(F.col("parent_uid").isNull()).alias("_roots"),
    )
    reason = (
        F.when(F.col("_repeated"), "duplicate_uid")
        .when(F.col("_nested"), "page_with_children")
        .when(~F.col("_reached"), "cycle_or_orphan")
        .when(F.col("_roots") > 1, "several_roots")
        .when(F.col("depth") > max_depth, "too_deep")
        .when(F.col("pages") > max_pages, "too_many_pages")
        .otherwise("")
    )
    return (
        facts.join(repeated.withColumn("_repeated", F.lit(True)), "plan_id", "left")
        .join(pages_with_children.withColumn("_nested", F.lit(True)), "plan_id", "left")
        .select("plan_id", "nodes", "pages", "depth", reason.alias("reason"))
    )


def top_selected(plan_node: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected nodes without a selected ancestor; the root never counts."""
    return _top_selected(plan_node, _chosen(plan_node, selection)).select("plan_id", "uid", "parent_uid", "ord", "depth")


def _top_selected(plan_node: DataFrame, chosen: DataFrame) -> DataFrame:
    found = _doubled(_marked(_weighted_groups(plan_node), chosen), ("depth", "marks"), ("pages",))
    return _tops(_levels(plan_node, found), found, chosen)


def _chosen(plan_node: DataFrame, selection: DataFrame) -> DataFrame:
    roots = plan_node.where("parent_uid IS NULL").select(*NODE)
    return selection.select(*NODE).distinct().join(roots, NODE, "left_anti")


def _marked(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    return groups.join(chosen.withColumn("marks", F.lit(1)), NODE, "left").withColumn("marks", F.coalesce("marks", F.lit(0)))


def _marks_above(plan_node: DataFrame, chosen: DataFrame) -> DataFrame:
    """(plan_id, uid, marks) of every group: 0 if neither it nor an ancestor is chosen."""
    return _doubled(_marked(plan_node.where("page_index IS NULL"), chosen), ("marks",))


def _tops(levels: DataFrame, marks: DataFrame, chosen: DataFrame) -> DataFrame:
    picked = levels.where("rooted").join(chosen, NODE, "left_semi")
    return _with_group(picked, marks, "marks").where("coalesce(_marks, 0) = 0").drop("_marks")


def remove_subtrees(plan_node: DataFrame, selection: DataFrame) -> DataFrame:
    """I8: the tree without the selected nodes and everything below them."""
    chosen = _chosen(plan_node, selection)
    below = _with_group(plan_node, _marks_above(plan_node, chosen), "marks").where("coalesce(_marks, 0) = 0")
    return below.select(*plan_node.columns).join(chosen, NODE, "left_anti")


def move_subtrees(plan_node: DataFrame, moves: DataFrame, selection: DataFrame) -> DataFrame:
    """Move the selected subtrees below ``parent_uid`` at ``index``, one move per plan.

    ``moves`` has plan_id, parent_uid, index. Adds ``reason``: a plan whose target is
    missing, is a page, or lies inside a moved subtree is returned unchanged with one.
    The index is clamped and counts only the siblings that stay; children of the target
    are renumbered from 0.
    """
    chosen = _chosen(plan_node, selection).checkpoint()
    # Depths, marks, pages and weights are summed in the same rounds.
    found = _doubled(_marked(_weighted_groups(plan_node), chosen), ("depth", "marks"), ("pages", "held"))
    levels = _levels(plan_node, found).checkpoint()
    top = _tops(levels, found, chosen).select(*NODE).checkpoint()
    # All nodes weigh one; what a group weighs is all that it holds.
    held = found.dropDuplicates(NODE).select("plan_id", F.col("uid").alias("_uid"), "held")
    group_uid = F.when(F.col("page_index").isNull(), F.col("uid")).otherwise(F.concat(F.lit("\u0000"), F.col("uid")))
    weighed = levels.withColumn("_uid", group_uid).join(held, ["plan_id", "_uid"], "left").drop("_uid")
    ordered_top = _with_preorder(weighed, F.coalesce("held", F.lit(1)), F.lit(True), "_pre").join(top, NODE, "left_semi").select(*NODE, "_pre")

    target = moves.select("plan_id", F.col("parent_uid").alias("_target"), F.col("index").alias("_index"))
    inside = _marks_above(plan_node, top).where("marks > 0").select("plan_id", F.col("uid").alias("_target"), F.lit(True).alias("_inside"))
    known = levels.where("page_index IS NULL AND rooted").select("plan_id", F.col("uid").alias("_target"), F.lit(True).alias("_known"))
    plan = (
        target.join(known.distinct(), ["plan_id", "_target"], "left").join(inside.distinct(), ["plan_id", "_target"], "left")
        .select(
            "plan_id", "_target", "_index",
            F.when(F.col("_known").isNull(), "invalid_target").when(F.col("_inside"), "inside_selection").otherwise("").alias("reason"),
        )
    )
    nodes = (
        plan_node.join(plan, "plan_id", "left")
        .join(ordered_top, NODE, "left")
        .withColumn("reason", F.coalesce("reason", F.lit("")))
        .withColumn("_moves", F.col("_pre").isNotNull() & (F.col("reason") == "") & F.col("_target").isNotNull())
        .withColumn("_child", (F.col("parent_uid") == F.col("_target")) & (F.col("reason") == ""))
        .checkpoint()  # read four times below
    )
    # Current place of the target's children, counting all of them and the staying ones.
    children = chunks.scan(
        nodes.where("_child"), ["plan_id"], [F.col("ord"), F.col("uid")], chunks.by_width(F.col("ord")),
        _all=chunks.count(), _staying=chunks.sum_before((~F.col("_moves")).cast("long")),
    ).select(*NODE, "_all", "_staying", F.col("_index").alias("_at"), "_moves")
    staying = children.where("NOT _moves")
    gap = staying.where("_all <= _at").groupBy("plan_id").agg(F.count(F.lit(1)).alias("_gap"))
    moved = chunks.scan(
        nodes.where("_moves"), ["plan_id"], [F.col("_pre")], chunks.by_width(F.col("_pre")), _rank=chunks.count()
    ).select(*NODE, "_rank")
    counts = moved.groupBy("plan_id").agg(F.count(F.lit(1)).alias("_moved"))
    place = (
        nodes.join(gap, "plan_id", "left").join(counts, "plan_id", "left")
        .join(moved, NODE, "left").join(staying.select(*NODE, "_staying"), NODE, "left")
    )
    cut = F.coalesce("_gap", F.lit(0))
    new_ord = (
        F.when(F.col("_moves"), cut + F.col("_rank") - 1)
        .when(F.col("_staying").isNotNull() & F.col("_moved").isNotNull(),
              F.col("_staying") + F.when(F.col("_staying") >= cut, F.col("_moved")).otherwise(F.lit(0)))
        .otherwise(F.col("ord"))
    )
    return place.select(
        "plan_id", "uid",
        F.when(F.col("_moves"), F.col("_target")).otherwise(F.col("parent_uid")).alias("parent_uid"),
        new_ord.cast("long").alias("ord"), "title", "source", "page_index", "reason",
    )
