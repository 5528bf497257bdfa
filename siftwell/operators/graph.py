"""Pages and records that point at each other: links, parents, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def reciprocal_links(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``pages(keys, page, next, prev)`` with the state of the link to the next page; 0 links to nothing.

    A page number that a line holds more than once is dropped from linking, on either side.
    """
    from pyspark.sql import Window

    single = pages.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "page"))).where("_n = 1").drop("_n")
    a, b = single.alias("a"), single.select(*keys, F.col("page").alias("_page"), F.col("prev").alias("_prev")).alias("b")
    on = F.col("a.next") == F.col("b._page")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    status = F.when(F.col("a.next") == 0, "end").when(F.col("b._page").isNull(), "missing").when(F.col("b._prev") == F.col("a.page"), "confirmed").otherwise("mismatch")
    return a.join(b, on, "left").select("a.*", status.alias("link"))


def ancestors(nodes: DataFrame, hops: int = 255) -> DataFrame:
    """``nodes(node, parent, name, wanted)``: path, hops and state of every wanted node, root first.

    Follows parents by repeated joins, one for each level; a null parent is a root. The state is complete,
    missing (a parent is not there), cycle, or too_deep for what has more than ``hops`` levels above it. Each
    level is stored, so that it is computed once and the plan doesn't grow.
    """
    up = nodes.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"), F.col("name").alias("_name"))
    at = nodes.where("wanted").select("node", F.col("parent").alias("next"), F.array("node").alias("seen"), F.array("name").alias("path"))
    state = F.when(F.col("next").isNull(), "complete").when(F.array_contains("seen", F.col("next")), "cycle").when(F.col("lost"), "missing")
    done = []
    at = at.withColumn("lost", F.lit(False))
    for level in range(hops + 1):
        at = materialize(at.withColumn("state", state), "ancestors")
        done.append(at.where("state IS NOT NULL").select("node", F.reverse("path").alias("path"), "state"))
        on = at.where("state IS NULL")
        if on.isEmpty():
            break
        if level == hops:
            done.append(on.select("node", F.reverse("path").alias("path"), F.lit("too_deep").alias("state")))
            break
        found = on.join(up, F.col("next") == F.col("_node"), "left")
        there = F.col("_node").isNotNull()
        at = found.select(
            "node", F.when(there, F.col("_parent")).otherwise(F.col("next")).alias("next"), F.when(there, F.concat("seen", F.array("_node"))).otherwise(F.col("seen")).alias("seen"),
            F.when(there, F.concat("path", F.array("_name"))).otherwise(F.col("path")).alias("path"), (~there).alias("lost"),
        )
    return reduce(DataFrame.unionByName, done).withColumn("hops", F.size("path") - 1)


def tree(edges: DataFrame, roots: DataFrame, depth: int = 255) -> DataFrame:
    """Pages reached from ``roots(tree, page)`` along ``edges(parent, child)``: tree, page, level and number of parents.

    Level by level, each level once joined to the edges and stored; a page that is reached again is not
    followed, so cycles end. A page with more than one parent in a tree is an error of its own, shown by
    ``parents``. What lies below ``depth`` is an error: a tree that deep is no tree of pages.
    """
    front = materialize(roots.select("tree", "page", F.lit(0).alias("level")).distinct(), "tree")
    seen = front
    for level in range(1, depth + 2):
        front = front.join(edges, front["page"] == edges["parent"]).select("tree", F.col("child").alias("page")).distinct()
        front = materialize(front.join(seen, ["tree", "page"], "left_anti").withColumn("level", F.lit(level)), "tree")
        if front.isEmpty():
            break
        if level > depth:
            raise ValueError(f"a tree has more than {depth} levels")
        seen = seen.unionByName(front)
    inside = edges.join(seen.select("tree", F.col("page").alias("parent")), "parent").groupBy("tree", F.col("child").alias("page")).agg(F.countDistinct("parent").alias("parents"))
    return seen.join(inside, ["tree", "page"], "left").withColumn("parents", F.coalesce("parents", F.lit(0)))


#: States of a chain of pages, the first that holds.
AMBIGUOUS, CYCLE, SEVERAL_PARENTS, MISSING, WRONG_LENGTH, COMPLETE = "ambiguous_page", "cycle", "multiple_parents", "missing_page", "length_mismatch", "complete"


def chains(heads: DataFrame, pages: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What chains of linked pages hold: a row a head with its state, and the pages in their order.

    ``heads(keys, id, first, length)`` point to first pages, ``pages(keys, page, next, size)`` to the next one, 0 at the end. A page's
    way back to its head is doubled in every round, so a chain of n pages takes log n joins. Returned are
    ``(keys, id, first, length, n, size, state)`` and ``(keys, first, page, at)``, ``at`` from 0. States: a page that is there more than once,
    a chain that comes back to itself, a page that more than one page or head leads to, one that is missing,
    a sum of sizes that is not the head's length. Of several versions of a page the smallest counts for the way on.
    """
    versions = pages.groupBy(*keys, "page").agg(F.min(F.struct("next", "size")).alias("v"), F.count("*").alias("versions"))
    p = materialize(versions.select(*keys, "page", "v.next", "v.size", "versions"), "pages")
    into = p.where("next <> 0").select(*keys, F.col("next").alias("page"), F.col("page").alias("parent"))
    led = into.unionByName(heads.select(*keys, F.col("first").alias("page"), F.lit(None).cast(p.schema["page"].dataType).alias("parent")))
    parents = led.groupBy(*keys, "page").agg(F.count("*").alias("parents"), F.min("parent").alias("parent"), F.bool_or(F.col("parent").isNull()).alias("head"))
    way = p.join(parents, [*keys, "page"]).select(*keys, "page", F.when(F.col("head"), F.col("page")).otherwise(F.col("parent")).alias("back"), F.when(F.col("head"), 0).otherwise(1).cast("long").alias("at"), "head")
    way = materialize(way, "way")
    # a way of n steps is whole after log2(n) rounds; what has not come to a head by then goes round or began nowhere
    for _ in range(max(1, way.count()).bit_length()):
        if way.where("NOT head").isEmpty():
            break
        on = way.select(*keys, F.col("page").alias("back"), F.col("back").alias("further"), F.col("at").alias("more"), F.col("head").alias("ended"))
        step = way.where("NOT head").join(on, [*keys, "back"]).select(*keys, "page", F.col("further").alias("back"), (F.col("at") + F.col("more")).alias("at"), F.col("ended").alias("head"))
        way = materialize(way.where("head").unionByName(step), "way")
    placed = materialize(way.where("head").select(*keys, F.col("back").alias("first"), "page", "at"), "placed")
    d = placed.join(p, [*keys, "page"]).join(parents.select(*keys, "page", "parents"), [*keys, "page"])
    follow = placed.select(*keys, F.col("page").alias("next"), F.col("first").alias("next_first"))
    known = p.select(*keys, F.col("page").alias("next"), F.lit(True).alias("there"))
    many = parents.where("parents > 1").select(*keys, F.col("page").alias("next"), F.lit(True).alias("shared"))
    last = d.groupBy(*keys, "first").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.max("versions").alias("versions"), F.max(F.when(F.col("page") != F.col("first"), F.col("parents"))).alias("inner_parents"),
        F.max(F.when(F.col("page") == F.col("first"), F.col("parents"))).alias("first_parents"), F.max_by("next", "at").alias("next"),
    )
    last = last.join(follow, [*keys, "next"], "left").join(known, [*keys, "next"], "left").join(many, [*keys, "next"], "left")
    h = heads.select(*keys, "id", "first", "length").join(last, [*keys, "first"], "left")
    state = (
        F.when(F.col("n").isNull(), MISSING).when(F.col("versions") > 1, AMBIGUOUS).when(F.col("next_first") == F.col("first"), CYCLE)
        .when((F.coalesce("inner_parents", F.lit(1)) > 1) | (F.col("first_parents") > 1) | F.coalesce("shared", F.lit(False)), SEVERAL_PARENTS)
        .when((F.col("next") != 0), MISSING).when(F.col("size") != F.col("length"), WRONG_LENGTH).otherwise(COMPLETE)
    )
    return h.select(*keys, "id", "first", "length", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("size", F.lit(0)).alias("size"), state.alias("state")), placed


def members(edges: DataFrame, pages: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """tree, page, level, parents and status of every page that ``roots(tree, page)`` reach, as ``tree`` gives them.

    ``pages(page, own_level)`` are the pages there are, with the level that each says it has, leaves 1. Status: missing, ambiguous
    (more than one page of that name), cycle (a root that is below itself), multiple_parents, level_mismatch (not one less than
    its parent's), else member.
    """
    own = pages.groupBy("page").agg(F.count("*").alias("versions"), F.min("own_level").alias("own_level"))
    found = tree(edges, roots, depth).join(own, "page", "left")
    up = edges.join(found.select("tree", F.col("page").alias("parent"), F.col("own_level").alias("above")), "parent").groupBy("tree", F.col("child").alias("page")).agg(F.min("above").alias("above"))
    found = found.join(up, ["tree", "page"], "left")
    status = (
        F.when(F.col("versions").isNull(), "missing").when(F.col("versions") > 1, "ambiguous").when((F.col("level") == 0) & (F.col("parents") > 0), "cycle").when(F.col("parents") > 1, "multiple_parents")
        .when((F.col("level") > 0) & (F.col("own_level") != F.col("above") - 1), "level_mismatch").otherwise("member")
    )
    return found.select("tree", "page", "level", "parents", status.alias("status"))
