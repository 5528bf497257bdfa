"""Chains of pages and members of trees, with everything that can be wrong."""

from siftwell.operators import graph


def test_chains(spark):
    pages = [("s", i, i + 1 if i < 200 else 0, 10) for i in range(1, 201)]  # long
    pages += [("a", 1, 2, 10), ("a", 2, 0, 10), ("a", 2, 0, 9)]  # two versions
    pages += [("b", 1, 2, 10), ("b", 2, 3, 10), ("b", 3, 2, 10)]  # goes round behind its beginning
    pages += [("c", 1, 1, 10)]  # leads to itself
    pages += [("d", 1, 3, 10), ("d", 2, 3, 10), ("d", 3, 0, 10)]  # two lead to one
    pages += [("e", 1, 7, 10)] + [("f", 5, 6, 10), ("f", 6, 0, 10)] + [("g", 1, 2, 4), ("g", 2, 1, 4)]
    heads = [("s", 0, 1, 2000), ("a", 0, 1, 20), ("b", 0, 1, 30), ("c", 0, 1, 10), ("d", 0, 1, 20), ("d", 1, 2, 20), ("e", 0, 1, 20), ("e", 1, 9, 20), ("f", 0, 5, 19), ("f", 1, 6, 10)]
    states, placed = graph.chains(spark.createDataFrame(heads, "k string, id int, first long, length long"), spark.createDataFrame(pages, "k string, page long, next long, size long"), ["k"])
    assert {(r.k, r.id): (r.n, r.state) for r in states.collect()} == {
        ("s", 0): (200, graph.COMPLETE), ("a", 0): (2, graph.AMBIGUOUS), ("b", 0): (3, graph.CYCLE), ("c", 0): (1, graph.CYCLE), ("d", 0): (2, graph.SEVERAL_PARENTS), ("d", 1): (1, graph.SEVERAL_PARENTS),
        ("e", 0): (1, graph.MISSING), ("e", 1): (0, graph.MISSING), ("f", 0): (1, graph.SEVERAL_PARENTS), ("f", 1): (1, graph.SEVERAL_PARENTS),
    }
    assert [(r.page, r.at) for r in placed.where("k = 's'").orderBy("at").collect()] == [(i + 1, i) for i in range(200)]
    assert placed.where("k = 'g'").isEmpty()


def test_members(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "x"), ("b", "y"), ("b", "gone"), ("a", "twice"), ("c", "d"), ("d", "c")], "parent string, child string")
    pages = spark.createDataFrame([("r", 3), ("a", 2), ("b", 2), ("x", 1), ("y", 2), ("twice", 1), ("twice", 1), ("c", 3), ("d", 2)], "page string, own_level int")
    roots = spark.createDataFrame([("t", "r"), ("u", "c")], "tree string, page string")
    got = {(r.tree, r.page): r.status for r in graph.members(edges, pages, roots).collect()}
    assert got == {
        ("t", "r"): "member", ("t", "a"): "member", ("t", "b"): "member", ("t", "x"): "multiple_parents", ("t", "y"): "level_mismatch", ("t", "gone"): "missing", ("t", "twice"): "ambiguous",
        ("u", "c"): "cycle", ("u", "d"): "member",
    }
