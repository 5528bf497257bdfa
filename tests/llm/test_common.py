import random

import pytest

from siftwell.llm import common


def brute(links):
    at = {}

    def root(i):
        at.setdefault(i, i)
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        at[max(x, y)] = min(x, y)
    return {n: root(n) for n in at}


CASES = {
    "nothing": [],
    "self": [(1, 1)],
    "chain": [(i, i + 1) for i in range(40)],
    "star": [(0, i) for i in range(1, 200)],
    "late centre": [(500, i) for i in range(200)],
    "random": [(random.Random(i).randrange(120), random.Random(-i).randrange(120)) for i in range(1, 90)],
    "repeated": [(1, 2), (2, 1), (1, 2), (-3, 2)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    links = CASES[name]
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute((a, b) for a, b in links if a != b)
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_grouped_map_gives_whole_groups(spark):
    rows = [(i % 7, i % 3, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, l long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    out = common.grouped_map(df, ["k", "l"], lambda g: [(int(g["k"].iloc[0]), int(g["l"].iloc[0]), len(g), int(g["v"].sum()))], "k long, l long, n long, s long").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, l, v in rows:
        n, s = want.get((k, l), (0, 0))
        want[k, l] = (n + 1, s + v)
    assert {(r.k, r.l): (r.n, r.s) for r in out} == want and len(out) == len(want)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(), "x")
