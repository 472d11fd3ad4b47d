"""Running ranks and sums over few large groups, star contraction with hot centres, clusters and the four-way split."""

import random

import pytest
from pyspark.sql import functions as F

from varipair.operators import graph, splits
from varipair.operators.ordered import running


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_running_equals_a_window(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["big"] * 8 + ["small", None]), i, rnd.randint(0, 3), rnd.randint(0, 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, id long, o int, size int")
    got = running(df, ["g"], [F.col("o") % 2, "id"], "size", piece_rows=150)
    want, seen = {}, {}
    for g, i, o, size in sorted(rows, key=lambda r: (r[2] % 2, r[1])):
        n, total = seen.get(g, (0, 0))
        want[i] = (n + 1, total)
        seen[g] = n + 1, total + size
    assert {r["id"]: (r["rn"], r["before"]) for r in got.collect()} == want
    assert got.columns == ["g", "id", "o", "size", "rn", "before"]
    assert running(df.limit(0), ["g"], ["id"]).count() == 0
    assert [r["rn"] for r in running(df, [], ["id"], piece_rows=100).orderBy("id").collect()] == list(range(1, 4001))


def test_no_group_is_in_one_task(spark):
    df = spark.range(20_000).select(F.lit("all").alias("g"), "id")
    sizes = []
    plan = running(df, ["g"], ["id"], piece_rows=1_000)
    # The window's partitions hold one piece each at most: none sees the whole group.
    sizes = plan.groupBy(F.floor((F.col("rn") - 1) / 1_000)).count().count()
    assert sizes == 20 and "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [None, 5, 0])
def test_components(spark, hot):
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(500, k) for k in range(501, 700)] + [(k, k + 1) for k in range(800, 860)] + [(900, 900), (3, 3)]
    df = spark.createDataFrame([*edges, *edges[:20], (None, 5), (7, None)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(df, hot).collect()} == roots(edges)


def test_components_when_nearly_all_centres_are_hot(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    edges = [(k // 7, 1000 + k) for k in range(200)]
    assert {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), 2).collect()} == roots(edges)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cluster_rows():
    rows = [("b2", "x", "t1", False), ("b1", "x", "t1", True), ("b1", "x", "t2", False), ("b9", "x", "t2", False), ("a5", "y", "t3", None), ("c1", "y", None, False), ("c2", "y", "", False), (None, "y", "t3", True)]
    return [*rows, ("a5", "y", "t3", None)]


def test_question_clusters(spark):
    df = spark.createDataFrame(cluster_rows(), "id string, source string, key string, pilot boolean")
    for hot in (None, 0):
        got = {r["id"]: (r["cluster_id"], r["size"], r["has_pilot"], r["pilot"]) for r in graph.question_clusters(df, hot).collect()}
        assert got == {"a5": ("cluster_0000", 1, False, False), "b1": ("cluster_0001", 3, True, True), "b2": ("cluster_0001", 3, True, False), "b9": ("cluster_0001", 3, True, False), "c1": ("cluster_0002", 2, False, False), "c2": ("cluster_0002", 2, False, False)}


def test_cluster_over_two_sources_fails(spark):
    df = spark.createDataFrame([*cluster_rows(), ("d1", "x", "t3", False)], "id string, source string, key string, pilot boolean")
    with pytest.raises(Exception, match="cluster spans several sources: x, y"):
        graph.question_clusters(df).collect()


def test_four_way_split(spark):
    rnd = random.Random(2)
    rows = [("big" if i % 5 else "small", f"c{i:04d}", rnd.randint(1, 4), i % 19 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "stratum string, cluster string, size int, has_pilot boolean")
    totals = df.groupBy("stratum").agg(F.sum("size").alias("total"))
    got = {r["cluster"]: r["split"] for r in splits.greedy_split(df, totals, F.md5("cluster")).collect()}
    import hashlib

    for s in ("big", "small"):
        mine = sorted((r for r in rows if r[0] == s and not r[3]), key=lambda r: (hashlib.md5(r[1].encode()).hexdigest(), r[1]))
        total = sum(r[2] for r in rows if r[0] == s)
        train = val = 0
        for _, c, size, _ in mine:
            if train < round(total * 0.7):
                train, want = train + size, "train"
            elif val < round(total * 0.1):
                val, want = val + size, "val"
            else:
                want = "final_test"
            assert got[c] == want
    assert all(got[r[1]] == "diagnostic" for r in rows if r[3])
    summary = {r["split"]: r for r in splits.split_summary(splits.greedy_split(df, totals, F.md5("cluster"))).collect()}
    assert sum(r["n_rows"] for r in summary.values()) == sum(r[2] for r in rows) and abs(sum(r["pct"] for r in summary.values()) - 100) < 0.05
