"""Connected components by star contraction, and question clusters named in the order of their smallest ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordered import running

#: A node with more neighbours than this is a hot centre; its rows are dealt over SALTS tasks.
HOT, SALTS, BROADCAST_ROWS = 100_000, 64, 1_000_000


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: Column, hot: int | None = None) -> DataFrame:
    """many joined with `one`, which has a row for each key and in column `_n` how many rows of `many` that key has. Rows of
    hot keys are dealt by `spread` and meet copies of their one row, so no key's rows meet in one task."""
    hots = one.where(F.col("_n") > (HOT if hot is None else hot)).select(F.col(key).alias("_h"))
    some = hots.limit(BROADCAST_ROWS + 1).count()
    if not some:
        return many.join(one.drop("_n"), key)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    if some <= BROADCAST_ROWS:
        marked = many.join(F.broadcast(hots), F.col(key) == F.col("_h"), "left").withColumn("_salt", F.when(F.col("_h").isNotNull(), salt).otherwise(0)).drop("_h")
        copies = F.when(F.col("_n") > (HOT if hot is None else hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    else:  # so many hot keys that all are dealt out
        marked, copies = many.withColumn("_salt", salt), F.sequence(F.lit(0), F.lit(SALTS - 1))
    return marked.join(one.withColumn("_salt", F.explode(copies)).drop("_n"), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, hot: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node that it is connected to. Large-star and small-star
    rounds on minima: no node's neighbours are collected, joins on a centre are salted, and each round is a written table, so
    a lost executor costs one round."""
    e = written(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "graph-edges")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = written(e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "graph-round")
    while True:
        around = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = salted_join(around.where("v > u"), least, "u", F.col("v"), hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "graph-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        tied = salted_join(large, low, "u", F.col("v"), hot)
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        after = written(tied.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct(), "graph-round")
        # Stars are all there is when no node is below two others, and none is both above and below one.
        more = after.groupBy("u").count().where("count > 1").limit(1).count() or after.select(F.col("v").alias("u")).distinct().join(after.select("u").distinct(), "u", "left_semi").limit(1).count()
        if not more:
            return nodes.join(after.select(F.col("u").alias("node"), F.col("v").alias("_r")), "node", "left").select("node", F.coalesce("_r", "node").alias("root"))
        stars = after


def question_clusters(rows: DataFrame, hot: int | None = None) -> DataFrame:
    """rows (id, source, key: the normalised text; pilot) to one row per id: id, source, pilot, cluster_id, size, has_pilot.
    Ids that share a text, at whatever remove, are one cluster; clusters are named cluster_0000 and on in the order of their
    smallest ids. A cluster over several sources fails the job. Rows without an id are left out."""
    known = rows.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), "source", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("pilot", F.lit(False)).alias("pilot"))
    # "0" before ids and "1" before texts, so that the least node of a component is its smallest id.
    node = F.concat(F.lit("0"), "id")
    root = components(known.select(node.alias("a"), F.concat(F.lit("1"), F.sha2("key", 256)).alias("b")), hot)
    ids = known.groupBy("id").agg(F.min("source").alias("source"), F.max("source").alias("_last"), F.bool_or("pilot").alias("pilot"))
    ids = written(ids.withColumn("node", node).join(root, "node").drop("node"), "graph-ids")
    g = ids.groupBy("root").agg(F.count("*").alias("size"), F.bool_or("pilot").alias("has_pilot"), F.min("source").alias("_a"), F.max("_last").alias("_b"))
    spans = F.raise_error(F.concat(F.lit("cluster spans several sources: "), "_a", F.lit(", "), "_b", F.lit(" at "), "root"))
    g = g.withColumn("size", F.when(F.col("_a") != F.col("_b"), spans.cast("long")).otherwise(F.col("size"))).drop("_a", "_b")
    named = running(g, [], ["root"]).select("root", F.format_string("cluster_%04d", F.col("rn") - 1).alias("cluster_id"), "size", "has_pilot", F.col("size").alias("_n"))
    return salted_join(ids.drop("_last"), written(named, "graph-names"), "root", F.col("id"), hot).drop("root")
