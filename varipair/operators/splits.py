"""Samples and splits: allocation, order, greedy prefixes, clusters, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def largest_remainder(counts: DataFrame, total: int) -> DataFrame:
    """Shares of `total` by (stratum, n): floors, and one more for the largest fractions, ties by name. Windows run
    over one row per stratum."""
    all_rows = Window.partitionBy(F.lit(0))
    c = counts.withColumn("quota", F.col("n") * F.lit(total) / F.sum("n").over(all_rows)).withColumn("base", F.floor("quota"))
    c = c.withColumn("left", F.lit(total) - F.sum("base").over(all_rows))
    c = c.withColumn("rank", F.row_number().over(all_rows.orderBy(F.desc(F.round(F.col("quota") - F.col("base"), 9)), "stratum")))
    return c.select("stratum", "n", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("k"))


def stratified_sample(rows: DataFrame, shares: DataFrame, order) -> DataFrame:
    """The first k rows of each stratum in a fixed pseudo-random order (`order`, then id). No stratum is in one task."""
    ranked = running(rows.select("stratum", "id"), ["stratum"], [order, "id"])
    return ranked.join(shares.select("stratum", "k"), "stratum").where("rn <= k").select("stratum", "id", F.col("rn").cast("int").alias("rn"))


def round_robin(rows: DataFrame) -> DataFrame:
    """(stratum, id) with `stage_order`: the i-th of each stratum, strata by name. What comes before a row's turn follows
    from the sizes of the strata, one long each. No stratum is in one task."""
    per = running(rows.select("stratum", "id"), ["stratum"], ["id"]).drop("before")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n")).agg(F.collect_list("n")).scalar()
    before = F.aggregate("_sizes", F.lit(0).cast("long"), lambda total, n: total + F.least(n, F.col("rn") - 1))
    place = F.row_number().over(Window.partitionBy("rn").orderBy("stratum"))
    return per.withColumn("_place", place).withColumn("_sizes", sizes).select("stratum", "id", (before + F.col("_place")).alias("stage_order"))


def text_clusters(rows: DataFrame, key) -> DataFrame:
    """(id, stratum, cluster, size): rows of one stratum with equal normalised text; named by the smallest id."""
    k = rows.select("id", "stratum", key(F.col("text")).alias("k"))
    g = k.groupBy("stratum", "k").agg(F.min("id").alias("cluster"), F.count("*").alias("size"))
    return k.join(g, ["stratum", "k"]).drop("k")


def greedy_split(clusters: DataFrame, totals: DataFrame, order, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Whole clusters in a fixed order: train while fewer than round(total * train) rows are assigned before, then
    val likewise, the rest final_test. Clusters with `has_pilot` (if there is such a column) are diagnostic and out of
    the order. totals: (stratum, total) of all rows, pilots too. No stratum is in one task."""
    pilot = F.coalesce("has_pilot", F.lit(False)) if "has_pilot" in clusters.columns else F.lit(False)
    c = clusters.withColumn("_pilot", pilot).withColumn("_size", F.when(F.col("_pilot"), 0).otherwise(F.col("size")))
    goal = lambda share: F.bround(F.col("total") * share)
    c = running(c, ["stratum"], [order, "cluster"], "_size").drop("rn").join(totals, "stratum")
    c = c.withColumn("is_train", ~F.col("_pilot") & (F.col("before") < goal(train)))
    in_train = c.groupBy("stratum").agg(F.sum(F.when(F.col("is_train"), F.col("size")).otherwise(0)).alias("in_train"))
    split = F.when(F.col("_pilot"), "diagnostic").when(F.col("is_train"), "train").when(F.col("before") - F.col("in_train") < goal(val), "val").otherwise("final_test")
    return c.join(in_train, "stratum").select("stratum", "cluster", "size", split.alias("split"))


def split_summary(assigned: DataFrame) -> DataFrame:
    """Per split: clusters, rows and the share of all rows in percent, in the order of the splits."""
    g = assigned.groupBy("split").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_rows"))
    return g.withColumn("pct", F.round(100 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0))), 2))


def leakage(assigned: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split, by pair of splits."""
    k = assigned.select(key, "split").distinct()
    o = k.select(key, F.col("split").alias("other"))
    return k.join(o, key).where("split < other").groupBy("split", "other").agg(F.count("*").alias("n_shared"))
