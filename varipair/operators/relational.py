"""Joins, set tests, histograms and reports that are one relational step each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def contained(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether the keys of a are all in b, and the other way, and how many are not. Null keys are keys."""
    side = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True)).withColumnRenamed(key, f"{name}_key")
    both = side(a, "a").join(side(b, "b"), F.col("a_key").eqNullSafe(F.col("b_key")), "full")
    n = both.agg(F.count_if(F.col("b").isNull()).alias("a_only"), F.count_if(F.col("a").isNull()).alias("b_only"))
    return n.withColumn("a_in_b", F.col("a_only") == 0).withColumn("b_in_a", F.col("b_only") == 0).withColumn("equal", F.col("a_in_b") & F.col("b_in_a"))


def rescues(base: DataFrame, middle: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """Three models on one set of keys: right only in the last one, lost by the last one, and the difference. A null
    outcome counts as neither right nor wrong."""
    told = base.select(*keys, F.lit(0).alias("_m"), "correct").unionByName(middle.select(*keys, F.lit(1).alias("_m"), "correct")).unionByName(last.select(*keys, F.lit(2).alias("_m"), "correct"))
    return _rescues(told, "_m", (0, 1, 2), keys)


def rescues_of(scored: DataFrame, models: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """`rescues` of three models whose rows stand in one table, which is read and scored once."""
    return _rescues(scored.select(*keys, F.col("model").alias("_m"), "correct"), "_m", models, keys)


def _rescues(told: DataFrame, model: str, models: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """One aggregation by key and no join, whose side might be broadcast. A key's rows of one model are counted by outcome;
    where a model has several, each meets each of the others, as in a join."""
    n = lambda name, m, flag=None: F.count_if((F.col(model) == m) & (F.lit(True) if flag is None else F.col("correct").eqNullSafe(F.lit(flag)))).alias(name)
    b, m, l = models
    known = told.where(F.col(model).isin(*models)).na.drop(subset=keys)
    j = known.groupBy(*keys).agg(n("b", b), n("b1", b, True), n("b0", b, False), n("m", m), n("m1", m, True), n("m0", m, False), n("l", l), n("l1", l, True), n("l0", l, False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    wins, hurts = total(F.col("b0") * F.col("m0") * F.col("l1")), total((F.col("b") * F.col("m") - (F.col("b") - F.col("b1")) * (F.col("m") - F.col("m1"))) * F.col("l0"))
    return j.agg(total(F.col("b") * F.col("m") * F.col("l")).alias("n"), wins.alias("rescues"), hurts.alias("hurts"), (wins - hurts).alias("net"))


def stability(scores: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Of paired scores: the largest and the mean difference, and the share whose signs agree."""
    diff = F.abs(F.col(a) - F.col(b))
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.max(diff).alias("max_abs_diff"), F.avg(diff).alias("mean_abs_diff"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("sign_match"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have each position from 0 to the largest; places that nobody has are 0."""
    counts = rows.where(F.col(column) >= 0).groupBy(F.col(column).cast("long").alias("position")).agg(F.count("*").alias("n"))
    places = counts.agg(F.max("position").alias("most")).where("most IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("position"))
    return places.join(counts, "position", "left").select("position", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def evenly_spaced(rows: DataFrame, order: str, k: int, group: str) -> DataFrame:
    """Of each group, the rows at k evenly spaced places of its order, first and last included; all of a smaller group."""
    w = Window.partitionBy(group).orderBy(order)
    placed = rows.withColumn("place", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(k - 1)))
    return placed.where((F.col("n") <= k) | F.array_contains(wanted, F.col("place"))).drop("n")


def most_common(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value. A report of k rows."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def gate(accuracy: DataFrame, split: Column, value: str, limit: float = 0.70) -> DataFrame:
    """STOP if the accuracy of the named split reaches the limit, else PASS."""
    return accuracy.where(split).withColumn("decision", F.when(F.col(value) >= limit, "STOP").otherwise("PASS"))


def id_digest(rows: DataFrame, group: str, key: str, width: int = 1000, levels: int = 3) -> DataFrame:
    """Per group: n_ids and one digest of its integer ids in order, as a tree: ids are digested by `width` neighbours (the
    id divided by it), then digests by `width`, and so on; what the last level leaves is digested as one. A group's ids are
    never in one row: a node has at most `width` parts, the top its ids' range over width ** levels. Null ids are left out."""
    parts = rows.where(F.col(key).isNotNull()).select(F.col(group), F.col(key).cast("long").alias("_k"), F.col(key).cast("string").alias("_h"), F.lit(1).cast("long").alias("_n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"]), "\n"), 256)
    for _ in range(levels):
        parts = parts.groupBy(group, F.expr(f"_k div {width}").alias("_up")).agg(joined.alias("_h"), F.sum("_n").alias("_n")).withColumnRenamed("_up", "_k")
    return parts.groupBy(group).agg(F.sum("_n").alias("n_ids"), joined.alias("id_sha256"))


def variants(rows: DataFrame, keys: list[str], name: str, fields: list[str], known: list[str]) -> DataFrame:
    """One row for each key with a struct column for each known variant, null where there is none; of several, the last
    by its fields. One aggregation, whose state is one struct for each variant."""
    of = lambda v: F.max(F.when(F.col(name) == v, F.struct(*fields))).alias(v)
    return rows.groupBy(*keys).agg(*map(of, known))


def consistency_sample(rows: DataFrame, by: str, order: str, most: int = 200) -> DataFrame:
    """Of the first `most` rows of each group in an order: how many were checked, and how many have the answer that their
    options (a map) have under answer_idx."""
    first = running(rows, [by], [order]).where(F.col("rn") <= most)
    return first.groupBy(by).agg(F.count("*").alias("n_checked"), F.count_if(F.col("options")[F.col("answer_idx")] == F.col("answer")).alias("n_equal"))


def compute_records(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: tokens a second, minutes, device hours and the greatest memory, from log rows (tokens, seconds, memory_gb)."""
    seconds = F.sum("seconds")
    return log.groupBy(*keys).agg(
        F.round(F.sum("tokens") / F.greatest(seconds, F.lit(1e-6)), 2).alias("tokens_per_sec"), F.round(seconds / 60, 3).alias("wall_clock_min"), F.round(seconds / 3600, 5).alias("gpu_hours"), F.round(F.max("memory_gb"), 3).alias("peak_vram_gb"),
    )
