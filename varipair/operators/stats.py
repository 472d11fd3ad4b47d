"""Paired tests as declarative aggregates: McNemar, and bootstraps of rows and of clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.scoring import ADAPTATION, INVARIANCE


#: An odd factor below 2 ** 31 that mixes well.
MIXER = 1_935_289_751


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b successes in b + c fair draws: twice the lower tail, built as a running product."""
    n, k = b + c, F.least(b, c)
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("total"))
    step = lambda acc, i: F.struct((acc["term"] * (n - i + 1) / i).alias("term"), (acc["total"] + acc["term"] * (n - i + 1) / i).alias("total"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step)["total"]
    return F.least(F.lit(1.0), 2 * tail)


@F.udf(DoubleType())
def chi2_tail(x: float | None) -> float | None:
    """Upper tail of chi squared with one degree of freedom; for result rows only."""
    return None if x is None else math.erfc(math.sqrt(x / 2))


def discordance(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counts of (a, b) booleans: both, a_only, b_only, neither. Null is false."""
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"))


def mcnemar(pairs: DataFrame, *keys: str, exact_below: int = 25) -> DataFrame:
    """Per key: the 2 x 2 table, discordant pairs, test_type, statistic, p_value and its flags. Few discordant pairs get
    the exact binomial test, whose statistic is b_only (0 if there are none); others the corrected chi squared."""
    t = discordance(pairs, *keys)
    m = F.col("a_only") + F.col("b_only")
    few = m < exact_below
    exact = binomial_two_sided(F.col("a_only").cast("int"), F.col("b_only").cast("int"))
    stat = F.when(few, F.col("b_only").cast("double") * (m > 0).cast("double")).otherwise(F.pow(F.abs(F.col("a_only") - F.col("b_only")) - 1.0, F.lit(2)) / m)
    t = t.withColumn("discordant", m).withColumn("test_type", F.when(few, "exact_binomial").otherwise("mcnemar_continuity_corrected")).withColumn("statistic", stat)
    t = t.withColumn("p_value", F.when(m == 0, 1.0).when(few, exact).otherwise(chi2_tail("statistic")))
    t = t.withColumn("significant_at_05", F.col("p_value") < 0.05).withColumn("significant_at_01", F.col("p_value") < 0.01)
    return t.withColumn("statistic", F.round("statistic", 4)).withColumn("p_value", F.round("p_value", 6))


#: Least 31-bit numbers that give one more than 0, 1, 2, ... in a Poisson variate of mean 1.
POISSON = [int((1 << 31) * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]
#: Units whose weights a task holds at once.
UNITS = 512


def bootstrap(values: DataFrame, key: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of sum(d) / sum(w) when units (rows with w = 1, or clusters) are drawn anew. A unit counts in
    replicate b a Poisson number of times (mean 1) that is a mixing hash of (seed, b, its integer `key`), so draws need no
    numbering of the units, no shuffle and no row each: a task adds its units' weights to two sums per replicate."""
    # Closed over by value, so workers need not import this module.
    factor, steps, units = MIXER, list(POISSON), UNITS

    def draws(batches):
        import pyarrow as pa

        def scattered(x):
            for _ in range(2):
                x = (x ^ (x >> 15)) * factor % (1 << 31)
            return x ^ (x >> 15)

        start = scattered(np.arange(replicates, dtype=np.int64) * 7919 % (1 << 31) ^ seed)
        d, w = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            k, x, y = (np.asarray(batch.column(c)) for c in range(3))
            for at in range(0, len(k), units):
                u = scattered(start[:, None] ^ scattered(k[at : at + units] % (1 << 31))[None, :])
                times = np.searchsorted(steps, u, side="right").astype(float)
                d += times @ x[at : at + units]
                w += times @ y[at : at + units]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(d), pa.array(w)], names=["b", "d", "w"])

    rows = values.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)), F.col("d").cast("double"), F.col("w").cast("double")).where("d IS NOT NULL AND w IS NOT NULL")
    per = rows.mapInArrow(draws, "b long, d double, w double").groupBy("b").agg(F.try_divide(F.sum("d"), F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return per.agg(F.count("*").alias("replicates"), q.alias("q"), F.stddev_pop("m").alias("se"), F.avg("m").alias("mean")).select("replicates", F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"), "se", "mean")


def of_both(scored: DataFrame, a: int, b: int, flags: dict[str, Column]) -> DataFrame:
    """question_id, condition and flags of two models side by side (name_a, name_b; null is false) where both answered.
    One aggregation in place of a join, so the rows are scored once."""
    of = lambda m, flag: F.coalesce(F.bool_or(F.when(F.col("model") == m, flag)), F.lit(False))
    here = [F.count_if(F.col("model") == m) > 0 for m in (a, b)]
    g = scored.where(F.col("model").isin(a, b) & F.col("question_id").isNotNull()).groupBy("question_id", "condition")
    return g.agg((here[0] & here[1]).alias("_both"), *[of(m, flag).alias(f"{name}_{side}") for name, flag in flags.items() for side, m in (("a", a), ("b", b))]).where("_both").drop("_both")


def compare_models(scored: DataFrame, a: int, b: int) -> DataFrame:
    """Per scope (all, and each condition): McNemar of two models' right answers. Scopes are rows, not passes."""
    both = of_both(scored, a, b, {"right": F.col("correct")})
    return mcnemar(both.select(F.explode(F.array(F.lit("all"), "condition")).alias("scope"), F.col("right_a").alias("a"), F.col("right_b").alias("b")), "scope")


@F.pandas_udf(ArrayType(DoubleType()))
def _resampled(n: pd.Series, a_only: pd.Series, b_only: pd.Series, replicates: pd.Series, seed: pd.Series) -> pd.Series:
    out = []
    for total, a, b, times, start in zip(n, a_only, b_only, replicates, seed, strict=True):
        drawn = np.random.default_rng([start, total, a, b]).multinomial(total, [a / total, b / total, (total - a - b) / total], size=times) if total else None
        out.append(None if drawn is None else (drawn[:, 1] - drawn[:, 0]) / total)
    return pd.Series(out)


def paired_bootstrap(counts: DataFrame, key: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """counts (key, n, a_only, b_only and more, few rows) with percentile interval, error and empirical p of the mean of
    b - a when the n rows of paired right/wrong outcomes are drawn with replacement. Only the three counts matter, and those
    of a replicate are one multinomial draw, whatever n is. For other outcomes, `bootstrap` takes rows with w = 1."""
    lit = lambda x: F.lit(x).cast("long")
    each = counts.select(F.col(key), F.struct("*").alias("_row"), F.explode_outer(_resampled("n", "a_only", "b_only", lit(replicates), lit(seed))).alias("m"))
    q, share = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))), lambda c: F.avg(c.cast("double"))
    per = each.groupBy(key).agg(F.first("_row").alias("_row"), F.count("m").alias("replicates"), q.alias("q"), F.stddev_pop("m").alias("std_error"), (2 * F.least(share(F.col("m") <= 0), share(F.col("m") >= 0))).alias("p"))
    lo, hi = F.get("q", 0), F.get("q", 1)
    p = F.when(F.col("replicates") > 0, F.least(F.lit(1.0), F.greatest(1 / F.col("replicates"), "p")))
    return per.select("_row.*", "replicates", lo.alias("ci_lower"), hi.alias("ci_upper"), "std_error", p.alias("p_empirical"), ((lo > 0) | (hi < 0)).alias("excludes_zero"))


def compared_outcomes(compared: DataFrame, a: int, b: int) -> DataFrame:
    """Per scope (adaptation success and failure, invariance, each condition): McNemar, rates and their difference."""
    flags = {"right": F.col("correct"), "success": F.col("adaptation") == "successful_adaptation", "failure": F.col("adaptation").startswith("failure"), "paired": F.col("paired")}
    c = F.col("condition")
    rows = of_both(compared, a, b, flags).withColumn("kept", F.col("paired_a") & F.col("paired_b"))
    scope = lambda when, name, flag: F.when(when, F.struct(name.alias("scope"), F.col(f"{flag}_a").alias("a"), F.col(f"{flag}_b").alias("b")))
    inverted = F.col("kept") & c.isin(*ADAPTATION)
    each = F.array_compact(F.array(scope(F.lit(True), c, "right"), scope(F.col("kept") & c.isin(*INVARIANCE), F.lit("invariance"), "right"), scope(inverted, F.lit("adaptation_success"), "success"), scope(inverted, F.lit("adaptation_failure"), "failure")))
    t = mcnemar(rows.select(F.inline(each)), "scope")
    rate = lambda only: (F.col("both") + F.col(only)) / F.col("n")
    t = t.withColumn("rate_a", rate("a_only")).withColumn("rate_b", rate("b_only")).withColumn("delta", (F.col("b_only") - F.col("a_only")) / F.col("n"))
    return t.withColumn("relative_reduction_pct", F.when(F.col("scope") == "adaptation_failure", (F.col("rate_a") - F.col("rate_b")) / (F.col("rate_a") + 1e-9) * 100))


def comparison_report(compared: DataFrame, a: int, b: int) -> DataFrame:
    """`compared_outcomes` with bootstraps."""
    return paired_bootstrap(compared_outcomes(compared, a, b), "scope")
