"""A second computation of the metrics, by SQL over the scored answers alone, to be held against the reported ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how far the two may be apart.
TOLERANCE = 1e-12

_SQL = """
WITH b AS (SELECT model, question_id, max(evaluable) AS e, max(coalesce(correct, false)) AS c, max(answer_text) AS t FROM {scored} WHERE condition = 'mcq' GROUP BY model, question_id),
j AS (SELECT s.*, b.e AND s.evaluable AS both, CASE WHEN b.e AND s.evaluable AND s.condition <> 'mcq' THEN (CASE WHEN b.c THEN 'C' ELSE 'W' END) || (CASE WHEN coalesce(s.correct, false) THEN 'C' ELSE 'W' END) END AS k, b.t
  FROM {scored} s LEFT JOIN b ON s.model = b.model AND s.question_id = b.question_id),
a AS (SELECT condition, count(*) AS n, sum(int(parsed)) AS n_parsed, sum(int(evaluable)) AS n_evaluable, sum(int(coalesce(correct, false))) AS n_correct, sum(int(correct = false)) AS n_wrong,
  sum(int(both AND condition <> 'mcq')) AS n_pairs, sum(int(k = 'CC')) AS cc, sum(int(k = 'CW')) AS cw, sum(int(k = 'WC')) AS wc, sum(int(k = 'WW')) AS ww,
  sum(int(both AND condition <> 'mcq' AND t <> '' AND answer_text <> '')) AS known, sum(int(both AND condition <> 'mcq' AND lower(t) = lower(answer_text) AND t <> '')) AS same FROM j GROUP BY condition)
SELECT condition, double(n) AS n, double(n_parsed) AS n_parsed, double(n_evaluable) AS n_evaluable, double(n_correct) AS n_correct, double(n_pairs) AS n_pairs, double(cc) AS cc, double(cw) AS cw, double(wc) AS wc, double(ww) AS ww,
  n_parsed / nullif(n, 0) AS parse_rate, n_correct / nullif(n_evaluable, 0) AS accuracy, cc / nullif(n_pairs, 0) AS reacc, same / nullif(known, 0) AS recon, (n_correct + coalesce(n_wrong, 0)) / nullif(n_evaluable, 0) AS answered FROM a
"""


def recomputed(scored: DataFrame) -> DataFrame:
    """condition, metric, value: counts and rates found anew."""
    a = scored.sparkSession.sql(_SQL, scored=scored)
    return a.unpivot("condition", a.columns[1:], "metric", "value")


def differences(scored: DataFrame, reported: DataFrame) -> DataFrame:
    """condition, metric, independent, reported where the two are further apart than TOLERANCE, and rates of evaluable answers
    that are neither right nor wrong; empty for a sound report. Rates that are reported of some conditions only are held
    against those."""
    names = ["n", "n_parsed", "n_evaluable", "n_correct", "parse_rate", "accuracy", "n_pairs", "cc", "cw", "wc", "ww", "reacc", "recon"]
    told = reported.select("condition", *[F.col(n).cast("double").alias(n) for n in names]).unpivot("condition", names, "metric", "reported")
    j = recomputed(scored).withColumnRenamed("value", "independent").join(told, ["condition", "metric"], "left")
    answered = (F.col("metric") == "answered") & (F.coalesce("independent", F.lit(1.0)) != 1.0)
    apart = F.col("reported").isNotNull() & ~F.coalesce(F.abs(F.col("independent") - F.col("reported")) <= TOLERANCE, F.lit(False))
    lost = F.col("reported").isNull() & F.col("independent").isNotNull() & F.col("metric").isin("n", "n_parsed", "n_evaluable", "n_correct", "parse_rate", "accuracy")
    return j.where(answered | apart | lost).select("condition", "metric", "independent", "reported")
