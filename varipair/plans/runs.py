"""Queries of the response cache and of runs with a ceiling, over `conversations`: a conversation is a run, a turn a
request. The model is arithmetic on the prompt's length, so that SQL can say what a run must do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import cache
from ..streaming import runner
from .catalog import query, t

CEILING, CONFIG = 5.0, "c0ffee5eed"


def _requests(spark, d) -> DataFrame:
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    question = F.concat(F.lit("c"), "conv_id", F.lit("::"), F.md5(text))
    return t(spark, d, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("seq"), question.alias("question_id"), role.alias("condition"), text.alias("prompt"))


def _adapter():
    def generate(request, attempt: int) -> tuple[str, float]:
        k = len(request["prompt"])
        if k % 50 == 7 or (k % 10 == 3 and attempt == 1):
            raise TimeoutError("busy")
        return f"a{k}", k % 13 * 0.25

    return generate


_REQUESTS = """r AS (SELECT run_id, seq, q, c, k, row_number() OVER (PARTITION BY run_id ORDER BY seq, q, c) AS n FROM
 (SELECT CAST(conv_id AS VARCHAR) AS run_id, turn AS seq, 'c' || conv_id || '::' || md5(coalesce(text, '')) AS q, coalesce(role, '') AS c, length(coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL))"""


def _run_sql(name: str, source: str, hit: str) -> str:
    """CTEs whose last, `name`, has what a run over `source` does where `hit` says that an answer is cached."""
    return f"""{name}1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, q, c ORDER BY n) > 1 AS dup, {hit} AS hit FROM {source}),
{name}2 AS (SELECT *, CASE WHEN NOT dup AND NOT hit AND k % 50 <> 7 THEN k % 13 * 0.25 ELSE 0 END AS would FROM {name}1),
{name}3 AS (SELECT *, sum(would) OVER (PARTITION BY run_id ORDER BY n ROWS UNBOUNDED PRECEDING) - would AS before FROM {name}2),
{name} AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN hit THEN 'cached' WHEN before >= {CEILING} THEN 'stopped' WHEN k % 50 = 7 THEN 'failed' ELSE 'called' END AS status,
 CAST(sum(CASE WHEN before < {CEILING} THEN would ELSE 0 END) OVER (PARTITION BY run_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM {name}3)"""


@query(f"""WITH {_REQUESTS}, {_run_sql("o", "r", "k % 7 = 0")}
SELECT run_id, seq, status, CASE status WHEN 'called' THEN CASE WHEN k % 10 = 3 THEN 2 ELSE 1 END WHEN 'failed' THEN 2 ELSE 0 END AS attempts,
 CASE WHEN status = 'called' THEN CAST(would AS DOUBLE) END AS cost_usd, spent AS spent_usd FROM o""")
def run_with_ceiling(spark, d):
    requests = _requests(spark, d).withColumn("cached", F.when(F.length("prompt") % 7 == 0, F.lit("c")))
    return runner.run(requests, _adapter(), CEILING).select("run_id", "seq", "status", "attempts", "cost_usd", "spent_usd")


@query(f"""WITH {_REQUESTS}, {_run_sql("o", "r", "FALSE")}, h AS (SELECT DISTINCT q, c FROM o WHERE status = 'called'),
r2 AS (SELECT r.*, h.q IS NOT NULL AS known FROM r LEFT JOIN h ON r.q = h.q AND r.c = h.c), {_run_sql("p", "r2", "known")}
SELECT run_id, count(*) AS n_expected, count(*) FILTER (status = 'called') AS n_called, count(*) FILTER (status = 'cached') AS n_cached, count(*) FILTER (status = 'failed') AS n_failed,
 count(*) FILTER (status = 'stopped') AS n_stopped, count(*) FILTER (status = 'duplicate') AS n_duplicate,
 CAST(count(*) FILTER (status = 'failed' OR (status = 'called' AND k % 10 = 3)) AS BIGINT) AS n_retries, CAST(coalesce(sum(would) FILTER (status = 'called'), 0) AS DOUBLE) AS new_cost_usd FROM p GROUP BY run_id""")
def resumed_run(spark, d):
    """A run that the ceiling stopped, its answers put into the cache, and the totals of the run that resumes it."""
    path, requests = scratch(spark, "responses"), _requests(spark, d)
    first = runner.run(requests.withColumn("cached", F.lit(None).cast("string")), _adapter(), CEILING)
    runner.to_cache(first, requests, path, CONFIG, "v1")
    again = cache.lookup(requests, path, CONFIG).withColumnRenamed("response", "cached")
    return runner.totals(runner.run(again, _adapter(), CEILING))


@query("""WITH r AS (SELECT CAST(conv_id AS VARCHAR) || '#' || turn AS q, coalesce(role, '') AS c, coalesce(text, '') AS p FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
w AS (SELECT q, c, length(p) % 3 <> 0 AS a, length(p) % 5 = 0 AS b, CAST(length(p) AS VARCHAR) AS k FROM r),
k AS (SELECT q, c, max('second ' || k) FILTER (b) AS b, max('first ' || k) FILTER (a) AS a FROM w GROUP BY q, c)
SELECT w.c AS condition, count(*) AS n_requests, count(*) FILTER (k.a IS NOT NULL OR k.b IS NOT NULL) AS n_hits, count(*) FILTER (k.b IS NOT NULL) AS n_replaced,
 CAST(coalesce(sum(length(coalesce(k.b, k.a))), 0) AS BIGINT) AS n_characters FROM w JOIN k ON k.q = w.q AND k.c = w.c GROUP BY w.c""")
def response_cache(spark, d):
    """Two writes into the cache, the second of which replaces some records, and the lookup of all requests."""
    path = scratch(spark, "responses")
    text = F.coalesce("text", F.lit(""))
    rows = t(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.concat("conv_id", F.lit("#"), "turn").alias("question_id"), F.coalesce("role", F.lit("")).alias("condition"), F.lit("v1").alias("prompt_version"), F.lit("p").alias("prompt"), F.length(text).alias("k"))
    answer = lambda name: F.concat(F.lit(f"{name} "), "k").alias("response")
    cache.put(rows.where("k % 3 <> 0").select("*", answer("first")), path, CONFIG)
    cache.put(rows.where("k % 5 = 0").select("*", answer("second")), path, CONFIG)
    found = cache.lookup(rows, path, CONFIG)
    return found.groupBy("condition").agg(F.count("*").alias("n_requests"), F.count("response").alias("n_hits"), F.count_if(F.col("response").startswith("second")).alias("n_replaced"), F.coalesce(F.sum(F.length("response")), F.lit(0)).alias("n_characters"))
