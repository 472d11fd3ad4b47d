"""Queries of nested records, gates, the manifest and the most similar pair, over tables that grow with the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import overlap
from ..session import scratch
from ..sources import gates
from .catalog import query, t

_K = "length(coalesce(text, ''))"


def _raw(spark, d):
    """Raw records of the turns, some without a field, some broken."""
    k = F.length(F.coalesce("text", F.lit("")))
    usage = F.struct(F.when(k % 3 == 0, k % 11).alias("thoughts_token_count"), (k % 100).alias("prompt_token_count"), F.when(k % 7 != 0, k % 13).alias("candidates_token_count"), (k % 100 + k % 13 + F.when(k % 4 == 0, 5).otherwise(0)).alias("total_token_count"))
    finish = F.when(k % 5 == 0, "MAX_TOKENS").when(k % 5 < 4, "STOP")
    record = F.to_json(F.struct(F.array(F.struct(finish.alias("finish_reason"))).alias("candidates"), usage.alias("usage_metadata")))
    raw = F.when(k % 17 == 1, F.lit(None).cast("string")).when(k % 17 == 2, F.substring(record, 1, 9)).when(k % 17 == 3, F.lit("[1, 2]")).when(k % 17 == 4, F.lit("3")).when(k % 17 == 5, F.lit('"x"')).otherwise(record)
    return t(spark, d, "conversations").select("conv_id", "turn", k.alias("k"), raw.alias("raw"))


@query(f"""WITH r AS (SELECT conv_id, turn, {_K} AS k FROM conversations),
v AS (SELECT *, k % 17 BETWEEN 1 AND 5 AS odd, CASE WHEN k % 3 = 0 THEN k % 11 END AS told FROM r)
SELECT conv_id, turn, CASE k % 17 WHEN 1 THEN 'null' WHEN 2 THEN 'raw-string (not valid JSON)' WHEN 3 THEN 'json (list)' WHEN 4 THEN 'json (int)' WHEN 5 THEN 'json (str)' ELSE 'json (dict)' END AS format,
 CASE WHEN odd THEN NULL WHEN k % 5 = 0 THEN 'MAX_TOKENS' WHEN k % 5 < 4 THEN 'STOP' END AS finish_reason,
 CASE WHEN odd THEN NULL WHEN told IS NOT NULL THEN told WHEN k % 7 <> 0 AND k % 4 <> 0 THEN 0 END AS thinking_tokens,
 CASE WHEN odd THEN 'unknown' WHEN told IS NOT NULL THEN 'reported' WHEN k % 7 <> 0 AND k % 4 <> 0 THEN 'derived' ELSE 'unknown' END AS thinking_source FROM v""")
def raw_records(spark, d):
    r = _raw(spark, d).withColumn("record", records.parsed(F.col("raw")))
    tokens = records.thinking_tokens(F.col("record"))
    return r.select("conv_id", "turn", records.tagged(F.col("raw"))["format"].alias("format"), records.finish_reason(F.col("record")).alias("finish_reason"), tokens["tokens"].alias("thinking_tokens"), tokens["source"].alias("thinking_source"))


@query(f"""WITH r AS (SELECT conv_id, turn, role, {_K} AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k % 19 <> 0 THEN 'set::' || conv_id END AS question_id, CASE WHEN k % 2 = 0 THEN 4 ELSE 0 END::INTEGER AS n_options, k % 6 <> 0 AS options_displayed,
 CASE WHEN k % 3 = 0 THEN 'A' WHEN k % 3 = 1 THEN 'B,C,D' ELSE '' END AS gold, CASE WHEN k % 3 = 0 THEN 0 END::INTEGER AS gold_index,
 concat_ws(',', CASE WHEN k % 19 = 0 THEN 'question_id' END, CASE WHEN k % 23 = 0 THEN 'question' END) AS missing FROM r""")
def reconstructed_examples(spark, d):
    k = F.length(F.coalesce("text", F.lit("")))
    four = F.array(*map(F.lit, "ABCD"))
    fields = [
        F.when(k % 19 != 0, F.concat(F.lit("set::"), "conv_id")).alias("question_id"), F.lit("set").alias("source_dataset"), F.col("conv_id").cast("string").alias("source_id"), F.lit("mcq").alias("condition"),
        F.when(k % 23 != 0, F.lit("What?")).alias("question"), F.when(k % 2 == 0, four).alias("option_labels"), F.when(k % 6 == 0, F.lit(False)).alias("options_displayed"),
    ]
    one = F.to_json(F.struct(*fields, F.when(k % 3 == 0, F.lit("A")).alias("gold_label"), F.when(k % 3 == 0, F.lit(0)).alias("gold_index")))
    several = F.to_json(F.struct(*fields, F.array(*map(F.lit, "BCD")).alias("gold_label")))
    raw = t(spark, d, "conversations").select("conv_id", "turn", F.when(k % 3 == 1, several).otherwise(one).alias("raw")).withColumn("record", records.parsed(F.col("raw")))
    e = raw.select("conv_id", "turn", records.example(F.col("record"), strict=False).alias("e"))
    return e.select("conv_id", "turn", "e.question_id", F.size("e.option_labels").alias("n_options"), "e.options_displayed", F.array_join("e.gold_labels", ",").alias("gold"), "e.gold_index", F.array_join("e.missing", ",").alias("missing"))


@query(f"""WITH r AS (SELECT {_K} AS k FROM conversations), m AS (SELECT count(*) AS n, count(*) FILTER (k % 211 = 0) AS n_failed, count(*) FILTER (k % 29 = 0) AS n_truncated, count(*) FILTER (k % 31 = 0) AS n_unparsed FROM r)
SELECT stage, condition, message FROM (
 SELECT CAST(s AS INTEGER) AS stage, 'provider' AS condition, n_failed || ' provider failures' AS message FROM m, unnest([1, 2, 3]) AS x(s) WHERE n_failed > 0
 UNION ALL SELECT CAST(s AS INTEGER), 'truncation', n_truncated || ' truncations in stage ' || s FROM m, unnest([1, 2]) AS x(s) WHERE n_truncated > 0
 UNION ALL SELECT 3, 'truncation', 'truncation rate ' || format('{{:.1f}}', 100.0 * n_truncated / n) || '% > 2%' FROM m WHERE n_truncated > 0.02 * n
 UNION ALL SELECT CAST(s AS INTEGER), 'parse', 'parse failures in stage ' || s || ': ' || n_unparsed FROM m, unnest([1, 2]) AS x(s) WHERE n_unparsed > 0)""")
def stop_conditions(spark, d):
    """The responses are written once, with what the stop conditions of each stage look at observed on the way."""
    k = F.length(F.coalesce("text", F.lit("")))
    rows = t(spark, d, "conversations").select("conv_id", "turn", (k % 211 == 0).alias("api_error"), (k % 29 == 0).alias("truncated"), (k % 31 != 0).alias("parsed"))
    seen = gates.publish(rows, scratch(spark, "gated"), gates.response_metrics(), [])
    found = [(stage, name, message) for stage in (1, 2, 3) for name, message in gates.failures(seen, gates.stop_conditions(stage))]
    return spark.createDataFrame(found, "stage int, condition string, message string")


_COLUMNS = ["doc_id", "text", "lang", "n_chars"]
_CELLS = " UNION ALL ".join(f"SELECT source AS split, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM documents" for c in _COLUMNS) + " UNION ALL " + " UNION ALL ".join(f"SELECT source, 'options.{x}', string_split(text, ' ')[{i + 1}] FROM documents" for i, x in enumerate("ABCD"))


@query(f"""WITH c AS (SELECT coalesce(split, '') AS split, "column", v FROM ({_CELLS})), g AS (SELECT split, "column", v FROM c UNION ALL SELECT NULL, "column", v FROM c), u AS (SELECT split, "column", v, count(*) AS n FROM g GROUP BY ALL)
SELECT split, "column", CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_null, CAST(coalesce(sum(n) FILTER (trim(v) = ''), 0) AS BIGINT) AS n_blank, count(v) AS n_unique, count(*) FILTER (v IS NOT NULL AND n > 1) AS n_repeated FROM u GROUP BY split, "column" """)
def dataset_manifest(spark, d):
    w = F.split("text", " ")
    rows = t(spark, d, "documents").withColumn("options", F.struct(*[F.get(w, i).alias(x) for i, x in enumerate("ABCD")]))
    return overlap.manifest(rows, "source", _COLUMNS, {"options": list("ABCD")})


@query("""WITH d AS (SELECT conv_id AS id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_ßà-öø-ÿ]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM conversations WHERE role = 'system' AND turn = 0 AND conv_id IS NOT NULL),
p AS (SELECT a.id AS x, b.id AS y, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) END AS j FROM d a JOIN d b ON a.id < b.id),
m AS (SELECT * FROM p ORDER BY j DESC, x, y LIMIT 1)
SELECT (SELECT count(*) FROM p) AS n_pairs, round(coalesce((SELECT avg(j) FROM p), 0), 9) AS mean_j, round(coalesce((SELECT j FROM m), 0), 9) AS max_j, (SELECT CAST(x AS VARCHAR) FROM m) AS first_id, (SELECT CAST(y AS VARCHAR) FROM m) AS second_id, coalesce((SELECT j FROM m), 0) <= 0.9 AS passes""")
def cross_similarity(spark, d):
    """Over the conversations' opening instructions."""
    c = t(spark, d, "conversations").where("role = 'system' AND turn = 0 AND conv_id IS NOT NULL").select(F.col("conv_id").alias("id"), "text")
    r = overlap.cross_similarity(c)
    return r.withColumn("mean_j", F.round("mean_j", 9)).withColumn("max_j", F.round("max_j", 9))
