"""Queries of responses to examples with their own options, over `conversations`: a turn's length gives the condition, how
many options there are, which is right and which is answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import evaluate
from .catalog import query, t

_WORDS = ["alpha", "bravo", "charlie", "delta", "echo"]
_LETTERS, _ROMAN = list("ABCDE"), ["I", "II", "III", "IV", "V"]


def _arr(xs):
    return F.array(*map(F.lit, xs))


def _rows(spark, d) -> DataFrame:
    k = F.length(F.coalesce("text", F.lit("")))
    rows = t(spark, d, "conversations").select("conv_id", "turn", k.alias("k"), F.get(_arr(S.CONDITIONS), (k % 7).cast("int")).alias("condition"), (F.lit(2) + k % 4).cast("int").alias("n"))
    rows = rows.withColumn("g", F.expr("CAST(k div 7 % n AS INT)")).withColumn("s", F.expr("CAST(k div 3 % (n + 1) AS INT)"))
    labels = F.slice(F.when(F.col("condition") == "roman_numeral", _arr(_ROMAN)).otherwise(_arr(_LETTERS)), F.lit(1), F.col("n"))
    hidden = F.col("condition").isin(evaluate.FREE)
    rows = rows.withColumn("labels", F.when(~hidden, labels)).withColumn("texts", F.slice(_arr(_WORDS), F.lit(1), F.col("n")))
    others = lambda i: F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda x: x != i)
    golds = F.when(F.col("condition") == "incorrect", others(F.col("g")))
    example = F.to_json(F.struct(
        F.concat(F.lit("set::"), "conv_id").alias("question_id"), F.lit("set").alias("source_dataset"), F.col("conv_id").cast("string").alias("source_id"), "condition", F.lit("Which?").alias("question"),
        F.col("labels").alias("option_labels"), F.col("texts").alias("option_texts"), F.when(F.col("condition") != "incorrect", F.col("g")).alias("gold_index"), golds.alias("gold_indices"),
    ))
    given = (
        F.when(hidden, F.concat(F.lit('{"answer": "The '), F.coalesce(F.get("texts", F.col("s")), F.lit("zebra")), F.lit('"}')))
        .when(F.col("s") == F.col("n"), F.lit("no idea"))
        .when(F.col("condition") == "incorrect", F.concat(F.lit('{"answer": '), F.to_json(F.transform(others(F.col("s")), lambda i: F.get("labels", i))), F.lit("}")))
        .when(F.col("k") % 2 == 0, F.concat(F.lit('```json\n{"answer": "'), F.get("labels", F.col("s")), F.lit('"}\n```')))
        .otherwise(F.concat(F.lit('{"answer": "'), F.get("labels", F.col("s")), F.lit('"}')))
    )
    chat = F.array(F.struct(F.lit("user").alias("role"), F.lit("Which?").alias("content")), F.struct(F.lit("assistant").alias("role"), given.alias("content")))
    return rows.select("conv_id", "turn", example.alias("example_json"), chat.alias("completion"))


_ROWS = f"""r AS (SELECT conv_id, turn, length(coalesce(text, '')) AS k FROM conversations), r1 AS (SELECT *, {S.CONDITIONS}[k % 7 + 1] AS condition, 2 + k % 4 AS n FROM r),
r2 AS (SELECT *, k // 7 % n AS g, k // 3 % (n + 1) AS s, condition IN ('open', 'no_symbols') AS hidden FROM r1),
v AS (SELECT *, s < n OR hidden AS parse_success, s < n OR condition = 'no_symbols' AS evaluable, CASE WHEN s < n OR condition = 'no_symbols' THEN s = g END AS correct FROM r2)"""


@query(f"""WITH {_ROWS} SELECT conv_id, turn, condition, parse_success, evaluable, correct, CASE WHEN NOT parse_success THEN 'no valid label found' END AS parse_failure_reason,
 CASE WHEN s < n AND condition <> 'incorrect' THEN CAST(s AS INTEGER) END AS selected_option_index, CASE WHEN s < n AND condition = 'incorrect' THEN CAST(s AS INTEGER) END AS implied_option_index,
 CASE WHEN s < n THEN {_WORDS}[CAST(s + 1 AS INTEGER)] END AS selected_option_text,
 CASE WHEN NOT parse_success THEN NULL WHEN hidden THEN CASE WHEN s < n THEN 'option_in_answer' ELSE 'no_match' END WHEN condition = 'incorrect' THEN 'label_set' ELSE 'label' END AS match_method FROM v WHERE condition <> 'incorrect' OR s < n
UNION ALL SELECT conv_id, turn, condition, FALSE, FALSE, NULL, 'response not valid JSON answer object', NULL, NULL, NULL, NULL FROM v WHERE condition = 'incorrect' AND s = n""")
def evaluated_responses(spark, d):
    e = evaluate.evaluated(evaluate.with_examples(_rows(spark, d), "example_json", "completion"))
    return e.select("conv_id", "turn", "example.condition", "parse_success", "evaluable", "correct", "parse_failure_reason", "selected_option_index", "implied_option_index", "selected_option_text", "match_method")


@query(f"""WITH {_ROWS}, w AS (SELECT *, CASE WHEN condition = 'open' THEN 0.0 WHEN coalesce(correct, FALSE) THEN 1.0 ELSE 0.0 END::DOUBLE AS rc,
 CASE WHEN condition = 'open' THEN 0.0 WHEN coalesce(correct, FALSE) THEN 1.0 WHEN NOT parse_success THEN 0.0 WHEN condition IN ('mcq', 'incorrect') THEN 0.5 WHEN condition IN ('roman_numeral', 'fixed_pos') OR (condition = 'no_symbols' AND s < n) THEN 0.25 ELSE 0.0 END::DOUBLE AS rs,
 CASE WHEN hidden THEN 1.0 WHEN s = n THEN 0.0 WHEN condition <> 'incorrect' AND k % 2 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS rf FROM v)
SELECT conv_id, turn, rc AS reward_correct, 0.5 * rs AS reward_symbolic, rf AS reward_format, rc + 0.5 * rs + 0.1 * rf AS reward_neurosymbolic FROM w""")
def batch_rewards(spark, d):
    return evaluate.batch_rewards(_rows(spark, d), list(evaluate.REWARDS), weight=0.5)
