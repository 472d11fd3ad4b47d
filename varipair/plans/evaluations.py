"""Queries of a whole evaluation and of the smaller operators about it, over tables that grow with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import orchestrate, relational
from ..session import scratch
from .catalog import query, t

_WORDS = ["alpha", "bravo", "charlie", "delta"]
_LETTERS, _ROMAN = list("ABCD"), ["I", "II", "III", "IV"]


def _arr(xs):
    return F.array(*map(F.lit, xs))


def _examples(spark, d) -> DataFrame:
    """Each conversation is a question in all conditions; the prompt ends with what the model is to answer."""
    rows = t(spark, d, "conversations").where("conv_id IS NOT NULL").select("conv_id").distinct().select("conv_id", F.posexplode(_arr(S.CONDITIONS)).alias("ci", "condition"))
    rows = rows.withColumn("g", F.pmod(F.col("conv_id") + F.col("ci"), F.lit(4)).cast("int")).withColumn("s", F.pmod(F.col("conv_id") * 3 + F.col("ci") * F.col("ci"), F.lit(5)).cast("int"))
    hidden, labels = F.col("condition").isin("open", "no_symbols"), F.when(F.col("condition") == "roman_numeral", _arr(_ROMAN)).otherwise(_arr(_LETTERS))
    others = lambda i: F.filter(F.sequence(F.lit(0), F.lit(3)), lambda x: x != i)
    wrong = F.col("condition") == "incorrect"
    example = F.to_json(F.struct(
        F.concat(F.lit("set::"), "conv_id").alias("question_id"), F.lit("set").alias("source_dataset"), F.col("conv_id").cast("string").alias("source_id"), "condition", F.lit("Which?").alias("question"),
        F.when(~hidden, labels).alias("option_labels"), _arr(_WORDS).alias("option_texts"), F.when(~wrong, F.col("g")).alias("gold_index"), F.when(wrong, others(F.col("g"))).alias("gold_indices"),
    ))
    given = (
        F.when(hidden, F.concat(F.lit('{"answer": "'), F.coalesce(F.get(_arr(_WORDS), F.col("s")), F.lit("zebra")), F.lit('"}')))
        .when(F.col("s") == 4, F.lit("no idea")).when(wrong, F.concat(F.lit('{"answer": '), F.to_json(F.transform(others(F.col("s")), lambda i: F.get(labels, i))), F.lit("}")))
        .otherwise(F.concat(F.lit('{"answer": "'), F.get(labels, F.col("s")), F.lit('"}')))
    )
    return rows.select(F.concat(F.lit("run"), F.pmod("conv_id", F.lit(64))).alias("run_id"), (F.col("conv_id") * 7 + F.col("ci")).alias("seq"), F.concat(F.lit("set::"), "conv_id").alias("question_id"), "condition", F.concat(F.lit("Which? "), given).alias("prompt"), example.alias("example_json"))


def _adapter():
    def generate(request, attempt: int) -> tuple[str, float]:
        if request["seq"] % 10 == 3 and attempt == 1:
            raise TimeoutError("busy")
        return request["prompt"][7:], 0.25

    return generate


@query(f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), x AS (SELECT conv_id, unnest(range(0, 7)) AS ci FROM c),
v AS (SELECT conv_id, {S.CONDITIONS}[ci + 1] AS condition, (conv_id + ci) % 4 AS g, (conv_id * 3 + ci * ci) % 5 AS s FROM x),
e AS (SELECT *, s < 4 OR condition IN ('open', 'no_symbols') AS parsed, s < 4 OR condition = 'no_symbols' AS evaluable, CASE WHEN s < 4 OR condition = 'no_symbols' THEN s = g END AS correct FROM v),
p AS (SELECT e.*, m.evaluable AND e.evaluable AND e.condition <> 'mcq' AS pair, m.correct AS mc FROM e JOIN e m ON m.conv_id = e.conv_id AND m.condition = 'mcq')
SELECT condition, count(*) AS n, count(*) FILTER (parsed) AS n_parsed, count(*) FILTER (evaluable) AS n_evaluable, count(*) FILTER (correct) AS n_correct, count(*) FILTER (correct) / nullif(CAST(count(*) FILTER (evaluable) AS DOUBLE), 0) AS accuracy,
 CASE WHEN condition <> 'mcq' THEN count(*) FILTER (pair) END AS n_pairs, CASE WHEN condition <> 'mcq' THEN count(*) FILTER (pair AND mc AND correct) END AS cc, CASE WHEN condition <> 'mcq' THEN count(*) FILTER (pair AND mc AND NOT correct) END AS cw,
 CASE WHEN condition <> 'mcq' THEN count(*) FILTER (pair AND NOT mc AND correct) END AS wc, CASE WHEN condition <> 'mcq' THEN count(*) FILTER (pair AND NOT mc AND NOT correct) END AS ww, count(*) * 0.25::DOUBLE AS cost_usd FROM p GROUP BY condition""")
def evaluate_policy(spark, d):
    """Every conversation's question in seven conditions: cache, run, gates, published responses, metrics."""
    config = orchestrate.config_hash("none", "echo", {"temperature": 0}, "v1")
    e = orchestrate.evaluate_policy(_examples(spark, d), _adapter(), scratch(spark, "responses"), config, 1e9, scratch(spark, "published"))
    return e.by_condition.select("condition", "n", "n_parsed", "n_evaluable", "n_correct", "accuracy", "n_pairs", "cc", "cw", "wc", "ww", "cost_usd")


@query("""SELECT conv_id, max(md5(coalesce(text, ''))) FILTER (role = 'system') AS system_md5, max(md5(coalesce(text, ''))) FILTER (role = 'user') AS user_md5, max(md5(coalesce(text, ''))) FILTER (role = 'assistant') AS assistant_md5 FROM conversations GROUP BY conv_id""")
def conversation_variants(spark, d):
    """The variants of each conversation side by side: one struct for each role, the last by its digest."""
    rows = t(spark, d, "conversations").withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    v = relational.variants(rows, ["conv_id"], "role", ["h"], ["system", "user", "assistant"])
    return v.select("conv_id", *[F.col(f"{r}.h").alias(f"{r}_md5") for r in ("system", "user", "assistant")])


@query("""WITH r AS (SELECT source, doc_id, string_split(coalesce(text, ''), ' ') AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT source, count(*) AS n_checked, count(*) FILTER (CASE WHEN doc_id % 3 = 0 THEN w[1] = w[2] ELSE w[1] IS NOT NULL END) AS n_equal FROM r WHERE rn <= 200 GROUP BY source""")
def consistency_samples(spark, d):
    """Whether the first 200 documents' answers, their first words, are what their options have; in a third the index is off."""
    w = F.split(F.coalesce("text", F.lit("")), " ")
    options = F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(F.get(w, 0), F.get(w, 1)))
    rows = t(spark, d, "documents").select("source", "doc_id", options.alias("options"), F.get(w, 0).alias("answer"), F.when(F.col("doc_id") % 3 == 0, "B").otherwise("A").alias("answer_idx"))
    return relational.consistency_sample(rows, "source", "doc_id")


@query("""SELECT role, round(sum(length(coalesce(text, ''))) / greatest(sum(turn + 1), 1e-6), 2) AS tokens_per_sec, round(sum(turn + 1) / 60, 3) AS wall_clock_min, round(sum(turn + 1) / 3600, 5) AS gpu_hours, round(max(length(coalesce(text, '')) / 1024), 3) AS peak_vram_gb FROM conversations GROUP BY role""")
def compute_records(spark, d):
    """A conversation log as a run log: characters as tokens, turns as seconds."""
    n = F.length(F.coalesce("text", F.lit("")))
    log = t(spark, d, "conversations").select("role", n.alias("tokens"), (F.col("turn") + 1).alias("seconds"), (n / 1024).alias("memory_gb"))
    return relational.compute_records(log, ["role"])
