"""Named queries over the driver's tables and the SQL that states the same result.

Inputs that the tables do not hold (questions, answers of models) are derived from `part` by arithmetic; see
``operators.items.items_from_parts``. The SQL derives results from that arithmetic, not from the rendered answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import scoring as S
from ..functions import text as T
from ..operators import counterfactual, graph, items, metrics, overlap, recompute, relational, splits, stats
from ..operators import descriptives as enriching

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored(spark, d, multipliers=(31,)) -> DataFrame:
    return items.score(items.items_from_parts(t(spark, d, "part"), multipliers))


def long(c):
    return c.cast("long")


# ---- the answer grid in SQL ------------------------------------------------------------------------------------

GRID = """
conds(ci, condition) AS (VALUES (0,'mcq'),(1,'roman_numeral'),(2,'none_of_the_provided'),(3,'fixed_pos'),(4,'incorrect'),(5,'open'),(6,'no_symbols')),
models(model, k) AS (VALUES (0,31),(1,37)),
g0 AS (SELECT model, p_partkey AS question_id, p_type AS source_dataset, ci, condition,
        CASE WHEN condition='fixed_pos' THEN 3 ELSE (p_partkey*7+3) % 4 END AS gold, (p_partkey*k + ci*17 + p_size*(ci+3)) % 97 AS r
       FROM part CROSS JOIN conds CROSS JOIN models),
g AS (SELECT *, CASE WHEN r<6 THEN 4 WHEN r<60 THEN gold ELSE (gold+1+r%3) % 4 END AS sel FROM g0),
s AS (SELECT model, question_id, source_dataset, condition, gold, sel,
        (sel<4 OR condition IN ('open','no_symbols')) AS parsed,
        (sel<4 OR condition='no_symbols') AS evaluable,
        CASE WHEN sel<4 OR condition='no_symbols' THEN sel=gold END AS correct,
        CASE WHEN sel<4 THEN sel END AS answer,
        CASE sel WHEN 0 THEN 'alpha' WHEN 1 THEN 'bravo' WHEN 2 THEN 'charlie' WHEN 3 THEN 'delta' END AS answer_text FROM g),
p AS (SELECT x.*, m.evaluable AND x.evaluable AS both_evaluable, m.evaluable AS mcq_evaluable, m.correct AS mcq_correct, m.answer AS mcq_answer, m.gold AS mcq_gold,
        CASE WHEN m.evaluable AND x.evaluable THEN (CASE WHEN m.correct THEN 'C' ELSE 'W' END) || '->' || (CASE WHEN x.correct THEN 'C' ELSE 'W' END) END AS transition,
        CASE WHEN x.condition<>'open' AND m.evaluable AND x.evaluable THEN x.answer<>m.answer END AS position_changed,
        CASE WHEN m.evaluable AND x.evaluable THEN x.answer_text<>m.answer_text END AS semantic_changed,
        CASE WHEN NOT (x.evaluable AND m.evaluable) THEN NULL WHEN x.condition IN ('none_of_the_provided','incorrect') AND x.correct THEN 'successful_adaptation'
             WHEN x.condition='none_of_the_provided' AND x.answer=m.answer THEN 'failure_to_adapt_kept_same_distractor'
             WHEN x.condition='none_of_the_provided' THEN 'failure_to_adapt_chose_distractor'
             WHEN x.condition='incorrect' THEN 'failure_to_adapt_included_gold' END AS adaptation
      FROM s x JOIN s m ON x.model=m.model AND x.question_id=m.question_id AND m.condition='mcq' AND x.condition<>'mcq')
"""
ONE = f"WITH {GRID}, s1 AS (SELECT * FROM s WHERE model=0), p1 AS (SELECT * FROM p WHERE model=0) "
RATE = "CAST({0} AS DOUBLE) / nullif({1}, 0)".format


# Usage of the calls, by the question and the place of the condition.
_USAGE = {
    "api_error": "(question_id * 3 + ci) % 89 = 0",
    "truncated": "(question_id + ci) % 53 = 0",
    "input_tokens": "100 + question_id % 37",
    "output_tokens": "CASE WHEN question_id % 11 <> 0 THEN question_id % 7 + ci END",
    "thinking_tokens": "CASE WHEN question_id % 3 = 0 THEN question_id % 5 END",
    "latency_s": "(question_id % 13 + ci) / CAST(10 AS DOUBLE)",
    "cost_usd": "CASE WHEN question_id % 11 <> 0 THEN ((100 + question_id % 37) * 3 + (question_id % 7 + ci) * 25) / CAST(10000000 AS DOUBLE) END",
}


@query(ONE + f"""
, w AS (SELECT s1.*, c.ci, {", ".join(f"{e.replace('ci', 'c.ci')} AS {k}" for k, e in _USAGE.items())} FROM s1 JOIN conds c USING (condition)),
a AS (SELECT condition, count(*) AS n, count(*) FILTER (api_error) AS n_api_failures, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (parsed) AS n_parsed, count(*) FILTER (evaluable) AS n_evaluable,
   count(*) FILTER (parsed AND NOT evaluable) AS n_ambiguous, count(*) FILTER (correct) AS n_correct, avg(input_tokens) AS mean_input_tokens, avg(output_tokens) AS mean_output_tokens,
   avg(thinking_tokens) AS mean_thinking_tokens, max(thinking_tokens) AS max_thinking_tokens, avg(latency_s) AS mean_latency_s, coalesce(sum(cost_usd), 0) AS cost_usd FROM w GROUP BY condition),
b AS (SELECT condition, count(*) FILTER (both_evaluable) AS n_pairs, count(*) FILTER (transition='C->C') AS cc, count(*) FILTER (transition='C->W') AS cw,
   count(*) FILTER (transition='W->C') AS wc, count(*) FILTER (transition='W->W') AS ww, condition IN ('roman_numeral','fixed_pos','no_symbols') AS recon_defined,
   {RATE("count(*) FILTER (position_changed)", "count(position_changed)")} AS position_change_rate, {RATE("count(*) FILTER (semantic_changed)", "count(semantic_changed)")} AS semantic_change_rate,
   {RATE("count(*) FILTER (both_evaluable AND mcq_correct AND correct)", "count(*) FILTER (both_evaluable)")} AS reacc, {RATE("count(*) FILTER (NOT semantic_changed)", "count(semantic_changed)")} AS recon FROM p1 GROUP BY condition)
SELECT a.condition, n, n_api_failures, n_truncated, n_parsed, n_evaluable, n_ambiguous, n_correct, {RATE("n_parsed", "n")} AS parse_rate, {RATE("n_correct", "n_evaluable")} AS accuracy,
  CASE WHEN a.condition='open' THEN {RATE("n_correct", "n_parsed")} END AS lower_bound, CASE WHEN a.condition='open' THEN {RATE("(n_correct + n_ambiguous)", "n_parsed")} END AS upper_bound,
  mean_input_tokens, mean_output_tokens, mean_thinking_tokens, mean_latency_s, max_thinking_tokens, cost_usd, n_pairs, cc, cw, wc, ww, position_change_rate, semantic_change_rate,
  CASE WHEN recon_defined THEN reacc END AS reacc, CASE WHEN recon_defined THEN recon END AS recon, recon_defined
FROM a LEFT JOIN b USING (condition)""")
def metrics_by_condition(spark, d):
    s = scored(spark, d).withColumns({k: F.expr(e) for k, e in _USAGE.items()})
    return metrics.by_condition(items.compared(s))


@query(ONE + """SELECT condition, kind, label, n FROM (
SELECT condition, 'transition' AS kind, transition AS label, count(*) AS n FROM p1 WHERE transition IS NOT NULL GROUP BY ALL
UNION ALL SELECT condition, 'adaptation', adaptation, count(*) FROM p1 WHERE adaptation IS NOT NULL GROUP BY ALL
UNION ALL SELECT condition, 'excluded', 'not_evaluable', count(*) FILTER (NOT both_evaluable) FROM p1 GROUP BY ALL)""")
def transitions_long(spark, d):
    return metrics.transitions_long(items.pair(scored(spark, d)))


@query(ONE + """SELECT condition, count(*) FILTER (transition='C->C') AS cc, count(*) FILTER (transition='C->W') AS cw, count(*) FILTER (transition='W->C') AS wc, count(*) FILTER (transition='W->W') AS ww FROM p1 GROUP BY condition""")
def transitions_wide(spark, d):
    return metrics.transitions_wide(items.pair(scored(spark, d)))


@query(f"""WITH {GRID}, q AS (SELECT model, question_id, bool_and(coalesce(correct, FALSE)) AS ok, count(DISTINCT coalesce(answer_text, '')) AS a FROM s
WHERE condition IN ('mcq','roman_numeral','fixed_pos','no_symbols') GROUP BY ALL HAVING count(*) FILTER (evaluable) = 4)
SELECT model, count(*) AS n_questions, {RATE("count(*) FILTER (ok)", "count(*)")} AS joint_reacc, {RATE("count(*) FILTER (a = 1)", "count(*)")} AS joint_recon FROM q GROUP BY model""")
def group_consistency(spark, d):
    return metrics.group_consistency(scored(spark, d, (31, 37)))


FAILURE = """f AS (SELECT s.*, CASE WHEN NOT s.parsed THEN 'parse_failure' WHEN NOT s.evaluable THEN 'evaluation_ambiguity'
  WHEN s.condition='no_symbols' AND s.sel=4 THEN 'invalid_option' WHEN s.correct THEN NULL WHEN s.condition='mcq' THEN 'knowledge_error'
  WHEN s.condition='none_of_the_provided' THEN 'required_adaptation_failure' WHEN NOT m.evaluable THEN 'unattributed_error'
  WHEN m.correct THEN 'representation_instability' ELSE 'knowledge_error' END AS failure
  FROM s JOIN s m ON s.model=m.model AND s.question_id=m.question_id AND m.condition='mcq')"""


@query(f"WITH {GRID}, {FAILURE} SELECT model, failure, count(*) AS n FROM f WHERE failure IS NOT NULL GROUP BY ALL")
def failure_taxonomy(spark, d):
    return metrics.failure_taxonomy(items.with_failure(scored(spark, d, (31, 37))))


@query(f"""WITH {GRID}, a AS (SELECT model, avg(correct::INT::DOUBLE) FILTER (condition='mcq') AS mcq_accuracy, avg(correct::INT::DOUBLE) FILTER (condition IN ('roman_numeral','fixed_pos','no_symbols')) AS invariance_accuracy,
 avg(correct::INT::DOUBLE) FILTER (condition IN ('none_of_the_provided','incorrect')) AS adaptation_accuracy FROM s GROUP BY model),
b AS (SELECT model, {RATE("count(*) FILTER (adaptation LIKE 'failure%')", "count(*)")} AS adaptation_failure_rate FROM p WHERE condition IN ('none_of_the_provided','incorrect') GROUP BY model),
c AS (SELECT model, {RATE("count(*) FILTER (ok)", "count(*)")} AS joint_reacc FROM (SELECT model, question_id, bool_and(coalesce(correct, TRUE)) AS ok FROM s WHERE condition IN ('mcq','roman_numeral','fixed_pos','no_symbols') GROUP BY ALL) GROUP BY model)
SELECT * FROM a JOIN b USING (model) JOIN c USING (model)""")
def main_results_table(spark, d):
    return metrics.main_table(items.compared(scored(spark, d, (31, 37))))


@query(f"""WITH {GRID} SELECT x.condition, count(*) AS n, count(*) FILTER (NOT coalesce(x.correct,FALSE) AND coalesce(y.correct,FALSE)) AS rescues, count(*) FILTER (coalesce(x.correct,FALSE) AND NOT coalesce(y.correct,FALSE)) AS hurts,
 count(*) FILTER (NOT coalesce(x.correct,FALSE) AND coalesce(y.correct,FALSE)) - count(*) FILTER (coalesce(x.correct,FALSE) AND NOT coalesce(y.correct,FALSE)) AS net
 FROM s x JOIN s y ON x.question_id=y.question_id AND x.condition=y.condition AND x.model=0 AND y.model=1 GROUP BY x.condition""")
def rescue_hurt(spark, d):
    return metrics.rescue_hurt(scored(spark, d, (31, 37)), 0, 1)


REWARD = """r AS (SELECT *, CASE WHEN condition='open' THEN 0.0 WHEN coalesce(correct,FALSE) THEN 1.0 ELSE 0.0 END::DOUBLE AS r_correct,
 CASE WHEN condition='open' THEN 0.0 WHEN coalesce(correct,FALSE) THEN 1.0 WHEN NOT parsed THEN 0.0 WHEN condition IN ('mcq','incorrect') THEN 0.5 WHEN condition IN ('roman_numeral','fixed_pos') OR (condition='no_symbols' AND sel<4) THEN 0.25 ELSE 0.0 END::DOUBLE AS r_symbolic,
 CASE WHEN sel=4 AND condition NOT IN ('open','no_symbols') THEN 0.0 ELSE 1.0 END::DOUBLE AS r_format FROM s1)"""


@query(ONE + f", {REWARD} SELECT question_id, condition, r_correct, r_symbolic, r_format, r_correct + 0.5 * r_symbolic AS r_total FROM r")
def reward_scores(spark, d):
    return metrics.rewards(scored(spark, d)).select("question_id", "condition", "r_correct", "r_symbolic", "r_format", "r_total")


@query(ONE + f", {REWARD} SELECT condition, count(*) AS n, avg(r_correct) AS mean_correct, avg(r_symbolic) AS mean_symbolic, avg(r_correct + 0.5 * r_symbolic) AS mean_total FROM r GROUP BY condition")
def reward_summary(spark, d):
    r = metrics.rewards(scored(spark, d))
    return r.groupBy("condition").agg(F.count("*").alias("n"), F.avg("r_correct").alias("mean_correct"), F.avg("r_symbolic").alias("mean_symbolic"), F.avg("r_total").alias("mean_total"))


# ---- parsing ---------------------------------------------------------------------------------------------------


def _wrapped(spark, d):
    """Answers in several dresses, by part key."""
    k = F.col("p_partkey")
    lab = F.get(F.array(*map(F.lit, P.LETTERS)), F.pmod(k, F.lit(4)).cast("int"))
    other = F.get(F.array(*map(F.lit, P.LETTERS)), F.pmod(k + 1, F.lit(4)).cast("int"))
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit('{"answer": "'), lab, F.lit('"}'))).when(k % 6 == 1, F.concat(F.lit("("), lab, F.lit(")"))).when(k % 6 == 2, F.concat(F.lit("Option "), lab, F.lit(" it is")))
        .when(k % 6 == 3, F.concat(lab, F.lit(" or "), other)).when(k % 6 == 4, F.lit("no idea")).otherwise(F.concat(F.lit('```json\n{"answer": "'), lab, F.lit('"}\n```')))
    )
    return t(spark, d, "part").select(k.alias("question_id"), raw.alias("raw"))


_LAB = "substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1)"


@query(f"""SELECT p_partkey AS question_id, CASE WHEN p_partkey % 6 IN (0,1,2,5) THEN {_LAB} END AS label,
CASE p_partkey % 6 WHEN 3 THEN 'ambiguous: multiple labels ' || CASE p_partkey % 4 WHEN 0 THEN '[''A'', ''B'']' WHEN 1 THEN '[''B'', ''C'']' WHEN 2 THEN '[''C'', ''D'']' ELSE '[''A'', ''D'']' END
 WHEN 4 THEN 'no valid label found' END AS reason FROM part""")
def label_parse(spark, d):
    w = _wrapped(spark, d)
    return w.select("question_id", P.parse_label(F.col("raw"), P.LETTERS).alias("p")).select("question_id", "p.*")


@query(f"""SELECT p_partkey AS question_id, CASE WHEN p_partkey % 6 = 0 THEN {_LAB} END AS labels,
 CASE WHEN p_partkey % 6 <> 0 THEN 'response not valid JSON answer object' END AS reason FROM part""")
def label_set_parse(spark, d):
    w = _wrapped(spark, d).select("question_id", P.parse_label_set(F.col("raw"), P.LETTERS).alias("p"))
    return w.select("question_id", F.array_join("p.labels", ",").alias("labels"), "p.reason")


@query(f"SELECT p_partkey AS question_id, CASE WHEN p_partkey % 6 = 0 THEN {_LAB} END AS text FROM part")
def free_text_parse(spark, d):
    return _wrapped(spark, d).select("question_id", P.parse_free_text(F.col("raw"))["text"].alias("text"))


@query("SELECT p_partkey AS question_id, CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 5 THEN 0.8 ELSE 0.0 END::DOUBLE AS r_format FROM part")
def format_reward(spark, d):
    return _wrapped(spark, d).select("question_id", P.format_reward(F.col("raw")).alias("r_format"))


@query("SELECT p_partkey AS question_id, CASE p_partkey % 6 WHEN 0 THEN TRUE ELSE FALSE END AS found, CASE p_partkey % 6 WHEN 0 THEN 'string' END AS kind FROM part")
def strict_json(spark, d):
    return _wrapped(spark, d).select("question_id", P.strict_answer("raw").alias("a")).select("question_id", "a.found", "a.kind")


@query("""WITH a AS (SELECT p_partkey AS id, lower(p_name) AS n, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'it is ' || lower(p_name) WHEN 2 THEN 'zz qq' ELSE lower(p_name) || ' or other thing' END AS ans FROM part)
SELECT method, count(*) AS n FROM (SELECT CASE id % 4 WHEN 0 THEN 'exact' WHEN 2 THEN 'no_match' ELSE CASE WHEN length(trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g'))) >= 0.4 * length(trim(regexp_replace(ans, '[^a-z0-9]+', ' ', 'g'))) THEN 'option_in_answer' ELSE 'no_match' END END AS method FROM a) GROUP BY method""")
def match_text_methods(spark, d):
    n, k = F.lower("p_name"), F.col("p_partkey")
    answer = F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(F.lit("it is "), n)).when(k % 4 == 2, F.lit("zz qq")).otherwise(F.concat(n, F.lit(" or other thing")))
    m = t(spark, d, "part").select(T.match_option(answer, F.array(n, F.lit("another option"), F.lit("third choice"))).alias("m"))
    return m.groupBy(F.col("m.method").alias("method")).agg(F.count("*").alias("n"))


# ---- dedup, alignment, logs --------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) SELECT count(*) AS n_keys, count(*) FILTER (c > 1) AS n_repeated, CAST(sum(c) AS BIGINT) AS n_rows FROM a""")
def duplicate_requests(spark, d):
    a = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    return a.agg(F.count("*").alias("n_keys"), F.count_if(F.col("c") > 1).alias("n_repeated"), F.sum("c").alias("n_rows"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_parts FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) < 3")
def incomplete_sets(spark, d):
    return items.incomplete(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 3)


@query("""SELECT count(*) AS n_ids, count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_orders, count(*) FILTER (b AND NOT a) AS only_lineitem FROM
(SELECT id, bool_or(side='o') AS a, bool_or(side='l') AS b FROM (SELECT o_orderkey AS id, 'o' AS side FROM orders UNION ALL SELECT l_orderkey, 'l' FROM lineitem) GROUP BY id)""")
def id_alignment(spark, d):
    o, l = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("o").alias("side")), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("l").alias("side"))
    g = o.unionByName(l).groupBy("id").agg(F.bool_or(F.col("side") == "o").alias("a"), F.bool_or(F.col("side") == "l").alias("b"))
    return g.agg(F.count("*").alias("n_ids"), F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_orders"), F.count_if(F.col("b") & ~F.col("a")).alias("only_lineitem"))


@query("""WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role='user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role='assistant'),
w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role='user')
SELECT count(*) AS n_positions, count(*) FILTER (a.turn = w.turn + 1) AS n_adjacent FROM w JOIN a USING (conv_id, rn)""")
def positional_vs_id(spark, d):
    c = t(spark, d, "conversations")
    numbered = lambda role, name: c.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rn"))
    j = numbered("user", "u").join(numbered("assistant", "a"), ["conv_id", "rn"])
    return j.agg(F.count("*").alias("n_positions"), F.count_if(F.col("a") == F.col("u") + 1).alias("n_adjacent"))


@query("""WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b FROM events)
SELECT x.user_id, x.event_type, x.value AS first_value, y.value AS last_value, y.value > x.value AS recovered FROM e x JOIN e y USING (user_id, event_type) WHERE x.a = 1 AND y.b = 1""")
def run_recovery(spark, d):
    g = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first_value"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))
    return g.withColumn("recovered", F.col("last_value") > F.col("first_value"))


@query("""SELECT user_id, event_id, spent_before FROM (SELECT user_id, event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM events) WHERE spent_before < 100""")
def cost_ceiling(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, d, "events").select("user_id", "event_id", F.coalesce(F.sum("value").over(w), F.lit(0.0)).alias("spent_before")).where("spent_before < 100")


@query("SELECT event_type, count(*) AS n, sum(user_id * 0.3 / 1e6 + (event_id % 50 + event_id % 7) * 2.5 / 1e6) AS cost, sum(user_id * 0.3 / 1e6 + (event_id % 50) * 2.5 / 1e6) AS cost_without_thinking FROM events GROUP BY event_type")
def cost_by_event(spark, d):
    e = t(spark, d, "events").select("event_type", F.col("user_id").alias("i"), (F.col("event_id") % 50).alias("o"), (F.col("event_id") % 7).alias("th"))
    cost = lambda bill: F.sum(S.token_cost(F.col("i"), F.col("o"), F.col("th"), 0.3, 2.5, bill))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), cost(True).alias("cost"), cost(False).alias("cost_without_thinking"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS n_unknown FROM events GROUP BY event_type")
def thinking_tokens(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return t(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("tokens"), F.count_if(k.isNull()).alias("n_unknown"))


# ---- statistics --------------------------------------------------------------------------------------------------

# The tail of chi squared by the series erf z = exp(-z z) * sum of z ** (2n + 1) / gamma(n + 3/2).
_MCNEMAR = """, d AS (SELECT *, a_only + b_only AS discordant FROM c),
e AS (SELECT *, CASE WHEN discordant < 25 THEN 'exact_binomial' ELSE 'mcnemar_continuity_corrected' END AS test_type,
  CASE WHEN discordant < 25 THEN CAST(b_only AS DOUBLE) ELSE (abs(a_only - b_only) - 1.0)**2 / discordant END AS statistic FROM d),
z AS (SELECT *, greatest(sqrt(statistic / 2), 1e-12) AS z FROM e),
pv AS (SELECT *, CASE WHEN discordant = 0 THEN 1.0 WHEN discordant < 25 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(discordant + 1) - lgamma(i + 1) - lgamma(discordant - i + 1)) * 0.5 ** discordant)))
  WHEN z > 6 THEN 0.0 ELSE greatest(0.0, 1 - exp(-z * z) * list_sum(list_transform(range(0, 250), lambda i: exp((2 * i + 1) * ln(z) - lgamma(i + 1.5))))) END AS p FROM z)
SELECT scope, n, "both", a_only, b_only, neither, discordant, test_type, round(statistic, 4) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant_at_05, p < 0.01 AS significant_at_01 FROM pv"""


@query(f"""WITH {GRID}, j AS (SELECT x.condition, coalesce(x.correct,FALSE) AS a, coalesce(y.correct,FALSE) AS b FROM s x JOIN s y ON x.question_id=y.question_id AND x.condition=y.condition AND x.model=0 AND y.model=1),
c AS (SELECT scope, count(*) AS n, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT unnest(['all', condition]) AS scope, a, b FROM j) GROUP BY scope)
{_MCNEMAR}""")
def model_comparison(spark, d):
    return stats.compare_models(scored(spark, d, (31, 37)), 0, 1)


@query(f"""WITH {GRID}, j AS (SELECT x.condition, x.correct AS ra, y.correct AS rb, x.adaptation AS fa, y.adaptation AS fb FROM p x JOIN p y ON x.question_id=y.question_id AND x.condition=y.condition AND x.model=0 AND y.model=1),
o AS (SELECT x.condition AS scope, coalesce(x.correct,FALSE) AS a, coalesce(y.correct,FALSE) AS b FROM s x JOIN s y ON x.question_id=y.question_id AND x.condition=y.condition AND x.model=0 AND y.model=1
 UNION ALL SELECT 'invariance', coalesce(ra,FALSE), coalesce(rb,FALSE) FROM j WHERE condition IN ('roman_numeral','fixed_pos','no_symbols')
 UNION ALL SELECT 'adaptation_success', coalesce(fa='successful_adaptation',FALSE), coalesce(fb='successful_adaptation',FALSE) FROM j WHERE condition IN ('none_of_the_provided','incorrect')
 UNION ALL SELECT 'adaptation_failure', coalesce(fa LIKE 'failure%',FALSE), coalesce(fb LIKE 'failure%',FALSE) FROM j WHERE condition IN ('none_of_the_provided','incorrect')),
c AS (SELECT scope, count(*) AS n, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM o GROUP BY scope),
r AS (SELECT scope, ("both" + a_only) / n AS rate_a, ("both" + b_only) / n AS rate_b, (b_only - a_only) / n AS delta FROM c)
SELECT m.*, rate_a, rate_b, delta, CASE WHEN scope='adaptation_failure' THEN (rate_a - rate_b) / (rate_a + 1e-9) * 100 END AS relative_reduction_pct FROM ({"WITH z0 AS (SELECT 1) " + _MCNEMAR.replace(", d AS", ", d AS", 1)}) m JOIN r USING (scope)""")
def compared_outcomes(spark, d):
    return stats.compared_outcomes(items.compared(scored(spark, d, (31, 37))), 0, 1)


@query()
def comparison_report(spark, d):
    """compared_outcomes with bootstraps, whose draws SQL does not state."""
    return stats.comparison_report(items.compared(scored(spark, d, (31, 37))), 0, 1)


@query("""WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, n, k, round(least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) * 0.5 ** n))), 9) AS p FROM c""")
def exact_binomial(spark, d):
    """Whether a conversation's turns are the user's as often as not."""
    nk = t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("k"))
    return nk.select("conv_id", "n", "k", F.round(stats.binomial_two_sided(F.col("k").cast("int"), (F.col("n") - F.col("k")).cast("int")), 9).alias("p"))


def _mixed(x: str) -> str:
    """The mixing hash of stats.bootstrap in SQL; the lambda gives its argument a name."""
    for _ in range(2):
        x = f"list_extract(list_transform([{x}], lambda v: (xor(v, v >> 15) * {stats.MIXER}) % 2147483648), 1)"
    return f"list_extract(list_transform([{x}], lambda v: xor(v, v >> 15)), 1)"


@query(f"""WITH u AS (SELECT user_id AS i, sum(value) AS d, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY user_id),
dr AS (SELECT b, d, w, len(list_filter({stats.POISSON}, lambda t: t <= {_mixed("xor(" + _mixed("xor(b * 7919 % 2147483648, 42)") + ", " + _mixed("i % 2147483648") + ")")})) AS k FROM u, (SELECT unnest(range(0, 2000)) AS b)),
m AS (SELECT b, sum(k * d) / sum(k * w) AS m FROM dr GROUP BY b)
SELECT count(*) AS replicates, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_pop(m) AS se, avg(m) AS mean FROM m""")
def cluster_bootstrap(spark, d):
    u = t(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("d"), F.count("*").cast("double").alias("w"))
    return stats.bootstrap(u, "user_id")


# ---- text --------------------------------------------------------------------------------------------------------

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_N1 = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))".format


@query(f"""SELECT doc_id, md5({_N1("text")}) AS n1, md5(trim(regexp_replace(translate(trim(lower(text)), '{_PUNCT}', ''), '\\s+', ' ', 'g'))) AS n2, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS n4,
 CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents""")
def norm_texts(spark, d):
    s = F.col("text")
    return t(spark, d, "documents").select("doc_id", F.md5(T.norm_words(s)).alias("n1"), F.md5(T.norm_no_punctuation(s)).alias("n2"), F.md5(T.norm_case(s)).alias("n4"), long(T.word_count(s)).alias("n_words"))


@query(f"""WITH k AS (SELECT source AS grp, {_N1("text")} AS k, count(*) AS n FROM documents GROUP BY ALL)
SELECT grp, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, count(*) FILTER (n > 1) AS dup_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_dups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM k GROUP BY grp""")
def duplicate_profile(spark, d):
    return overlap.duplicate_profile(t(spark, d, "documents"), "source", T.norm_words)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS n_blank, count(DISTINCT {c}) AS n_unique FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")")
def column_profile(spark, d):
    return overlap.column_profile(t(spark, d, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def value_distribution(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT {_N1("text")} AS k, count(*) AS na FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT {_N1("text")} AS k, count(*) AS nb FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT count(*) AS shared_keys, CAST(coalesce(sum(na), 0) AS BIGINT) AS rows_a, CAST(coalesce(sum(nb), 0) AS BIGINT) AS rows_b FROM a JOIN b USING (k) WHERE k <> ''""")
def exact_overlap(spark, d):
    """The two halves are the operator's two sides, not a sample."""
    docs = t(spark, d, "documents")
    return overlap.exact_overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), T.norm_words)


@query(f"""SELECT doc_id, item_id FROM (SELECT doc_id, {_N1("text")} AS h FROM documents) JOIN (SELECT item_id, {_N1("text")} AS q FROM benchmark) ON q <> '' AND contains(' ' || h || ' ', ' ' || q || ' ')""")
def passage_containment(spark, d):
    return overlap.contained_phrases(t(spark, d, "documents"), t(spark, d, "benchmark"))


@query(f"""WITH d AS (SELECT lang AS grp, doc_id AS id, list_distinct(string_split({_N1("text")}, ' ')) AS w FROM documents WHERE {_N1("text")} <> ''),
k AS (SELECT grp, id, unnest(w) AS t FROM d), b AS (SELECT grp, t FROM k WHERE length(t) >= 5 GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8), x AS (SELECT k.* FROM k JOIN b USING (grp, t)),
c AS (SELECT DISTINCT a.grp, a.id, b.id AS id2 FROM x a JOIN x b ON a.grp=b.grp AND a.t=b.t AND a.id<b.id)
SELECT c.grp, c.id, id2, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard FROM c JOIN d a ON a.id=c.id JOIN d b ON b.id=id2
WHERE CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.85""")
def near_duplicates(spark, d):
    return overlap.near_duplicates(t(spark, d, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), "text"))


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_ßà-öø-ÿ]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"""WITH d AS (SELECT item_id % 4 AS grp, item_id AS id, {_TOK} AS w FROM benchmark), j AS (SELECT a.grp, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j FROM d a JOIN d b ON a.grp=b.grp AND a.id<b.id)
SELECT grp, count(*) AS n_pairs, avg(j) AS mean_j, max(j) AS max_j, min(j) AS min_j, avg(j) > 0.8 AS flagged FROM j GROUP BY grp""")
def diversity_by_group(spark, d):
    return overlap.group_diversity(t(spark, d, "benchmark").select((F.col("item_id") % 4).alias("grp"), F.col("item_id").alias("id"), "text"))


def _skeleton(x: str) -> str:
    for pattern, mark in T.SKELETON:
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return x


@query(f"SELECT conv_id, turn, md5({_skeleton("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")}) AS skeleton FROM conversations")
def skeletons(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.md5(T.skeleton(F.col("text"))).alias("skeleton"))


@query(f"""WITH r AS (SELECT conv_id AS grp, turn AS id, text FROM conversations WHERE text IS NOT NULL), z AS (SELECT grp, count(*) AS n_items, count(DISTINCT {_skeleton("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")}) AS n_skeletons FROM r GROUP BY grp),
d AS (SELECT grp, id, {_TOK} AS w FROM r), j AS (SELECT a.grp, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0) AS j FROM d a JOIN d b ON a.grp=b.grp AND a.id<b.id),
g AS (SELECT grp, count(*) AS n_pairs, avg(coalesce(j, 1)) AS mean_j, max(coalesce(j, 1)) AS max_j, min(coalesce(j, 1)) AS min_j FROM j GROUP BY grp)
SELECT z.grp, n_items, n_skeletons, coalesce(n_pairs, 0) AS n_pairs, coalesce(mean_j, 0) AS mean_j, coalesce(max_j, 0) AS max_j, coalesce(min_j, 0) AS min_j, coalesce(mean_j > 0.8, FALSE) AS flagged FROM z LEFT JOIN g ON g.grp = z.grp""")
def template_diversity(spark, d):
    """Of each conversation's turns."""
    return overlap.template_diversity(t(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), "text"))


@query("""WITH r AS (SELECT conv_id, turn, upper(text) AS u FROM conversations), f AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(u, '\\b(I|A|II|IV)\\b', 1)) AS f FROM r)
SELECT conv_id, turn, CASE WHEN len(f) = 1 THEN f[1] END AS label, CASE WHEN len(f) = 1 THEN 'ok' WHEN len(f) > 1 THEN 'ambiguous' ELSE 'unparseable' END AS status FROM f""")
def first_phase_parse(spark, d):
    """Turns as plain responses with the labels A, I, II and IV."""
    r = t(spark, d, "conversations").select("conv_id", "turn", P.parse_first_phase(F.col("text"), ["A", "I", "II", "IV"]).alias("p"))
    return r.select("conv_id", "turn", "p.*")


@query("""WITH p AS (SELECT l.toxic, CASE WHEN """ + " OR ".join(f"contains(lower(text), '{k}')" for k in T.KEYWORDS) + """ THEN 1 ELSE 0 END AS hit FROM documents JOIN labels l USING (doc_id))
SELECT toxic, count(*) AS n, CAST(sum(hit) AS BIGINT) AS n_hit, avg(CASE WHEN hit = toxic THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY toxic""")
def keyword_heuristic(spark, d):
    j = t(spark, d, "documents").select("doc_id", T.keyword_hit(F.col("text")).alias("hit")).join(t(spark, d, "labels"), "doc_id")
    return j.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("hit").alias("n_hit"), F.avg((F.col("hit") == F.col("toxic")).cast("double")).alias("accuracy"))


@query(r"""SELECT doc_id, regexp_matches(text, '\b(stupid|worthless)\b') AS banned, regexp_matches(text, '[><=]=?\s*\d+') AS threshold, contains(text, '(') AS parenthesis FROM documents""")
def lint_banned(spark, d):
    s = F.col("text")
    return t(spark, d, "documents").select("doc_id", s.rlike(r"\b(stupid|worthless)\b").alias("banned"), s.rlike(r"[><=]=?\s*\d+").alias("threshold"), F.contains(s, F.lit("(")).alias("parenthesis"))


@query("""WITH p AS (SELECT conv_id, text, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole FROM conversations),
x AS (SELECT length(nxt) - length(text) AS diff FROM p WHERE role='user' AND nrole='assistant') SELECT count(*) AS n, avg(diff) AS mean_diff, median(diff) AS median_diff, stddev_samp(diff) AS std_diff, count(*) FILTER (diff = 0) AS n_same FROM x""")
def descriptives(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t(spark, d, "conversations").select("role", "text", F.lead("text").over(w).alias("nxt"), F.lead("role").over(w).alias("nrole")).where("role = 'user' AND nrole = 'assistant'")
    x = x.select((F.length("nxt") - F.length("text")).alias("diff"))
    return x.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.median("diff").alias("median_diff"), F.stddev_samp("diff").alias("std_diff"), F.count_if(F.col("diff") == 0).alias("n_same"))


@query()
def lexical_similarity(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t(spark, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("nxt")).where("nxt IS NOT NULL")
    return x.select("conv_id", "turn", T.lexical_similarity(F.col("text"), F.col("nxt")).alias("similarity"))


# ---- samples, splits, graphs ---------------------------------------------------------------------------------------

_SHARES = """c AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT *, n * 100 / sum(n) OVER () AS quota FROM c), f AS (SELECT *, floor(quota) AS base FROM q),
sh AS (SELECT stratum, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY round(quota - base, 9) DESC, stratum) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS k FROM f)"""
_ORD = "(doc_id * 7919 + 42) % 10007"


def _shares(spark, d):
    return splits.largest_remainder(t(spark, d, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n")), 100)


@query(f"WITH {_SHARES} SELECT * FROM sh")
def stratified_alloc(spark, d):
    return _shares(spark, d)


def _rows(spark, d):
    return t(spark, d, "documents").select(F.col("lang").alias("stratum"), F.col("doc_id").alias("id"), "text")


@query(f"WITH {_SHARES}, r AS (SELECT lang AS stratum, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY {_ORD}, doc_id) AS rn FROM documents) SELECT stratum, id, rn FROM r JOIN sh USING (stratum) WHERE rn <= k")
def stratified_sample(spark, d):
    return splits.stratified_sample(_rows(spark, d).drop("text"), _shares(spark, d), (F.col("id") * 7919 + 42) % 10007)


@query("WITH r AS (SELECT lang AS stratum, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) SELECT stratum, id, row_number() OVER (ORDER BY rn, stratum) AS stage_order FROM r")
def round_robin(spark, d):
    return splits.round_robin(_rows(spark, d).drop("text"))


_SPLIT = f"""k AS (SELECT doc_id AS id, lang AS stratum, {_N1("text")} AS k FROM documents), cl AS (SELECT stratum, k, min(id) AS cluster, count(*) AS size FROM k GROUP BY ALL),
tot AS (SELECT lang AS stratum, count(*) AS total FROM documents GROUP BY 1),
o AS (SELECT cl.stratum, cluster, size, total, coalesce(sum(size) OVER (PARTITION BY cl.stratum ORDER BY (cluster * 7919 + 42) % 10007, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cl JOIN tot USING (stratum)),
tr AS (SELECT *, before < round_even(total * 0.7, 0) AS is_train FROM o), x AS (SELECT *, sum(CASE WHEN is_train THEN size ELSE 0 END) OVER (PARTITION BY stratum) AS in_train FROM tr),
sp AS (SELECT stratum, cluster, size, CASE WHEN is_train THEN 'train' WHEN before - in_train < round_even(total * 0.1, 0) THEN 'val' ELSE 'final_test' END AS split FROM x)"""


def _split(spark, d):
    rows = _rows(spark, d)
    clusters = splits.text_clusters(rows, T.norm_words).select("stratum", "cluster", "size").distinct()
    totals = rows.groupBy("stratum").agg(F.count("*").alias("total"))
    return splits.greedy_split(clusters, totals, (F.col("cluster") * 7919 + 42) % 10007)


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def greedy_split(spark, d):
    return _split(spark, d)


@query(f"WITH {_SPLIT} SELECT stratum, split, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_rows FROM sp GROUP BY ALL")
def split_summary(spark, d):
    return _split(spark, d).groupBy("stratum", "split").agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_rows"))


@query(f"""WITH a AS (SELECT DISTINCT {_N1("text")} AS k, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'final_test' END AS split FROM documents)
SELECT x.split, y.split AS other, count(*) AS n_shared FROM a x JOIN a y ON x.k=y.k AND x.split<y.split GROUP BY ALL""")
def leakage_violations(spark, d):
    m = F.col("doc_id") % 5
    return splits.leakage(t(spark, d, "documents").select(T.norm_words(F.col("text")).alias("k"), F.when(m < 3, "train").when(m == 3, "val").otherwise("final_test").alias("split")), "k")


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, -1 - (o_orderkey % 700) AS b FROM orders), bo AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) USING KEY (node) AS (SELECT a, a FROM bo GROUP BY a UNION SELECT x.node, min(x.root) FROM (SELECT b2.a AS node, r.root AS root FROM r JOIN bo b2 ON b2.b = r.node JOIN recurring.r q ON q.node = b2.a WHERE r.root < q.root) x GROUP BY x.node)
SELECT count(DISTINCT root) AS n_components, count(*) AS n_nodes FROM r""")
def connected_components(spark, d):
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.lit(-1) - F.col("o_orderkey") % 700).alias("b"))
    return graph.components(e).agg(F.count_distinct("root").alias("n_components"), F.count("*").alias("n_nodes"))


_CLUSTERS = f"""kk AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(lang, '') AS source, coalesce(lang, '') || ' ' || {_N1("text")} AS k, doc_id % 97 = 0 AS pilot FROM documents WHERE doc_id IS NOT NULL),
cc AS (SELECT source, k, min(id) AS cluster, count(*) AS size, bool_or(pilot) AS has_pilot FROM kk GROUP BY source, k)"""


def _clusters(spark, d):
    lang, text = F.coalesce("lang", F.lit("")), T.norm_words(F.col("text"))
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), lang.alias("source"), F.concat(lang, F.lit(" "), text).alias("key"), (F.col("doc_id") % 97 == 0).alias("pilot"))
    return graph.question_clusters(rows)


@query(f"""WITH {_CLUSTERS}, n AS (SELECT *, 'cluster_' || lpad(CAST(row_number() OVER (ORDER BY cluster) - 1 AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY cluster) - 1 AS VARCHAR))) AS INTEGER), '0') AS cluster_id FROM cc)
SELECT id, n.source, pilot, cluster_id, size, has_pilot FROM kk JOIN n ON n.source = kk.source AND n.k = kk.k""")
def question_clusters(spark, d):
    return _clusters(spark, d)


@query(f"""WITH {_CLUSTERS}, tot AS (SELECT source, count(*) AS total FROM kk GROUP BY 1),
o AS (SELECT cc.source, cluster, size, total, has_pilot, coalesce(sum(CASE WHEN has_pilot THEN 0 ELSE size END) OVER (PARTITION BY cc.source ORDER BY md5(cluster), cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cc JOIN tot ON tot.source = cc.source),
tr AS (SELECT *, NOT has_pilot AND before < round_even(total * 0.7, 0) AS is_train FROM o), x AS (SELECT *, sum(CASE WHEN is_train THEN size ELSE 0 END) OVER (PARTITION BY source) AS in_train FROM tr),
sp AS (SELECT size, CASE WHEN has_pilot THEN 'diagnostic' WHEN is_train THEN 'train' WHEN before - in_train < round_even(total * 0.1, 0) THEN 'val' ELSE 'final_test' END AS split FROM x)
SELECT split, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_rows, round(100 * sum(size) / CAST(sum(sum(size)) OVER () AS DOUBLE), 2) AS pct FROM sp GROUP BY split""")
def four_way_split(spark, d):
    """Clusters with a pilot id to diagnostic, the rest to train, val and final_test by source; the sizes and shares."""
    ids = _clusters(spark, d)
    clusters = ids.groupBy(F.col("source").alias("stratum"), "cluster_id").agg(F.min("id").alias("cluster"), F.count("*").alias("size"), F.first("has_pilot").alias("has_pilot")).drop("cluster_id")
    totals = clusters.groupBy("stratum").agg(F.sum("size").alias("total"))
    return splits.split_summary(splits.greedy_split(clusters, totals, F.md5("cluster")))


@query("SELECT source, count(*) FILTER (quality=0) AS q0, count(*) FILTER (quality=1) AS q1 FROM labels JOIN documents USING (doc_id) GROUP BY source")
def crosstab(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").pivot("quality", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "q0", "1": "q1"})


@query("""SELECT CASE WHEN GROUPING(lang)=1 THEN 'pooled' ELSE lang END AS lang, count(*) AS n, avg(CASE WHEN quality=1 THEN 1.0 ELSE 0.0 END) AS always_default, avg(CASE WHEN toxic=quality THEN 1.0 ELSE 0.0 END) AS agreement FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def grouping_accuracy(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    g = j.rollup("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.avg((F.col("quality") == 1).cast("double")).alias("always_default"), F.avg((F.col("toxic") == F.col("quality")).cast("double")).alias("agreement"))
    return g.select(F.when(F.col("g") == 1, "pooled").otherwise(F.col("lang")).alias("lang"), "n", "always_default", "agreement")


# ---- counterfactuals -----------------------------------------------------------------------------------------------

_MARGIN = "((p_partkey * {0}) % 201 - 100) / 100.0".format


def _wide(spark, d):
    m = lambda k: (((F.col("p_partkey") * k) % 201 - 100) / F.lit(100.0))
    return t(spark, d, "part").select("p_partkey", m(37).alias("base"), m(53).alias("edited"), m(71).alias("near_miss"))


@query(f"""WITH w AS (SELECT {_MARGIN(37)} AS base, {_MARGIN(53)} AS edited, {_MARGIN(71)} AS near_miss FROM part), l AS (SELECT 'base' AS item_type, base AS margin FROM w UNION ALL SELECT 'edited', edited FROM w UNION ALL SELECT 'near_miss', near_miss FROM w)
SELECT item_type, count(*) AS n, count(*) FILTER (margin > 0.125) AS n_correct, count(*) FILTER (margin < -0.125) AS n_incorrect, count(*) FILTER (abs(margin) <= 0.125) AS n_tie, avg(margin) AS mean_margin FROM l GROUP BY item_type""")
def tieband_accuracy(spark, d):
    w = _wide(spark, d).unpivot("p_partkey", ["base", "edited", "near_miss"], "item_type", "margin")
    return counterfactual.tieband_accuracy(w, 0.125)


@query(f"""WITH w AS (SELECT {_MARGIN(37)} AS base, {_MARGIN(53)} AS edited FROM part)
SELECT CASE WHEN abs(base) <= 0.125 OR abs(edited) <= 0.125 THEN 'tie' WHEN base > 0 AND edited < 0 THEN 'flip' WHEN base > 0 THEN 'default_dominant' WHEN edited < 0 THEN 'alternative_dominant' ELSE 'both_incorrect' END AS outcome, count(*) AS n, avg(base) AS mean_base, avg(edited) AS mean_edited FROM w GROUP BY 1""")
def cfr_metrics(spark, d):
    return counterfactual.cfr(_wide(spark, d), 0.125)


@query(f"""WITH w AS (SELECT {_MARGIN(37)} AS base, {_MARGIN(53)} AS edited, {_MARGIN(71)} AS near_miss FROM part)
SELECT count(*) AS n, count(*) FILTER (base < -0.125 AND edited > 0.125 AND near_miss < -0.125) / count(*) AS dfr, count(*) FILTER (edited > 0.125 AND near_miss > 0.125) / count(*) AS over_flip, count(*) FILTER (base < -0.125 AND edited > 0.125) / count(*) AS cfr,
 count(*) FILTER (abs(base) <= 0.125 OR abs(edited) <= 0.125 OR abs(near_miss) <= 0.125) AS any_tie FROM w""")
def dfr_metrics(spark, d):
    return counterfactual.dfr(_wide(spark, d), 0.125)


@query("SELECT l_returnflag = 'N' AS chosen_is_default, sum(l_quantity) AS weight, count(*) AS n FROM lineitem GROUP BY 1")
def class_balance(spark, d):
    return t(spark, d, "lineitem").groupBy((F.col("l_returnflag") == "N").alias("chosen_is_default")).agg(F.sum("l_quantity").alias("weight"), F.count("*").alias("n"))


@query("""WITH i AS (SELECT p_brand AS drug, CASE WHEN p_size % 3 = 0 THEN 'near_ood' ELSE 'train' END AS split, CASE WHEN p_partkey % 2 = 0 THEN 'avoid' ELSE 'correct' END AS polarity FROM part)
SELECT drug FROM i GROUP BY drug HAVING (bool_or(polarity='avoid' AND split='train') AND bool_or(polarity='correct' AND split<>'train')) OR (bool_or(polarity='correct' AND split='train') AND bool_or(polarity='avoid' AND split<>'train'))""")
def polarity_conflicts(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("drug"), F.when(F.col("p_size") % 3 == 0, "near_ood").otherwise("train").alias("split"), F.when(F.col("p_partkey") % 2 == 0, "avoid").otherwise("correct").alias("polarity"))
    return counterfactual.polarity_conflicts(p)


@query()
def bow_logreg_accuracy(spark, d):
    """Learnt from four fifths of the labelled documents, by the id, and tested on the rest."""
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("text", F.col("toxic").cast("double").alias("label"), F.col("lang").alias("grp"), (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1).alias("held_out"))
    return counterfactual.bag_of_words_accuracy(j.where("NOT held_out"), j.where("held_out"))


@query("""SELECT event_type, avg(value) AS mean, stddev_pop(value) / sqrt(count(*)) AS sem, count(*) AS n FROM events GROUP BY event_type""")
def mean_sem(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


@query("SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark, d):
    return t(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT source, doc_id // 1000 AS k, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS h, count(*) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL),
b AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n) AS n FROM a GROUP BY source, a.k // 1000), c AS (SELECT source, k // 1000 AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n) AS n FROM b GROUP BY source, b.k // 1000)
SELECT source, CAST(sum(n) AS BIGINT) AS n_ids, sha256(string_agg(h, chr(10) ORDER BY k)) AS id_sha256 FROM c GROUP BY source""")
def id_digest(spark, d):
    return relational.id_digest(t(spark, d, "documents"), "source", "doc_id")


@query(f"""WITH a AS (SELECT doc_id AS id, {_N1("text")} AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id, {_N1("text")} AS k FROM documents WHERE doc_id % 2 = 1),
x AS (SELECT id, list_distinct(string_split(k, ' ')) AS w FROM a WHERE k <> '' AND k NOT IN (SELECT k FROM b)), y AS (SELECT id, list_distinct(string_split(k, ' ')) AS w FROM b WHERE k <> ''),
tx AS (SELECT id, unnest(w) AS t FROM x), ty AS (SELECT id, unnest(w) AS t FROM y), p AS (SELECT DISTINCT tx.id AS a_id, ty.id AS b_id FROM tx JOIN ty ON tx.t = ty.t)
SELECT a_id, b_id, j AS jaccard FROM (SELECT a_id, b_id, len(list_intersect(x.w, y.w)) / CAST(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)) AS DOUBLE) AS j FROM p JOIN x ON x.id = a_id JOIN y ON y.id = b_id) WHERE j >= 0.85""")
def near_overlap(spark, d):
    """The two halves are the operator's two sides, not a sample. All pairs that reach the similarity, with a rare word or without."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return overlap.near_overlap(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"), rare=None)


_PERTURBED = """WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) AS k FROM conversations),
p AS (SELECT *, CASE k % 4 WHEN 0 THEN 'roman_numeral' WHEN 1 THEN 'fixed_pos' WHEN 2 THEN 'incorrect' ELSE 'open' END AS perturbation_type FROM r),
e AS (SELECT conv_id, turn, perturbation_type, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS orig_word_count, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS pert_word_count,
 CAST(1.5 AS DOUBLE) AS orig_options_avg_wc, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 1.5 ELSE 2.0 END END::DOUBLE AS pert_options_avg_wc,
 CASE WHEN k % 4 < 2 THEN 0 END::INTEGER AS orig_answer_position, CASE WHEN k % 4 < 2 AND k % 7 <> 0 THEN CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END END::INTEGER AS pert_answer_position,
 CASE WHEN k % 4 < 2 THEN k % 5 <> 0 END AS raw_answer_token_changed, CASE WHEN k % 4 = 2 THEN 'list_of_letters' WHEN k % 4 = 3 THEN 'free_text' ELSE 'letter' END AS answer_format,
 k % 3 = 0 AS question_text_changed, k % 4 = 2 AS is_task_inverted FROM p),
d AS (SELECT *, pert_word_count - orig_word_count AS question_length_diff, pert_options_avg_wc - orig_options_avg_wc AS options_length_diff, CASE WHEN raw_answer_token_changed IS NOT NULL THEN coalesce(orig_answer_position <> pert_answer_position, TRUE) END AS answer_position_changed FROM e)"""


def _perturbed(spark, d):
    """Pairs of a turn and what a perturbation made of it."""
    k, text = F.length(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))
    old = F.lit('{"A": "one", "B": "two words"}')
    new = F.when(k % 7 == 0, F.lit("none")).when(k % 2 == 0, old).otherwise(F.lit('{"A": "one two", "B": "three four"}'))
    kind = F.when(k % 4 == 0, "roman_numeral").when(k % 4 == 1, "fixed_pos").when(k % 4 == 2, "incorrect").otherwise("open")
    answer = F.when(k % 4 == 2, F.lit("['B', 'C']")).when(k % 4 == 3, F.lit("free words")).when(k % 5 == 0, F.lit("A")).otherwise(F.lit("B"))
    columns = [kind.alias("perturbation_type"), text.alias("original_question"), F.when(k % 3 == 0, F.concat(text, F.lit(" two more"))).otherwise(text).alias("perturbed_question"), old.alias("original_options"), new.alias("perturbed_options")]
    return t(spark, d, "conversations").select("conv_id", "turn", *columns, F.lit("A").alias("original_answer_letter"), answer.alias("perturbed_answer_raw"), (k % 3 == 0).alias("question_text_changed"), (k % 4 == 2).alias("is_task_inverted"))


_TWELVE = ["orig_word_count", "pert_word_count", "question_length_diff", "orig_options_avg_wc", "pert_options_avg_wc", "options_length_diff", "orig_answer_position", "pert_answer_position", "answer_position_changed", "raw_answer_token_changed", "answer_format"]


@query(_PERTURBED + f" SELECT conv_id, turn, perturbation_type, {', '.join(_TWELVE)} FROM d")
def enriched_pairs(spark, d):
    return enriching.enrich(_perturbed(spark, d), similarity=False).select("conv_id", "turn", "perturbation_type", *_TWELVE)


_SPREAD = "avg({1}) AS {0}_mean, median({1}) AS {0}_median, stddev_samp({1}) AS {0}_std".format


@query(_PERTURBED + f""" SELECT perturbation_type, count(*) AS n_pairs, avg(question_text_changed::INT::DOUBLE) AS question_text_changed_rate, {_SPREAD("question_length_diff_words", "question_length_diff")}, {_SPREAD("options_length_diff_words", "options_length_diff")},
 avg(answer_position_changed::INT::DOUBLE) AS answer_position_change_rate, avg(raw_answer_token_changed::INT::DOUBLE) AS raw_answer_token_change_rate, bool_or(is_task_inverted) AS is_task_inverted,
 {", ".join(f"avg((answer_format = '{f}')::INT::DOUBLE) AS share_{f}" for f in ("list_of_letters", "roman_numeral", "letter", "free_text", "unknown"))} FROM d GROUP BY perturbation_type""")
def pair_descriptives(spark, d):
    return enriching.descriptives(enriching.enrich(_perturbed(spark, d), similarity=False))


@query(ONE + f""", v AS (SELECT condition, unnest(['n_parsed', 'n_correct']) AS metric, unnest([count(*) FILTER (parsed), count(*) FILTER (correct)]) AS independent FROM s1 GROUP BY condition)
SELECT condition, metric, CAST(independent AS DOUBLE) AS independent, CAST(independent + 1 AS DOUBLE) AS reported FROM v WHERE (condition = 'mcq' AND metric = 'n_correct') OR (condition = 'open' AND metric = 'n_parsed')""")
def recompute_differences(spark, d):
    """A report with two wrong figures against its second computation, which finds them and no others."""
    s = scored(spark, d)
    told = metrics.by_condition(items.compared(s))
    wrong = lambda name, condition: (F.col(name) + F.when(F.col("condition") == condition, 1).otherwise(0)).alias(name)
    return recompute.differences(s, told.select(*[wrong(c, "mcq") if c == "n_correct" else wrong(c, "open") if c == "n_parsed" else F.col(c) for c in told.columns]))
