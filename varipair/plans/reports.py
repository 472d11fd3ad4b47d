"""Named queries of data preparation, its checks and the studies' tables. They join those of ``catalog`` on import.

The benchmark rows are derived from `part`; p_size % 10 names the flaw that a question has, so that every check finds some.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import scoring as S
from ..functions import shapes as H
from ..functions import text as T
from ..operators import items, phases, preparation
from .catalog import GRID, query, scored, t


def _arr(xs):
    return F.array(*map(F.lit, xs))


def _sources(spark, d):
    """Benchmark rows. Flaws: 0 gold not moved last, 1 wrong text of the open question, 2 gold not replaced, 3 question
    changed, 4 a wrong option missing from the set, 5 letters for numerals."""
    c, flaw, g, texts = F.col("condition"), F.col("flaw"), F.col("g"), _arr(items.TEXTS)
    key = F.col("p_partkey")
    rows = items.spread(t(spark, d, "part").select("p_partkey", "p_type", "p_name", "p_size"))
    rows = rows.select("*", (F.col("p_size") % 10).alias("flaw"), F.pmod(key * 7 + 3, F.lit(4)).cast("int").alias("g"), F.explode(_arr(S.CONDITIONS)).alias("condition"))
    gold, rest = F.get(texts, g), F.array_except(_arr(P.LETTERS), F.array(F.get(_arr(P.LETTERS), g)))
    shown = (
        F.when((c == "fixed_pos") & (flaw != 0), F.array_append(F.array_except(texts, F.array(gold)), gold))
        .when((c == "none_of_the_provided") & (flaw != 2), F.transform(texts, lambda x: F.when(x == gold, preparation.NO_OPTION).otherwise(x)))
        .otherwise(texts)
    )
    labels = F.when((c == "roman_numeral") & (flaw != 5), _arr(P.ROMAN)).otherwise(_arr(P.LETTERS))
    wrong = F.when(flaw == 4, F.slice(rest, 1, 2)).otherwise(rest)
    answer = (
        F.when(c == "incorrect", F.concat(F.lit("['"), F.array_join(wrong, "', '"), F.lit("']")))
        .when((c == "open") & (flaw == 1), F.get(texts, F.pmod(g + 1, F.lit(4)))).when(c.isin(preparation.TEXT_ANSWERS), gold)
        .when((c == "fixed_pos") & (flaw != 0), F.lit("D")).otherwise(F.get("labels", g))
    )
    question = F.when(c == "open", F.concat(F.lit("Name it: "), "p_name")).when((c == "no_symbols") & (flaw == 3), F.concat(F.lit("another "), "p_name")).otherwise(F.col("p_name"))
    rows = rows.withColumn("labels", labels).withColumn("shown", shown).withColumn("question", question)
    return rows.select(
        F.col("p_type").alias("source_dataset"), key.cast("string").alias("source_id"), "condition", "question", F.to_json(F.map_from_arrays("labels", "shown")).alias("options"),
        answer.alias("answer"), H.prompt(c, F.col("question"), F.col("labels"), F.col("shown")).alias("prompt"), "flaw",
    )


_SRC = """conds(condition) AS (VALUES ('mcq'),('roman_numeral'),('none_of_the_provided'),('fixed_pos'),('incorrect'),('open'),('no_symbols')),
q AS (SELECT p_type || '::' || p_partkey AS question_id, p_type, p_partkey, p_name, p_size % 10 AS flaw, (p_partkey*7+3) % 4 AS g, condition,
 ['alpha','bravo','charlie','delta'] AS tx, ['A','B','C','D'] AS le, ['I','II','III','IV'] AS ro FROM part CROSS JOIN conds),
x AS (SELECT *, list_filter(le, lambda v: v <> le[g + 1]) AS others, condition='fixed_pos' AND flaw<>0 AS last, condition='none_of_the_provided' AND flaw<>2 AS gone, condition='roman_numeral' AND flaw<>5 AS roman FROM q),
y AS (SELECT *, CASE WHEN last THEN list_append(list_filter(tx, lambda v: v <> tx[g + 1]), tx[g + 1]) WHEN gone THEN list_transform(tx, lambda v: CASE WHEN v = tx[g + 1] THEN 'None of the provided options' ELSE v END) ELSE tx END AS shown,
 CASE WHEN flaw=4 THEN others[1:2] ELSE others END AS wrong, CASE WHEN roman THEN ro ELSE le END AS labels FROM x),
z AS (SELECT *, CASE WHEN condition='incorrect' THEN '[''' || array_to_string(wrong, ''', ''') || ''']' WHEN condition='open' AND flaw=1 THEN tx[(g + 1) % 4 + 1] WHEN condition IN ('open','no_symbols') THEN tx[g + 1]
 WHEN last THEN 'D' ELSE labels[g + 1] END AS answer, CASE WHEN condition='incorrect' THEN NULL WHEN gone THEN 'None of the provided options' WHEN condition='open' AND flaw=1 THEN tx[(g + 1) % 4 + 1] ELSE tx[g + 1] END AS gold_text FROM y)"""


@query(f"""WITH {_SRC} SELECT p_type AS source_dataset, CAST(p_partkey AS VARCHAR) AS source_id, condition AS perturbation_type, p_name AS original_question, le[g + 1] AS original_answer_letter, tx[g + 1] AS original_answer_text,
 '{{"' || array_to_string(list_transform(range(1, 5), lambda i: labels[i] || '":"' || shown[i]), '","') || '"}}' AS perturbed_options, answer AS perturbed_answer_raw, gold_text AS perturbed_answer_interpretation,
 condition='incorrect' AS is_task_inverted, condition='open' OR (condition='no_symbols' AND flaw=3) AS question_text_changed FROM z WHERE condition<>'mcq'""")
def pairs_built(spark, d):
    return preparation.pairs(_sources(spark, d)).drop("original_options", "original_prompt", "perturbed_prompt", "perturbed_question")


@query(f"""WITH {_SRC} SELECT question_id, condition, CASE WHEN condition IN ('open','no_symbols') THEN '' ELSE array_to_string(labels, ',') END AS labels, array_to_string(shown, ',') AS texts, condition<>'open' AS options_displayed,
 gold_text, CAST(CASE WHEN condition='incorrect' THEN NULL WHEN last THEN 3 WHEN condition='open' AND flaw=1 THEN (g + 1) % 4 ELSE g END AS INT) AS gold_index,
 CASE WHEN condition='incorrect' THEN array_to_string(list_transform(wrong, lambda v: list_position(le, v) - 1), ',') END AS gold_set FROM z""")
def examples(spark, d):
    e = preparation.examples(preparation.pairs(_sources(spark, d)))
    join = lambda c: F.array_join(c, ",")
    return e.select("question_id", "condition", join("option_labels").alias("labels"), join("option_texts").alias("texts"), "options_displayed", "gold_text", "gold_index", join("gold_indices").alias("gold_set"))


_AUDIT = _SRC + """, a AS (SELECT question_id, condition, condition='open' OR (condition='no_symbols' AND flaw=3) AS question_changed, 4 AS option_count, NOT (gone OR (last AND g<>3)) AS order_same, NOT gone AS set_same,
 gone OR (condition='open' AND flaw=1) AS gold_changed, CASE WHEN condition<>'open' THEN last AND g<>3 END AS gold_moved, condition='incorrect' AS inverted,
 CASE condition WHEN 'open' THEN 'none' WHEN 'no_symbols' THEN 'bullets' ELSE 'labeled' END AS display, CASE WHEN roman THEN 'roman_label' WHEN condition='incorrect' THEN 'label_set' WHEN condition IN ('open','no_symbols') THEN 'text' ELSE 'letter_label' END AS format,
 FALSE AS duplicate_options, CASE WHEN condition='roman_numeral' AND flaw=5 THEN 'answer format observed=letter_label expected=roman_label; labels A,B,C,D' WHEN condition='none_of_the_provided' AND flaw=2 THEN 'gold text is ' || tx[g + 1] || '; original gold text still present'
 WHEN condition='fixed_pos' AND flaw=0 AND g<>3 THEN 'gold not in last position (index ' || g || ')' WHEN condition='incorrect' AND flaw=4 THEN 'gold set ' || array_to_string(wrong, ',') || ' != complement of mcq gold'
 WHEN condition='open' AND flaw=1 THEN 'gold text differs from mcq gold text' WHEN condition='no_symbols' AND flaw=3 THEN 'question changed' ELSE '' END AS problems FROM z)"""


def _audit(spark, d):
    return preparation.semantic_audit(preparation.examples(preparation.pairs(_sources(spark, d))))


@query(f"WITH {_AUDIT} SELECT * FROM a")
def semantic_audit(spark, d):
    return _audit(spark, d)


@query(f"""WITH {_AUDIT} SELECT condition, count(*) AS n, {", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in ("question_changed", "order_same", "set_same", "gold_changed", "gold_moved", "inverted", "duplicate_options"))},
 string_agg(DISTINCT format, ',' ORDER BY format) AS formats, count(*) FILTER (problems <> '') AS n_problems FROM a GROUP BY condition""")
def audit_summary(spark, d):
    return preparation.audit_summary(_audit(spark, d))


@query("SELECT p_type AS source_dataset, CAST(p_partkey AS VARCHAR) AS source_id, 6 AS n_rows, 6 AS n_conditions FROM part WHERE p_size % 10 = 6")
def unpaired_questions(spark, d):
    """Flaw 6: the open row is missing."""
    return preparation.unpaired(_sources(spark, d).where("flaw <> 6 OR condition <> 'open'"))


@query("""SELECT p_type AS source_dataset, CAST(p_partkey AS VARCHAR) AS source_id, CASE p_size % 10 WHEN 6 THEN 'missing perturbation rows' ELSE 'mcq baseline differs between perturbation rows' END AS problem
 FROM part WHERE p_size % 10 IN (6, 7)""")
def unbuildable_questions(spark, d):
    """Flaws 6 and 7: the open row is missing, or one row's baseline question is another."""
    rows = _sources(spark, d)
    p = preparation.pairs(rows.where("flaw <> 6 OR condition <> 'open'")).join(rows.where("condition = 'mcq'").select("source_dataset", "source_id", "flaw").hint("merge"), ["source_dataset", "source_id"])
    other = (F.col("flaw") == 7) & (F.col("perturbation_type") == "fixed_pos")
    return preparation.unbuildable(p.withColumn("original_question", F.when(other, F.lit("?")).otherwise(F.col("original_question"))))


@query("""WITH q AS (SELECT p_type || '::' || p_partkey AS q, p_size % 10 AS flaw FROM part)
SELECT 'missing record' AS "check", q || '/open' AS subject, '1' AS detail FROM q WHERE flaw=8 UNION ALL SELECT 'duplicate record', q || '/mcq', '2' FROM q WHERE flaw=9
UNION ALL SELECT 'invalid gold', q || '/fixed_pos', NULL FROM q WHERE flaw=0 UNION ALL SELECT 'extra record', q || '/other', '1' FROM q WHERE flaw=1""")
def structural_checks(spark, d):
    """Flaws of the records: 8 none for open, 9 two for mcq, 1 one that nobody asked for; 0 an example without gold."""
    src = _sources(spark, d)
    e = preparation.examples(preparation.pairs(src))
    flaw = src.where("condition = 'mcq'").select(F.concat("source_dataset", F.lit("::"), "source_id").alias("question_id"), "flaw")
    e = e.join(flaw.hint("merge"), "question_id")
    c, f = F.col("condition"), F.col("flaw")
    times = F.when((f == 8) & (c == "open"), 0).when((f == 9) & (c == "mcq"), 2).otherwise(1)
    extra = flaw.where("flaw = 1").select("question_id", F.lit("other").alias("condition"))
    records = e.select("question_id", "condition", F.explode(F.array_repeat(F.lit(0), times))).drop("col").unionByName(extra)
    return preparation.structural_checks(e.withColumn("gold_index", F.when(~((f == 0) & (c == "fixed_pos")), F.col("gold_index"))), records)


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS q, p_partkey AS k, p_size, lower(p_name) AS key, CASE WHEN p_partkey % 10 < 6 THEN 'train' WHEN p_partkey % 10 = 6 THEN 'val' WHEN p_partkey % 10 < 9 THEN 'diagnostic' WHEN p_size = 9 THEN 'holdout' ELSE 'final_test' END AS split FROM part),
m AS (SELECT q, split, key, k, p_size FROM p WHERE p_size <> 11 UNION ALL SELECT q, 'val', key, k, p_size FROM p WHERE k % 50 = 3 AND p_size <> 11), k AS (SELECT DISTINCT split, key FROM m WHERE split <> 'holdout'),
c AS (SELECT 'question id' AS "check", 'train/val' AS detail, count(*) AS n FROM p WHERE k % 50 = 3 AND p_size <> 11
UNION ALL SELECT 'question text', a.split || '/' || b.split, count(*) FROM k a JOIN k b ON a.key=b.key AND a.split<b.split GROUP BY ALL
UNION ALL SELECT 'pilot cohort', 'outside diagnostic', count(DISTINCT q) FROM m WHERE split NOT IN ('diagnostic','holdout') AND p_size = 7
UNION ALL SELECT 'pilot cohort', 'not in diagnostic', count(*) FROM p WHERE (k % 10 = 7 OR p_size = 7) AND q NOT IN (SELECT q FROM m WHERE split = 'diagnostic')
UNION ALL SELECT 'study cohort', 'not in diagnostic', count(*) FROM p WHERE k % 10 = 8 AND p_size = 11
UNION ALL SELECT 'completeness', 'not in the manifest', count(*) FROM p WHERE p_size = 11 UNION ALL SELECT 'rows of a question', 'not 6', count(*) FROM p WHERE p_size = 5
UNION ALL SELECT 'split name', 'unknown', count(*) FROM m WHERE split = 'holdout') SELECT * FROM c WHERE n > 0""")
def split_checks(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    m = k % 10
    split = F.when(m < 6, "train").when(m == 6, "val").when(m < 9, "diagnostic").when(size == 9, "holdout").otherwise("final_test")
    part = t(spark, d, "part").select("p_partkey", "p_size", k.cast("string").alias("question_id"), split.alias("split"), T.norm_alphanumeric(F.col("p_name")).alias("key"))
    listed = part.where("p_size <> 11")
    manifest = listed.select("question_id", "split").unionByName(listed.where(k % 50 == 3).select("question_id", F.lit("val").alias("split")))
    rows = part.select("question_id", "key", F.explode(F.array_repeat(F.lit(0), F.when(size == 5, 5).otherwise(6)))).drop("col")
    return preparation.split_checks(manifest, rows, {"pilot": part.where((m == 7) | (size == 7)), "study": part.where(m == 8)})


# ---- tables of the studies -------------------------------------------------------------------------------------------

_TWO = GRID + """, w AS (SELECT model, question_id, {0} FROM s GROUP BY ALL)""".format(
    ", ".join(f"bool_or(parsed) FILTER (condition='{c}') AS {a}_parsed, bool_or(correct) FILTER (condition='{c}') AS {a}_correct, max(answer) FILTER (condition='{c}') AS {a}_answer, max(gold) FILTER (condition='{c}') AS {a}_gold"
              for a, c in (("m", "mcq"), ("r", "roman_numeral"), ("n", "none_of_the_provided"), ("f", "fixed_pos")))
)
_COST = "CASE WHEN question_id % 5 <> 0 THEN (question_id % 8) * 0.25::DOUBLE END"
_MEAN = "avg({0}::INT::DOUBLE)".format
_PART = "count(*) FILTER ({0}) / nullif(CAST(count(*) FILTER ({1}) AS DOUBLE), 0)".format


def _with_cost(df):
    q = F.col("question_id")
    return df.withColumn("cost", F.when(q % 5 != 0, (q % 8) * 0.25))


@query(f"""WITH {_TWO}, k AS (SELECT model, count(*) AS n_calls, count(*) FILTER (NOT parsed) AS n_parse_failures, count(*) FILTER (NOT parsed) / CAST(count(*) AS DOUBLE) AS parse_failure_rate, coalesce(sum({_COST}), 0) AS cost, count({_COST}) AS n_known_costs
 FROM s WHERE condition IN ('mcq','roman_numeral') GROUP BY model)
SELECT model, n_calls, n_parse_failures, parse_failure_rate, cost, n_known_costs, {_MEAN("m_correct")} AS mcq_accuracy, {_MEAN("r_correct")} AS roman_accuracy, {_MEAN("r_correct")} - {_MEAN("m_correct")} AS accuracy_delta,
 {_PART("m_parsed AND r_parsed AND m_answer<>r_answer", "m_parsed AND r_parsed")} AS flip_rate, {_PART("m_correct AND r_correct", "m_parsed AND r_parsed")} AS reacc, {_PART("m_parsed AND r_parsed AND m_answer=r_answer", "m_parsed AND r_parsed")} AS recon,
 count(*) FILTER (m_parsed AND r_parsed) AS n_pairs FROM w JOIN k USING (model) GROUP BY ALL""")
def first_phase_metrics(spark, d):
    return phases.first_phase(_with_cost(scored(spark, d, (31, 37)).where(F.col("condition").isin("mcq", "roman_numeral"))))


@query(f"""WITH {_TWO} SELECT model, CASE WHEN NOT (m_parsed AND r_parsed) THEN 'unparseable' WHEN m_correct AND r_correct THEN 'stable_correct' WHEN NOT m_correct AND NOT r_correct AND m_answer<>r_answer THEN 'incorrect_to_different_incorrect'
 WHEN NOT m_correct AND NOT r_correct THEN 'stable_incorrect' WHEN m_correct THEN 'correct_to_incorrect' ELSE 'incorrect_to_correct' END AS category, count(*) AS n FROM w GROUP BY ALL""")
def outcome_categories(spark, d):
    return phases.outcome_categories(scored(spark, d, (31, 37)))


@query(f"WITH {GRID} SELECT model, condition, count(*) AS n, {_MEAN('parsed')} AS parse_ok_rate, {_PART('correct AND parsed', 'parsed')} AS accuracy_parsed FROM s GROUP BY ALL")
def call_summary(spark, d):
    return phases.call_summary(scored(spark, d, (31, 37)), "model", "condition")


@query(f"""WITH {_TWO} SELECT model, {_MEAN("m_correct")} AS mcq_accuracy, {_MEAN("r_correct")} AS roman_accuracy, {_MEAN("r_correct")} - {_MEAN("m_correct")} AS roman_delta,
 {_PART("m_parsed AND r_parsed AND m_answer<>r_answer", "m_parsed AND r_parsed")} AS roman_flip_rate, {_PART("m_correct AND r_correct", "m_parsed AND r_parsed")} AS roman_reacc, {_PART("m_parsed AND r_parsed AND m_answer=r_answer", "m_parsed AND r_parsed")} AS roman_recon,
 count(*) FILTER (m_parsed AND r_parsed) AS roman_n_pairs, {_MEAN("n_correct")} AS none_accuracy, {_MEAN("n_correct")} - {_MEAN("m_correct")} AS none_delta, {_PART("m_parsed AND n_parsed AND m_answer<>n_answer", "m_parsed AND n_parsed")} AS none_change_rate,
 count(*) FILTER (m_correct AND n_correct) AS none_cc, count(*) FILTER (m_correct AND NOT n_correct) AS none_cw, count(*) FILTER (NOT m_correct AND n_correct) AS none_wc, count(*) FILTER (NOT m_correct AND NOT n_correct) AS none_ww,
 count(*) FILTER (m_parsed AND n_parsed) AS none_n_pairs FROM w GROUP BY model""")
def second_phase_metrics(spark, d):
    return phases.second_phase(scored(spark, d, (31, 37)))


_CATEGORY = """CASE WHEN NOT (m_parsed AND {0}_parsed) THEN 'unparseable' WHEN m_gold<>{0}_gold THEN CASE WHEN {0}_answer={0}_gold THEN 'successful_adaptation' WHEN {0}_answer=m_answer THEN 'failure_to_adapt' ELSE 'adaptation_attempted_but_wrong' END
 WHEN m_correct AND {0}_correct THEN 'stable_correct' WHEN m_correct THEN 'presentation_instability' WHEN {0}_correct THEN 'unexpected_correction' ELSE 'stable_incorrect' END""".format


@query(f"WITH {_TWO} SELECT model, question_id, m_gold<>f_gold AS adaptation_required, {_CATEGORY('f')} AS category FROM w")
def adaptation_categories(spark, d):
    return phases.adaptation_categories(scored(spark, d, (31, 37)), "fixed_pos")


@query(f"""WITH {_TWO}, v AS (SELECT model, question_id, {_CATEGORY('n')} AS category FROM w)
SELECT model, condition, CASE WHEN NOT parsed THEN 'parsing_failure' WHEN condition='none_of_the_provided' AND category='presentation_instability' THEN 'presentation_instability'
 WHEN condition='mcq' AND NOT correct THEN 'possible_knowledge_error' ELSE 'insufficient_evidence' END AS failure, count(*) AS n FROM s JOIN v USING (model, question_id)
WHERE condition IN ('mcq','roman_numeral','none_of_the_provided') AND coalesce(NOT correct, TRUE) GROUP BY ALL""")
def observed_failures(spark, d):
    s = scored(spark, d, (31, 37)).where(F.col("condition").isin("mcq", "roman_numeral", "none_of_the_provided"))
    f = phases.observed_failure(F.col("condition"), F.col("parsed"), F.col("answer"), F.col("correct"), F.lit(4), F.col("category"))
    rows = s.join(phases.adaptation_categories(s).hint("merge"), ["model", "question_id"]).where(~S.is_true(F.col("correct")))
    return rows.groupBy("model", "condition", f.alias("failure")).agg(F.count("*").alias("n"))


@query(f"""WITH {GRID}, k AS (SELECT *, CASE WHEN question_id % 11 <> 0 THEN question_id % 7 END AS o, CASE WHEN question_id % 3 = 0 THEN question_id % 5 END AS th, question_id % 13 = 0 AS cut FROM s WHERE condition='mcq')
SELECT model, count(*) AS n_calls, count(*) FILTER (parsed) AS n_parsed, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT correct) AS n_incorrect, count(*) FILTER (cut) AS n_truncated, {_MEAN("parsed")} AS parse_rate,
 {_PART("correct", "parsed")} AS accuracy_parsed, sum(coalesce(o, 0)) / CAST(count(*) AS DOUBLE) AS mean_output_tokens, sum(coalesce(th, 0)) / CAST(count(*) AS DOUBLE) AS mean_thinking_tokens, sum((question_id % 4) * 0.5::DOUBLE) / count(*) AS mean_latency_s,
 sum(coalesce({_COST}, 0)) AS cost, count(*) FILTER (parsed) = count(correct) AS reconciled FROM k GROUP BY model""")
def third_phase_metrics(spark, d):
    q = F.col("question_id")
    calls = _with_cost(scored(spark, d, (31, 37)).where("condition = 'mcq'")).withColumn("output_tokens", F.when(q % 11 != 0, q % 7)).withColumn("thinking_tokens", F.when(q % 3 == 0, q % 5))
    calls = calls.withColumn("latency_s", (q % 4) * 0.5).withColumn("finish_reason", F.when(q % 13 == 0, F.lit("FinishReason.MAX_TOKENS")).otherwise("STOP"))
    return phases.third_phase(calls)


@query("""SELECT count(*) AS expected, count(*) FILTER (event_id % 3 <> 0 AND event_id % 7 <> 0) AS "new", count(*) FILTER (event_id % 3 = 0) AS cached, count(*) FILTER (event_id % 3 <> 0 AND event_id % 7 = 0) AS failed,
 CAST(coalesce(sum(event_id % 2) FILTER (event_id % 3 <> 0), 0) AS BIGINT) AS retries, coalesce(sum((event_id % 4) * 0.25::DOUBLE) FILTER (event_id % 3 <> 0), 0) AS cost FROM events""")
def run_summary(spark, d):
    e = F.col("event_id")
    log = t(spark, d, "events").select((e % 3 == 0).alias("cached"), ((e % 3 != 0) & (e % 7 == 0)).alias("failed"), (1 + e % 2).alias("attempts"), ((e % 4) * 0.25).alias("cost"))
    return phases.run_summary(log)
