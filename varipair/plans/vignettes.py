"""Queries of the rules and their vignettes. A labelled document is a template: its id chooses the rule and the number i.

The SQL takes the rules' values as tables and states by joins what the engine does by one expression a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counterfactual
from ..operators import rules as R
from .catalog import query, t


def _templates(spark, d) -> DataFrame:
    n = len(R.RULES)
    rule = F.get(F.array(*[F.lit(r["rule_id"]) for r in R.RULES]), F.pmod("doc_id", F.lit(n)).cast("int"))
    return t(spark, d, "labels").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("template_id"), rule.alias("rule_id"), F.expr(f"CAST(doc_id div {n} % 30 AS INT)").alias("i"))


def _q(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, list):
        return "[" + ", ".join(map(_q, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)


def _values(name: str, columns: str, rows: list) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, row)) + ")" for row in rows) + ")"


_OF = lambda key, *fields: [(r["rule_id"], *(float(x[f]) if f in ("start", "step") else x.get(f) for f in fields)) for r in R.RULES for x in r[key]]
_SHOWN = ", ".join(f"coalesce(max(value) FILTER (own AND field = '{n}'), max(value) FILTER (NOT own AND field = '{n}'), '') AS {n}" for n in R.NAMED)


def _filled(text: str) -> str:
    for n in R.NAMED:
        text = f"replace({text}, '{{{n}}}', {n})"
    return text


def _line(n: int, default: str) -> str:
    return _filled(f"coalesce((SELECT min(text) FROM li WHERE li.rule_id = p.rule_id AND li.item = p.kind AND line = {n}), (SELECT min(text) FROM li WHERE li.rule_id = p.rule_id AND li.item = 'base' AND line = {n}), {default})")


VIGNETTES = f"""
{_values("ru", "ri, rule_id, family, split, indication, female, default_action, rule_action", [(k, r["rule_id"], r["family"], r["split"], r["indication"], r["female"], r["default_action"], r["rule_action"]) for k, r in enumerate(R.RULES)])},
{_values("co", "rule_id, field, op, number, choices", [(r["rule_id"], c["field"], c["op"], float(c.get("number", 0)), c.get("choices", ["-"])) for r in R.RULES for c in r["conditions"]])},
{_values("nu", "rule_id, item, field, start, modulo, step", _OF("numbers", "item", "field", "start", "modulo", "step"))},
{_values("te", "rule_id, item, field, choices", _OF("texts", "item", "field", "choices"))},
{_values("li", "rule_id, item, line, text", _OF("lines", "item", "line", "text"))},
tp AS (SELECT doc_id AS template_id, doc_id // {len(R.RULES)} % 30 AS i, ru.* FROM labels JOIN ru ON ri = doc_id % {len(R.RULES)}),
it AS (SELECT *, 25 + CAST(round_even(i * 55 / 29.0, 0) AS INTEGER) AS age, CASE WHEN female OR i % 2 = 0 THEN 'female' ELSE 'male' END AS sex, CASE WHEN item_type = 'null_edit' THEN 'base' ELSE item_type END AS kind,
  CASE WHEN item_type = 'null_edit' THEN i + 1 ELSE i END AS turn FROM (SELECT *, unnest({_q(R.ITEM_TYPES)}) AS item_type FROM tp)),
fa AS (SELECT it.template_id, item_type, x.item = kind AS own, x.field, x.value FROM it JOIN (
   SELECT tp.template_id, item, field, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS value FROM (SELECT tp.template_id, item, field, round(start + (i % modulo) * step, 2) AS v FROM tp JOIN nu USING (rule_id)) tp
   UNION ALL SELECT template_id, item, field, choices[CAST(i % len(choices) AS INTEGER) + 1] FROM tp JOIN te USING (rule_id)
   UNION ALL SELECT template_id, 'base', unnest(['pregnant', 'beta_hcg']), unnest(['false', 'negative']) FROM tp WHERE female OR i % 2 = 0) x ON x.template_id = it.template_id AND x.item IN (kind, 'base')),
fi AS (SELECT it.template_id, item_type, bool_and(coalesce(CASE op WHEN '<' THEN TRY_CAST(value AS DOUBLE) < number WHEN '>=' THEN TRY_CAST(value AS DOUBLE) >= number ELSE list_contains(choices, value) END, FALSE)) AS fired
  FROM it JOIN co USING (rule_id) LEFT JOIN (SELECT * FROM fa WHERE own) f USING (template_id, item_type, field) GROUP BY ALL),
p AS (SELECT it.*, {", ".join(f"s.{n}" for n in R.NAMED)} FROM it LEFT JOIN (SELECT template_id, item_type, {_SHOWN} FROM fa GROUP BY ALL) s USING (template_id, item_type)),
vi AS (SELECT p.template_id, item_type, p.rule_id, family, split, i, age, sex, fired, CASE WHEN fired THEN rule_action ELSE default_action END AS action,
  'Clinical Vignette:' || chr(10) || CASE WHEN starts_with(CAST(age AS VARCHAR), '8') THEN 'An' ELSE 'A' END || ' ' || age || '-year-old ' || sex || ' presents ' || {_q(R.SETTINGS)}[CAST(turn % {len(R.SETTINGS)} AS INTEGER) + 1] || ' for management of ' || indication || '. {R.PRESENTATION}' || chr(10)
  || {_line(3, "''")} || chr(10) || {_line(4, "CASE WHEN sex = 'female' THEN 'Reproductive status: non-pregnant.' ELSE 'Reproductive status: not applicable.' END")} || chr(10) || {_line(5, "'Drug allergies: none.'")} || chr(10) || {_line(6, "'Family history: noncontributory.'")} || chr(10)
  || {_q(R.FINDINGS)}[CAST(turn % {len(R.FINDINGS)} AS INTEGER) + 1] || chr(10) || chr(10) || '{R.QUESTION}' AS prompt
  FROM p JOIN fi USING (template_id, item_type))"""


@query(f"WITH {VIGNETTES} SELECT template_id, item_type, rule_id, split, CAST(age AS INTEGER) AS age, sex, fired, action, md5(prompt) AS prompt_md5 FROM vi")
def rule_vignettes(spark, d):
    rules = R.rule_table(spark)
    v = R.verify(R.vignettes(_templates(spark, d), rules), rules)
    return v.select("template_id", "item_type", "rule_id", "split", "age", "sex", "fired", "action", F.md5("prompt").alias("prompt_md5"))


@query(f"""WITH {VIGNETTES}, b AS (SELECT *, item_type = 'edited' AND template_id % 17 = 0 AS lost, item_type = 'near_miss' AND template_id % 19 = 0 AS worded, item_type = 'null_edit' AND template_id % 23 = 0 AS misnamed, item_type = 'edited' AND template_id % 29 = 0 AS moved FROM vi)
SELECT rule_id, count(*) AS n_items, CAST(min(age) AS INTEGER) AS min_age, CAST(max(age) AS INTEGER) AS max_age, count(*) FILTER (sex = 'female') AS n_female, count(*) FILTER (sex = 'male') AS n_male,
 count(*) FILTER (lost OR worded OR (fired <> (item_type = 'edited'))) AS unsound, count(*) FILTER (worded) AS form, 0::BIGINT AS dose, count(*) FILTER (misnamed) AS article, count(*) FILTER (moved) AS wrong_lines FROM b GROUP BY rule_id""")
def rule_checks(spark, d):
    """The checks over vignettes some of which are spoilt: facts lost, an action worded, an article or a line changed."""
    rules, k, item = R.rule_table(spark), F.col("template_id"), F.col("item_type")
    v = R.vignettes(_templates(spark, d), rules)
    v = v.withColumn("facts", F.when((item == "edited") & (k % 17 == 0), F.map_from_entries(F.slice(F.map_entries("facts"), 1, 0))).otherwise(F.col("facts")))
    v = v.withColumn("chosen", F.when((item == "near_miss") & (k % 19 == 0), F.concat("chosen", F.lit(" instead"))).otherwise(F.col("chosen")))
    swapped = F.when(F.col("prompt").rlike(r"\nAn \d"), F.regexp_replace("prompt", r"\nAn (\d)", "\nA $1")).otherwise(F.regexp_replace("prompt", r"\nA (\d)", "\nAn $1"))
    v = v.withColumn("prompt", F.when((item == "null_edit") & (k % 23 == 0), swapped).when((item == "edited") & (k % 29 == 0), F.replace("prompt", F.lit("Question:"), F.lit("Question :"))).otherwise(F.col("prompt")))
    return R.checks(v, rules)


@query(f"WITH {VIGNETTES}, w AS (SELECT rule_id, len(string_split(default_action, ' ')) AS a, len(string_split(rule_action, ' ')) AS b FROM ru) SELECT family, split, count(*) AS n_templates, avg(abs(a - b)) AS mean_word_difference FROM tp JOIN w USING (rule_id) GROUP BY family, split")
def action_lengths(spark, d):
    """How far the lengths of the two actions differ, by family and split of the templates."""
    n = lambda c: F.size(F.split(F.col(f"rule.{c}"), " "))
    j = R.with_rule(_templates(spark, d), R.rule_table(spark))
    return j.groupBy("rule.family", "rule.split").agg(F.count("*").alias("n_templates"), F.avg(F.abs(n("default_action") - n("rule_action"))).alias("mean_word_difference"))


@query(f"WITH {VIGNETTES} SELECT rule_id, split, item_type, count(*) AS n, count(*) FILTER (fired) AS n_fired, count(*) FILTER (fired = (item_type = 'edited')) AS n_sound FROM vi GROUP BY rule_id, split, item_type")
def vignette_verifier(spark, d):
    rules = R.rule_table(spark)
    v = R.verify(R.vignettes(_templates(spark, d), rules), rules)
    return v.groupBy("rule_id", "split", "item_type").agg(F.count("*").alias("n"), F.count_if("fired").alias("n_fired"), F.count_if(F.col("fired") == (F.col("item_type") == "edited")).alias("n_sound"))


@query()
def response_only_accuracy(spark, d):
    return counterfactual.response_only(R.vignettes(_templates(spark, d), R.rule_table(spark)))
