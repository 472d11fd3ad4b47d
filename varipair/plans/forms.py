"""More named queries: prompts, schemas, shapes, joins and set tests. They join those of ``catalog`` on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import scoring as S
from ..functions import shapes as H
from ..functions import text as T
from ..operators import items, relational
from .catalog import GRID, query, scored, t


def _arr(xs):
    return F.array(*map(F.lit, xs))


_LETTERED = "(A) alpha\n(B) bravo\n(C) charlie\n(D) delta"
_TEXTS = {
    "mcq": f"{_LETTERED}\n\nAnswer with only the letter of the correct option (A, B, C, or D). {H.LABEL_TAIL}",
    "roman_numeral": f"(I) alpha\n(II) bravo\n(III) charlie\n(IV) delta\n\nAnswer with only the roman numeral of the correct option (I, II, III, or IV). {H.LABEL_TAIL}",
    "incorrect": f"{_LETTERED}\n\nExactly 3 of these options are INCORRECT. Answer with only the letters of all the incorrect options. {H.SET_TAIL.format('letter')}",
    "no_symbols": f"- alpha\n- bravo\n- charlie\n- delta\n\n{H.BULLET_TAIL}",
    "open": H.OPEN_TAIL,
}
_TEXTS |= {"none_of_the_provided": _TEXTS["mcq"], "fixed_pos": _TEXTS["mcq"]}
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in _TEXTS.items())


@query(f"""SELECT p_partkey AS question_id, c.condition, sha256('Question: ' || p_name || chr(10) || chr(10) || c.body) AS prompt_sha256,
 length('Question: ' || p_name || chr(10) || chr(10) || c.body) AS n_chars, CASE c.condition WHEN 'no_symbols' THEN 'bullets' WHEN 'open' THEN 'none' ELSE 'labeled' END AS display
 FROM part, (VALUES {_VALUES}) c(condition, body)""")
def prompts(spark, d):
    c = F.col("condition")
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("question_id"), "p_name", F.explode(_arr(S.CONDITIONS)).alias("condition"))
    labels = F.when(c == "roman_numeral", _arr(P.ROMAN)).otherwise(_arr(P.LETTERS))
    p = rows.withColumn("prompt", H.prompt(c, F.col("p_name"), labels, _arr(items.TEXTS)))
    return p.select("question_id", "condition", T.sha256(F.col("prompt")).alias("prompt_sha256"), F.length("prompt").cast("long").alias("n_chars"), H.observed_display(F.col("prompt")).alias("display"))


_ENUM = """'{"type": "string", "enum": ["' || array_to_string(o, '", "') || '"]}'"""


@query(f"""WITH k AS (SELECT doc_id, n_chars % 3 AS kind, list_slice(['A', 'B', 'C', 'D', 'E'], 1, CAST(n_chars % 4 + 2 AS INTEGER)) AS o FROM documents)
SELECT doc_id, '{{"type": "object", "properties": {{"answer": ' || CASE kind WHEN 0 THEN {_ENUM} WHEN 1 THEN '{{"type": "array", "items": ' || {_ENUM} || '}}' ELSE '{{"type": "string"}}' END || '}}, "required": ["answer"]}}' AS answer_schema FROM k""")
def answer_schemas(spark, d):
    """The schema of each document's answer, its kind and number of options by its length."""
    kind = F.get(_arr(["label", "label_set", "free_text"]), (F.col("n_chars") % 3).cast("int"))
    labels = F.slice(_arr(["A", "B", "C", "D", "E"]), F.lit(1), (F.col("n_chars") % 4 + 2).cast("int"))
    return t(spark, d, "documents").select("doc_id", H.answer_schema(kind, labels).alias("answer_schema"))


@query("""SELECT p_partkey AS question_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'A,B,C' END AS labels, CASE WHEN p_size % 5 <> 0 THEN p_name END AS first_text,
 CASE WHEN p_size % 5 <> 0 THEN (len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) + 3) / 3.0::DOUBLE END AS mean_words,
 CASE WHEN p_size % 5 <> 0 AND p_size % 4 < 3 THEN CAST(p_size % 4 AS INT) END AS gold_position FROM part""")
def option_shapes(spark, d):
    opts = F.when(F.col("p_size") % 5 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(F.col("p_name").alias("A"), F.lit("one").alias("B"), F.lit("two words").alias("C"))))
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.get(_arr(P.LETTERS), F.col("p_size") % 4).alias("gold"), H.options(opts).alias("o"))
    return rows.select("question_id", F.array_join(F.transform("o", lambda x: x["label"]), ",").alias("labels"), F.get("o", 0)["text"].alias("first_text"), H.mean_words(F.col("o")).alias("mean_words"), H.position(F.col("o"), F.col("gold")).alias("gold_position"))


_GOLDS = ["[A, B]", " IV ", "VII", "C", "K", "zinc oxide", "é", "É"]


@query("""SELECT doc_id, answer_format, observed_format FROM documents JOIN (VALUES (0,'list_of_letters','label_set'), (1,'roman_numeral','roman_label'), (2,'roman_numeral','text'), (3,'letter','letter_label'),
 (4,'letter','text'), (5,'free_text','text'), (6,'free_text','text'), (7,'letter','text'), (8,'unknown','text')) v(k, answer_format, observed_format) ON k = n_chars % 9""")
def answer_formats(spark, d):
    """The format of each document's gold answer, which is chosen by its length."""
    gold = F.get(F.array(*map(F.lit, [*_GOLDS, None])), (F.col("n_chars") % 9).cast("int"))
    return t(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", H.answer_format(gold).alias("answer_format"), H.observed_format(gold).alias("observed_format"))


@query(f"""SELECT cause, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN '{H.CUT_EMPTY}' ELSE '{H.CUT_SHORT}' END
 WHEN event_id % 2 = 0 THEN '{H.EMPTY_END}' ELSE '{H.UNREADABLE}' END AS cause FROM events) GROUP BY cause""")
def missing_causes(spark, d):
    e = F.col("event_id")
    rows = t(spark, d, "events").select(H.missing_cause(F.when(e % 3 == 0, "MAX_TOKENS").otherwise("STOP"), F.when(e % 2 == 0, F.lit(" ")).otherwise(F.col("props"))).alias("cause"))
    return rows.groupBy("cause").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS question_id, CASE p_partkey % 4 WHEN 0 THEN '{"answer": "x"}' WHEN 1 THEN '{"answer":"' || p_name || '"}' WHEN 2 THEN '{"answer": "y"}' ELSE '{"answer":"plain"}' END AS contract FROM part""")
def contracts(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.lit('{"answer": "x"}')).when(k == 1, F.col("p_name")).when(k == 2, F.lit('```json\n{"answer": "y"}\n```')).otherwise(F.lit("```\nplain\n```"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("question_id"), H.contract(raw).alias("contract"))


@query("""SELECT conv_id, last(text ORDER BY turn) AS completion FROM conversations GROUP BY conv_id""")
def completion_texts(spark, d):
    chat = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("m"))
    return chat.select("conv_id", H.completion_text(F.col("m")).alias("completion"))


@query("""SELECT p_partkey AS question_id, p_brand || '__' || replace(p_name, '/', '_') AS safe, p_brand AS source_dataset, p_name AS source_id,
 CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '... [truncated, full length=' || length(p_name) || ']' ELSE p_name END AS shortened FROM part""")
def key_shapes(spark, d):
    key = F.concat("p_brand", F.lit("::"), "p_name")
    return t(spark, d, "part").select(F.col("p_partkey").alias("question_id"), H.safe_id(key).alias("safe"), H.key_parts(key).alias("k"), H.shortened(F.col("p_name"), 8).alias("shortened")).select("question_id", "safe", "k.*", "shortened")


_THREE = GRID.replace("(1,37))", "(1,37),(2,41))")


@query(f"""WITH {_THREE}, j AS (SELECT b.correct AS b, m.correct AS m, l.correct AS l FROM s b JOIN s m USING (question_id, condition) JOIN s l USING (question_id, condition) WHERE b.model=0 AND m.model=1 AND l.model=2)
SELECT count(*) AS n, count(*) FILTER (NOT b AND NOT m AND l) AS rescues, count(*) FILTER ((coalesce(b, FALSE) OR coalesce(m, FALSE)) AND NOT l) AS hurts,
 count(*) FILTER (NOT b AND NOT m AND l) - count(*) FILTER ((coalesce(b, FALSE) OR coalesce(m, FALSE)) AND NOT l) AS net FROM j""")
def rescue_hurt_three(spark, d):
    return relational.rescues_of(scored(spark, d, (31, 37, 41)), (0, 1, 2), ["question_id", "condition"])


@query("SELECT l_returnflag, count(*) AS n, max(abs(l_discount - l_tax)) AS max_abs_diff, avg(abs(l_discount - l_tax)) AS mean_abs_diff, avg((sign(l_discount) = sign(l_tax))::INT::DOUBLE) AS sign_match FROM lineitem GROUP BY l_returnflag")
def score_stability(spark, d):
    return relational.stability(t(spark, d, "lineitem"), "l_discount", "l_tax", "l_returnflag")


@query("""WITH c AS (SELECT p_size // 7 * 2 AS position, count(*) AS n FROM part GROUP BY 1) SELECT CAST(x AS BIGINT) AS position, CAST(coalesce(n, 0) AS BIGINT) AS n
 FROM (SELECT unnest(range(0, (SELECT max(position) FROM c) + 1)) AS x) LEFT JOIN c ON c.position = x""")
def position_histogram(spark, d):
    return relational.histogram(t(spark, d, "part").select((F.floor(F.col("p_size") / 7) * 2).alias("p")), "p")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, place FROM r WHERE n <= 5 OR list_contains([i * (n - 1) // 4 FOR i IN range(0, 5)], place)""")
def evenly_spaced_rows(spark, d):
    return relational.evenly_spaced(t(spark, d, "part").select("p_brand", "p_partkey"), "p_partkey", 5, "p_brand")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")
def top_types(spark, d):
    return relational.most_common(t(spark, d, "part"), "p_type", 5)


@query("SELECT coalesce(CAST(l.quality AS VARCHAR), 'missing') AS split, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def split_lookup(spark, d):
    j = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("missing")).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag")
def cohort_rows(spark, d):
    cohort = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").join(cohort, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer), n AS (SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS a_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS b_only)
SELECT a_only, b_only, a_only = 0 AS a_in_b, b_only = 0 AS b_in_a, a_only = 0 AND b_only = 0 AS equal FROM n""")
def id_containment(spark, d):
    return relational.contained(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT p_brand, avg((p_size > 25)::INT::DOUBLE) AS accuracy, CASE WHEN avg((p_size > 25)::INT::DOUBLE) >= 0.5 THEN 'STOP' ELSE 'PASS' END AS decision FROM part GROUP BY p_brand")
def gate_decisions(spark, d):
    a = t(spark, d, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") > 25).cast("double")).alias("accuracy"))
    return relational.gate(a, F.lit(True), "accuracy", 0.5)


@query(f"""WITH {GRID}, o AS (SELECT condition, row_number() OVER (ORDER BY ci) - 1 AS ord FROM conds) SELECT CAST(ord AS INT) AS ord, condition, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM s JOIN o USING (condition) WHERE model = 0 GROUP BY ALL""")
def conditions_in_order(spark, d):
    c = scored(spark, d).groupBy("condition").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return c.select((F.array_position(_arr(S.CONDITIONS), F.col("condition")) - 1).cast("int").alias("ord"), "*").orderBy("ord")
