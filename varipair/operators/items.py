"""Items, responses, scored and paired tables. `model` is an ordinary key column everywhere.

``items_from_parts`` derives a deterministic question grid from the `part` table, so that every operator can be
run and checked on the driver's tables; real items and responses enter at ``score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import scoring as S
from ..functions import text as T

TEXTS = ["alpha", "bravo", "charlie", "delta"]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small file would leave costly expressions to one of them; larger inputs, which
    come in as many partitions, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def items_from_parts(part: DataFrame, multipliers: tuple[int, ...] = (31,)) -> DataFrame:
    """(model, question_id, source_dataset, ci, condition, gold, raw_response): one narrow expansion, no join."""
    conds = F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(c).alias("condition")) for i, c in enumerate(S.CONDITIONS)])
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in enumerate(multipliers)])
    part = spread(part.select("p_partkey", "p_type", "p_size"))
    rows = part.select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("source_dataset"), "p_size", F.explode(models).alias("m"), F.lit(conds).alias("conds"))
    rows = rows.select("question_id", "source_dataset", "p_size", "m.*", F.explode("conds").alias("c")).select("*", "c.*").drop("c")
    gold = F.when(F.col("condition") == "fixed_pos", F.lit(3)).otherwise(F.pmod(F.col("question_id") * 7 + 3, F.lit(4)).cast("int"))
    r = F.pmod(F.col("question_id") * F.col("k") + F.col("ci") * 17 + F.col("p_size") * (F.col("ci") + 3), F.lit(97)).cast("int")
    rows = rows.withColumn("gold", gold).withColumn("r", r)
    sel = F.when(F.col("r") < 6, 4).when(F.col("r") < 60, F.col("gold")).otherwise(F.pmod(F.col("gold") + 1 + F.pmod("r", F.lit(3)), F.lit(4)))
    rows = rows.withColumn("sel", sel.cast("int"))
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("sel"))
    rest = F.filter(F.array(*map(F.lit, P.LETTERS)), lambda x: x != pick(P.LETTERS))
    answer = (
        F.when(F.col("condition").isin("open", "no_symbols"), F.when(F.col("sel") == 4, F.lit('{"answer": "unsure"}')).otherwise(F.concat(F.lit('{"answer": "The '), pick(TEXTS), F.lit('"}'))))
        .when(F.col("sel") == 4, F.lit("no idea"))
        .when(F.col("condition") == "roman_numeral", F.concat(F.lit('{"answer": "'), pick(P.ROMAN), F.lit('"}')))
        .when(F.col("condition") == "incorrect", F.concat(F.lit('{"answer": '), F.to_json(rest), F.lit("}")))
        .otherwise(F.concat(F.lit('{"answer": "'), pick(P.LETTERS), F.lit('"}')))
    )
    return once(rows.select("model", "question_id", "source_dataset", "ci", "condition", "gold", "sel"), "raw_response", answer).drop("sel")


def once(df: DataFrame, name: str, value) -> DataFrame:
    """df with a column that is computed once, however often later columns use it: the optimiser merges projections
    and so repeats expressions, but does not look through an expansion (here of one row to one row)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def score(items: DataFrame) -> DataFrame:
    """Parse and evaluate raw_response: adds parsed, evaluable, correct, chosen, chosen_text, implied, set_size, match_method.

    A free answer that matches no option is wrong where options are shown and not evaluable where they are hidden."""
    c = F.col("condition")
    label_at = lambda label, labels: F.nullif(F.array_position(F.array(*map(F.lit, labels)), label), F.lit(0)) - 1
    raw, found = F.col("raw_response"), F.col("_a")
    items = once(items, "_a", P.strict_answer(raw))
    labels = F.when(c == "roman_numeral", P.parse_label(raw, P.ROMAN, found)["label"]).when(~c.isin("incorrect", "open", "no_symbols"), P.parse_label(raw, P.LETTERS, found)["label"])
    free = F.when(c.isin("open", "no_symbols"), P.parse_free_text(raw, found)["text"])
    chosen_set = F.when(c == "incorrect", P.parse_label_set(raw, P.LETTERS, found)["labels"])
    df = once(items, "_p", F.struct(labels.alias("label"), free.alias("free"), F.transform(chosen_set, lambda x: (F.array_position(F.array(*map(F.lit, P.LETTERS)), x) - 1).cast("int")).alias("set")))
    df = once(df, "_match", F.when(F.col("_p.free").isNotNull(), T.match_option(F.col("_p.free"), F.array(*map(F.lit, TEXTS)))))
    df = df.withColumn("_set", F.col("_p.set")).withColumn("_free", F.col("_p.free"))
    letter = roman = F.col("_p.label")
    df = df.withColumn("chosen", F.when(c == "roman_numeral", label_at(roman, P.ROMAN)).when(c.isin("open", "no_symbols"), F.col("_match.idx").cast("long")).when(c != "incorrect", label_at(letter, P.LETTERS)).cast("int"))
    df = df.withColumn("implied", S.implied_index(F.col("_set"))).withColumn("set_size", F.when(F.col("_set").isNotNull(), F.size("_set")))
    df = df.withColumn("match_method", F.col("_match.method"))
    df = df.withColumn("parsed", F.when(c == "incorrect", F.col("_set").isNotNull()).when(c.isin("open", "no_symbols"), F.col("_free").isNotNull()).otherwise(F.col("chosen").isNotNull()))
    df = df.withColumn("evaluable", F.col("parsed") & F.when(c == "open", F.col("chosen").isNotNull()).otherwise(F.lit(True)))
    answer = F.when(c == "incorrect", F.col("implied")).otherwise(F.col("chosen"))
    df = df.withColumn("answer", answer).withColumn("correct", F.when(F.col("evaluable"), F.coalesce(answer == F.col("gold"), F.lit(False))))
    return df.withColumn("answer_text", F.get(F.array(*map(F.lit, TEXTS)), F.col("answer"))).drop("_set", "_free", "_match", "_p", "_a")


def with_baseline(scored: DataFrame) -> DataFrame:
    """Each row with evaluable, correct, answer, answer_text and gold of its question's baseline as mcq_*, null where there
    is none. The baseline travels within its question: one shuffle, and the rows are scored once."""
    names = ("evaluable", "correct", "answer", "answer_text", "gold")
    mcq = F.first(F.when(F.col("condition") == "mcq", F.struct(*names)), ignorenulls=True).over(Window.partitionBy("model", "question_id"))
    df = scored.withColumn("_mcq", F.when(F.col("question_id").isNotNull(), mcq))
    return df.select("*", F.col("_mcq").isNotNull().alias("has_mcq"), *[F.col(f"_mcq.{n}").alias(f"mcq_{n}") for n in names]).drop("_mcq")


def compared(scored: DataFrame) -> DataFrame:
    """All rows, each condition against its question's baseline: both_evaluable, transition, changes, adaptation; null in
    the baseline's own rows and where a question has none. Nothing is labelled unless both sides are evaluable."""
    p = with_baseline(scored).withColumn("paired", F.col("has_mcq") & (F.col("condition") != "mcq"))
    both = F.when(F.col("paired"), F.col("evaluable") & F.col("mcq_evaluable"))
    change = lambda x, y: F.when(both & x.isNotNull() & y.isNotNull(), x != y)
    return (
        p.withColumn("both_evaluable", both)
        .withColumn("transition", F.when(both, S.transition(F.col("mcq_correct"), F.col("correct"))))
        .withColumn("position_changed", F.when(F.col("condition") != "open", change(F.col("answer"), F.col("mcq_answer"))))
        .withColumn("semantic_changed", change(F.col("answer_text"), F.col("mcq_answer_text")))
        .withColumn("adaptation", F.when(both, S.adaptation(F.col("condition"), F.col("correct"), F.col("answer_text"), F.col("mcq_answer_text"), F.col("set_size"))))
    )


def pair(scored: DataFrame) -> DataFrame:
    """The rows of `compared` that have a baseline to be compared with."""
    return compared(scored).where("paired")


def with_failure(scored: DataFrame) -> DataFrame:
    """Adds failure. Columns api_error and truncated of the responses count where they exist."""
    base = with_baseline(scored).withColumnsRenamed({"mcq_correct": "base_correct", "mcq_evaluable": "base_evaluable"}).drop("mcq_answer", "mcq_answer_text", "mcq_gold", "has_mcq")
    flag = lambda name: F.col(name) if name in scored.columns else F.lit(False)
    f = S.failure(*map(F.col, ("condition", "parsed", "evaluable", "correct", "set_size", "match_method", "base_correct", "base_evaluable")), flag("api_error"), flag("truncated"))
    return base.withColumn("failure", f)


def incomplete(rows: DataFrame, keys: list[str], part: str, expected: int) -> DataFrame:
    """Keys without each of the expected parts, with how many they have."""
    return rows.groupBy(*keys).agg(F.count_distinct(part).alias("n_parts")).where(F.col("n_parts") < expected)
