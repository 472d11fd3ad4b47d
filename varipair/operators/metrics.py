"""Aggregates over scored and paired tables. Undefined ratios are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import norm_words
from . import stats


def rate(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


#: Columns of the responses that are averaged where they exist.
USAGE = ("input_tokens", "output_tokens", "thinking_tokens", "latency_s", "cost_usd")


def by_condition(compared: DataFrame) -> DataFrame:
    """Per condition: counts, accuracy, the pair figures, usage. Bounds, where every unmatched answer is wrong or right, are
    of `open` alone; joint rates of the conditions whose answer is meant to stay. One pass over the compared rows; columns
    of the responses that are missing (api_error, truncated, USAGE) count as false or unknown."""
    has = lambda name, kind: F.col(name) if name in compared.columns else F.lit(None).cast(kind)
    ok, parsed, evaluable, c = F.count_if("correct"), F.count_if("parsed"), F.count_if("evaluable"), F.col("condition")
    pairs, stays, opened = c != "mcq", c.isin(*S.INVARIANCE), c == "open"
    names = {"cc": "C->C", "cw": "C->W", "wc": "W->C", "ww": "W->W"}
    n_pairs, known = F.count_if("both_evaluable"), F.count("semantic_changed")
    usage = {x: has(x, "double") for x in USAGE}
    return compared.groupBy("condition").agg(
        F.count("*").alias("n"), F.count_if(has("api_error", "boolean")).alias("n_api_failures"), F.count_if(has("truncated", "boolean")).alias("n_truncated"),
        parsed.alias("n_parsed"), evaluable.alias("n_evaluable"), (parsed - evaluable).alias("n_ambiguous"), ok.alias("n_correct"),
        rate(parsed, F.count("*")).alias("parse_rate"), rate(ok, evaluable).alias("accuracy"),
        F.when(opened, rate(ok, parsed)).alias("lower_bound"), F.when(opened, rate(ok + parsed - evaluable, parsed)).alias("upper_bound"),
        *[F.avg(usage[x]).alias(f"mean_{x}") for x in USAGE[:4]], F.max(usage["thinking_tokens"]).alias("max_thinking_tokens"), F.coalesce(F.sum(usage["cost_usd"]), F.lit(0.0)).alias("cost_usd"),
        F.when(pairs, n_pairs).alias("n_pairs"), *[F.when(pairs, F.count_if(F.col("transition") == v)).alias(k) for k, v in names.items()],
        F.when(pairs, rate(F.count_if("position_changed"), F.count("position_changed"))).alias("position_change_rate"),
        F.when(pairs, rate(F.count_if("semantic_changed"), known)).alias("semantic_change_rate"),
        F.when(stays, rate(F.count_if(F.col("both_evaluable") & S.is_true(F.col("mcq_correct")) & S.is_true(F.col("correct"))), n_pairs)).alias("reacc"),
        F.when(stays, rate(F.count_if(~F.col("semantic_changed")), known)).alias("recon"), F.when(pairs, stays).alias("recon_defined"),
    )


def group_consistency(scored: DataFrame) -> DataFrame:
    """Joint right and joint same-answer rates over the baseline and the conditions that keep the meaning; only
    questions evaluable on all of them. Texts are compared after normalisation; a missing one is a text too."""
    per = scored.where(F.col("condition").isin("mcq", *S.INVARIANCE)).groupBy("model", "question_id").agg(
        F.count_if("evaluable").alias("e"), F.bool_and(S.is_true(F.col("correct"))).alias("right"), F.count_distinct(norm_words(F.col("answer_text"))).alias("answers")
    )
    per = per.where(F.col("e") == 1 + len(S.INVARIANCE))
    return per.groupBy("model").agg(F.count("*").alias("n_questions"), rate(F.count_if("right"), F.count("*")).alias("joint_reacc"), rate(F.count_if(F.col("answers") == 1), F.count("*")).alias("joint_recon"))


def transitions_long(paired: DataFrame) -> DataFrame:
    """condition, kind, label, n: transitions, adaptations, and one row for what is excluded."""
    t = paired.where("transition IS NOT NULL").groupBy("condition", F.lit("transition").alias("kind"), F.col("transition").alias("label")).agg(F.count("*").alias("n"))
    a = paired.where("adaptation IS NOT NULL").groupBy("condition", F.lit("adaptation").alias("kind"), F.col("adaptation").alias("label")).agg(F.count("*").alias("n"))
    x = paired.groupBy("condition", F.lit("excluded").alias("kind"), F.lit("not_evaluable").alias("label")).agg(F.count_if(~F.col("both_evaluable")).alias("n"))
    return t.unionByName(a).unionByName(x)


def transitions_wide(paired: DataFrame) -> DataFrame:
    wide = paired.groupBy("condition").pivot("transition", ["C->C", "C->W", "W->C", "W->W"]).count()
    return wide.na.fill(0).withColumnsRenamed({"C->C": "cc", "C->W": "cw", "W->C": "wc", "W->W": "ww"})


def failure_taxonomy(with_failure: DataFrame) -> DataFrame:
    return with_failure.where("failure IS NOT NULL").groupBy("model", "failure").agg(F.count("*").alias("n"))


def main_table(compared: DataFrame) -> DataFrame:
    """Per model: mean accuracies by group, the adaptation failure rate over all pairs, and joint right rate where
    an answer that could not be scored counts as right. One pass: sums by question, then by model."""
    c, groups = F.col("condition"), {"mcq": ["mcq"], "invariance": S.INVARIANCE, "adaptation": S.ADAPTATION}
    asked = F.col("paired") & c.isin(*S.ADAPTATION)
    sums = [f(F.when(c.isin(*g), F.col("correct").cast("int"))).alias(f"{k}_{name}") for name, g in groups.items() for k, f in (("sum", F.sum), ("n", F.count))]
    per = compared.groupBy("model", "question_id").agg(*sums, F.count_if(asked).alias("pairs"), F.count_if(asked & F.col("adaptation").startswith("failure")).alias("failed"), F.bool_and(F.when(c.isin("mcq", *S.INVARIANCE), F.coalesce("correct", F.lit(True)))).alias("right"))
    means = [rate(F.sum(f"sum_{name}"), F.sum(f"n_{name}")).alias(f"{name}_accuracy") for name in groups]
    return per.groupBy("model").agg(*means, rate(F.sum("failed"), F.sum("pairs")).alias("adaptation_failure_rate"), rate(F.count_if("right"), F.count("right")).alias("joint_reacc"))


def rescue_hurt(scored: DataFrame, base: int, other: int) -> DataFrame:
    """Per condition: answers that only the other model gets right, or only the base model."""
    both = stats.of_both(scored, base, other, {"right": F.col("correct")})
    b, o = F.col("right_a"), F.col("right_b")
    return both.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(~b & o).alias("rescues"), F.count_if(b & ~o).alias("hurts")).withColumn("net", F.col("rescues") - F.col("hurts"))


def rewards(scored: DataFrame) -> DataFrame:
    from ..functions.parsing import format_reward

    rc, rs = S.reward_correct(F.col("condition"), F.col("correct")), S.reward_symbolic(*map(F.col, ("condition", "parsed", "correct", "answer", "set_size")))
    return scored.withColumn("r_correct", rc).withColumn("r_symbolic", rs).withColumn("r_format", format_reward(F.col("raw_response"))).withColumn("r_total", S.reward_total(F.col("r_correct"), F.col("r_symbolic"), F.col("r_format")))
