"""Metric tables of the smaller studies: one row per model, from scored responses. A question's conditions are brought
together by one aggregation on (model, question_id), which also carries the sums over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_true, outcome_category

#: What a table counts as cut off.
CUT = "MAX_TOKENS"


def _share(n: Column, of: Column) -> Column:
    return n / F.nullif(of, F.lit(0))


def by_question(scored: DataFrame, *conditions: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per model and question with parsed, correct, answer and gold of each named condition."""
    of = lambda name, c: F.max(F.when(F.col("condition") == c, F.col(name))).alias(f"{c}_{name}")
    return scored.groupBy("model", "question_id").agg(*[of(name, c) for c in conditions for name in ("parsed", "correct", "answer", "gold")], *also)


def _against_mcq(c: str) -> tuple[Column, ...]:
    """both parsed, changed, and both right, of a condition beside the baseline."""
    both = is_true(F.col("mcq_parsed")) & is_true(F.col(f"{c}_parsed"))
    return both, both & ~F.col("mcq_answer").eqNullSafe(F.col(f"{c}_answer")), both & is_true(F.col("mcq_correct")) & is_true(F.col(f"{c}_correct"))


def _accuracy(c: str) -> Column:
    return F.avg(F.col(f"{c}_correct").cast("double"))


def first_phase(scored: DataFrame, cost: str = "cost") -> DataFrame:
    """Parse failures, both accuracies and their difference, flips, both right, both same, and known costs."""
    calls = (F.count("*").alias("calls"), F.count_if(~F.col("parsed")).alias("failures"), F.sum(cost).alias("spent"), F.count(cost).alias("known"))
    q = by_question(scored, "mcq", "roman_numeral", also=calls)
    both, flipped, right = _against_mcq("roman_numeral")
    n = F.count_if(both)
    return q.groupBy("model").agg(
        F.sum("calls").alias("n_calls"), F.sum("failures").alias("n_parse_failures"), _share(F.sum("failures"), F.sum("calls")).alias("parse_failure_rate"),
        _accuracy("mcq").alias("mcq_accuracy"), _accuracy("roman_numeral").alias("roman_accuracy"), (_accuracy("roman_numeral") - _accuracy("mcq")).alias("accuracy_delta"),
        _share(F.count_if(flipped), n).alias("flip_rate"), _share(F.count_if(right), n).alias("reacc"), _share(F.count_if(both & ~flipped), n).alias("recon"),
        n.alias("n_pairs"), F.coalesce(F.sum("spent"), F.lit(0.0)).alias("cost"), F.sum("known").alias("n_known_costs"),
    )


def outcome_categories(scored: DataFrame, condition: str = "roman_numeral") -> DataFrame:
    """Questions of each model by what became of the answer under a condition that keeps the meaning."""
    q = by_question(scored, "mcq", condition)
    both, flipped, _ = _against_mcq(condition)
    return q.groupBy("model", outcome_category(both, flipped, F.col("mcq_correct"), F.col(f"{condition}_correct")).alias("category")).agg(F.count("*").alias("n"))


def call_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Calls, share parsed, accuracy among the parsed."""
    right = F.count_if(is_true(F.col("correct")) & F.col("parsed"))
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("parsed").cast("double")).alias("parse_ok_rate"), _share(right, F.count_if("parsed")).alias("accuracy_parsed"))


def second_phase(scored: DataFrame) -> DataFrame:
    """Roman numerals and the replaced gold option, each against the baseline and never mixed."""
    q = by_question(scored, "mcq", "roman_numeral", "none_of_the_provided")
    r_both, r_flip, r_right = _against_mcq("roman_numeral")
    both, changed, _ = _against_mcq("none_of_the_provided")
    before, after = F.col("mcq_correct"), F.col("none_of_the_provided_correct")
    cell = lambda a, b: F.count_if(both & (before if a else ~before) & (after if b else ~after))
    none = _accuracy("none_of_the_provided")
    return q.groupBy("model").agg(
        _accuracy("mcq").alias("mcq_accuracy"), _accuracy("roman_numeral").alias("roman_accuracy"), (_accuracy("roman_numeral") - _accuracy("mcq")).alias("roman_delta"),
        _share(F.count_if(r_flip), F.count_if(r_both)).alias("roman_flip_rate"), _share(F.count_if(r_right), F.count_if(r_both)).alias("roman_reacc"),
        _share(F.count_if(r_both & ~r_flip), F.count_if(r_both)).alias("roman_recon"), F.count_if(r_both).alias("roman_n_pairs"), none.alias("none_accuracy"),
        (none - _accuracy("mcq")).alias("none_delta"), _share(F.count_if(changed), F.count_if(both)).alias("none_change_rate"),
        cell(1, 1).alias("none_cc"), cell(1, 0).alias("none_cw"), cell(0, 1).alias("none_wc"), cell(0, 0).alias("none_ww"), F.count_if(both).alias("none_n_pairs"),
    )


def adaptation_category(required: Column, both: Column, before: Column, after: Column, gold: Column, before_ok: Column, after_ok: Column) -> Column:
    """Whether an answer followed a gold label that moved, else how it held where none did."""
    moved = F.when(after.eqNullSafe(gold), "successful_adaptation").when(after.eqNullSafe(before), "failure_to_adapt").otherwise("adaptation_attempted_but_wrong")
    a, b = is_true(before_ok), is_true(after_ok)
    kept = F.when(a & b, "stable_correct").when(a, "presentation_instability").when(b, "unexpected_correction").otherwise("stable_incorrect")
    return F.when(~is_true(both), "unparseable").when(is_true(required), moved).otherwise(kept)


def adaptation_categories(scored: DataFrame, condition: str = "none_of_the_provided") -> DataFrame:
    """One row per model and question that has both conditions, with its category."""
    q = by_question(scored, "mcq", condition).where(F.col(f"{condition}_gold").isNotNull() & F.col("mcq_gold").isNotNull())
    c = lambda name: F.col(f"{condition}_{name}")
    required = F.col("mcq_gold") != c("gold")
    kind = adaptation_category(required, F.col("mcq_parsed") & c("parsed"), F.col("mcq_answer"), c("answer"), c("gold"), F.col("mcq_correct"), c("correct"))
    return q.select("model", "question_id", required.alias("adaptation_required"), kind.alias("category"))


def observed_failure(condition: Column, parsed: Column, answer: Column, correct: Column, n_labels: Column, category: Column) -> Column:
    """What a response itself shows to be its failure; no guess where it shows nothing."""
    none = condition == "none_of_the_provided"
    return (
        F.when(~is_true(parsed), "parsing_failure")
        .when(none & is_true(category == "presentation_instability"), "presentation_instability")
        .when(none & is_true(category.isin("failure_to_adapt", "adaptation_attempted_but_wrong")), "failure_to_adapt_to_changed_answer_set")
        .when(is_true(answer >= n_labels), "invalid_option_selection")
        .when((condition == "mcq") & ~is_true(correct), "possible_knowledge_error")
        .otherwise("insufficient_evidence")
    )


def third_phase(calls: DataFrame) -> DataFrame:
    """Totals and means of calls by model; a token count or latency that is not known counts as 0 in its mean."""
    mean = lambda c: (F.sum(F.coalesce(F.col(c), F.lit(0))) / F.count("*")).alias(f"mean_{c}")
    right, wrong, read = F.count_if(is_true(F.col("correct"))), F.count_if(is_true(~F.col("correct"))), F.count_if("parsed")
    return calls.groupBy("model").agg(
        F.count("*").alias("n_calls"), read.alias("n_parsed"), right.alias("n_correct"), wrong.alias("n_incorrect"), F.count_if(F.contains(F.upper("finish_reason"), F.lit(CUT))).alias("n_truncated"),
        (read / F.count("*")).alias("parse_rate"), _share(right, read).alias("accuracy_parsed"), mean("output_tokens"), mean("thinking_tokens"), mean("latency_s"),
        F.sum(F.coalesce(F.col("cost"), F.lit(0.0))).alias("cost"), (read == right + wrong).alias("reconciled"),
    )


def run_summary(log: DataFrame) -> DataFrame:
    """One row of counters. log: cached, failed, attempts, cost; what was cached costs nothing new."""
    new = ~F.col("cached")
    return log.agg(
        F.count("*").alias("expected"), F.count_if(new & ~F.col("failed")).alias("new"), F.count_if("cached").alias("cached"), F.count_if("failed").alias("failed"),
        F.coalesce(F.sum(F.when(new, F.greatest(F.col("attempts") - 1, F.lit(0)))), F.lit(0)).alias("retries"), F.coalesce(F.sum(F.when(new, F.col("cost"))), F.lit(0.0)).alias("cost"),
    )
