"""Scores, outcomes and rewards of parsed answers, as Column builders over the scored frame's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_words

#: Conditions in report order, with their group.
CONDITIONS = ["mcq", "roman_numeral", "none_of_the_provided", "fixed_pos", "incorrect", "open", "no_symbols"]
INVARIANCE = ["roman_numeral", "fixed_pos", "no_symbols"]
ADAPTATION = ["none_of_the_provided", "incorrect"]


def implied_index(chosen: Column, n: int = 4) -> Column:
    """The one index that a choice of n - 1 of n leaves out, else null."""
    rest = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), chosen)
    return F.when((F.size(chosen) == n - 1) & (F.size(rest) == 1), F.get(rest, 0))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def transition(before: Column, after: Column) -> Column:
    """C->W and the like; null counts as wrong."""
    side = lambda c: F.when(is_true(c), "C").otherwise("W")
    return F.concat(side(before), F.lit("->"), side(after))


def adaptation(condition: Column, correct: Column, text: Column, base_text: Column, set_size: Column) -> Column:
    """How an answer adapted to a condition that inverts the task; null for other conditions. An answer is kept if
    the chosen texts are equal after normalisation."""
    none = condition == "none_of_the_provided"
    wrong_set = condition == "incorrect"
    return (
        F.when((none | wrong_set) & is_true(correct), "successful_adaptation")
        .when(none & (norm_words(text) == norm_words(base_text)), "failure_to_adapt_kept_same_distractor")
        .when(none, "failure_to_adapt_chose_distractor")
        .when(wrong_set & (F.coalesce(set_size, F.lit(0)) != 3), "failure_to_adapt_wrong_set_size")
        .when(wrong_set, "failure_to_adapt_included_gold")
    )


def failure(condition: Column, parsed: Column, evaluable: Column, correct: Column, set_size: Column, match_method: Column, base_correct: Column, base_evaluable: Column, api_error: Column, truncated: Column) -> Column:
    """The first cause that applies; null for right answers."""
    unmatched = (match_method == "no_match") | match_method.startswith("ambiguous")
    return (
        F.when(is_true(api_error), "provider_api_failure")
        .when(is_true(truncated), "max_tokens_truncation")
        .when(~is_true(parsed), "parse_failure")
        .when(~is_true(evaluable), "evaluation_ambiguity")
        .when((condition == "no_symbols") & is_true(unmatched), "invalid_option")
        .when((condition == "incorrect") & (F.coalesce(set_size, F.lit(0)) != 3), "instruction_following_failure")
        .when(is_true(correct), None)
        .when(condition == "mcq", "knowledge_error")
        .when(condition == "none_of_the_provided", "required_adaptation_failure")
        .when(~is_true(base_evaluable), "unattributed_error")
        .when(is_true(base_correct), "representation_instability")
        .otherwise("knowledge_error")
    )


def reward_correct(condition: Column, correct: Column) -> Column:
    return F.when(condition == "open", 0.0).when(is_true(correct), 1.0).otherwise(0.0)


def reward_symbolic(condition: Column, parsed: Column, correct: Column, answer: Column, set_size: Column) -> Column:
    """Full for right, partial for a wrong answer that keeps to the interface: .5 for a valid label of the baseline and
    for a set of the right size, .25 for a valid label or a matched option where the meaning is unchanged; none where
    `none of the provided` was due."""
    part = (
        F.when(condition == "mcq", 0.5)
        .when((condition == "incorrect") & (F.coalesce(set_size, F.lit(0)) == 3), 0.5)
        .when(condition.isin("roman_numeral", "fixed_pos"), 0.25)
        .when((condition == "no_symbols") & answer.isNotNull(), 0.25)
        .otherwise(0.0)
    )
    return F.when(condition == "open", 0.0).when(is_true(correct), 1.0).when(is_true(parsed), part).otherwise(0.0)


def reward_total(r_correct: Column, r_symbolic: Column, r_format: Column, weight: float = 0.5, format_weight: float = 0.0) -> Column:
    total = r_correct + F.lit(weight) * r_symbolic
    return total + F.lit(format_weight) * r_format if format_weight > 0 else total


def token_cost(tokens_in: Column, tokens_out: Column, thinking: Column, price_in: float, price_out: float, bill_thinking: bool = True) -> Column:
    """Price per million tokens; null if a needed count is null."""
    out = tokens_out + F.coalesce(thinking, F.lit(0)) if bill_thinking else tokens_out
    return tokens_in * F.lit(price_in / 1e6) + out * F.lit(price_out / 1e6)


def outcome_category(both_parsed: Column, flipped: Column, base_ok: Column, other_ok: Column) -> Column:
    """What became of a pair of answers, by both verdicts and, where both are wrong, by whether the answer changed."""
    a, b = is_true(base_ok), is_true(other_ok)
    return (
        F.when(~is_true(both_parsed), "unparseable")
        .when(a & b, "stable_correct")
        .when(a, "correct_to_incorrect")
        .when(b, "incorrect_to_correct")
        .when(is_true(flipped), "incorrect_to_different_incorrect")
        .otherwise("stable_incorrect")
    )


def tie_band(margin: Column, epsilon: float) -> Column:
    return F.when(margin > epsilon, "correct").when(margin < -epsilon, "incorrect").otherwise("tie")
