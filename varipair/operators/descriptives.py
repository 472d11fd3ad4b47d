"""What a perturbation does to a question: twelve columns per pair, and their summary by perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as H
from ..functions import text as T

#: Perturbations whose answer is a key into the pair's own options.
POSITION_COMPARABLE = ["roman_numeral", "none_of_the_provided", "fixed_pos"]


def enrich(pairs: DataFrame, similarity: bool = True) -> DataFrame:
    """pairs (perturbation_type, original_ and perturbed_question and _options (JSON), original_answer_letter,
    perturbed_answer_raw) with word counts and their differences, answer positions, what changed, and the answer's format.
    Options that are no JSON object have no mean; positions are of the comparable perturbations only. similarity: also
    difflib's ratio, by Arrow batches."""
    comparable = F.col("perturbation_type").isin(POSITION_COMPARABLE)
    words = lambda c: F.col(c).isNotNull().cast("int") * T.word_count(F.col(c))
    d = pairs.withColumns({"orig_word_count": words("original_question"), "pert_word_count": words("perturbed_question"), "_o": H.options(F.col("original_options")), "_p": H.options(F.col("perturbed_options"))})
    d = d.withColumns({
        "question_length_diff": F.col("pert_word_count") - F.col("orig_word_count"), "orig_options_avg_wc": H.mean_words(F.col("_o")), "pert_options_avg_wc": H.mean_words(F.col("_p")),
        "orig_answer_position": F.when(comparable, H.position(F.col("_o"), F.col("original_answer_letter"))), "pert_answer_position": F.when(comparable, H.position(F.col("_p"), F.col("perturbed_answer_raw"))),
        "raw_answer_token_changed": F.when(comparable, ~F.col("original_answer_letter").eqNullSafe(F.col("perturbed_answer_raw"))), "answer_format": H.answer_format(F.col("perturbed_answer_raw")),
    })
    # A position that is missing differs from any, a missing one too.
    same = F.coalesce(F.col("orig_answer_position") == F.col("pert_answer_position"), F.lit(False))
    d = d.withColumns({"options_length_diff": F.col("pert_options_avg_wc") - F.col("orig_options_avg_wc"), "answer_position_changed": F.when(comparable, ~same)}).drop("_o", "_p")
    return d.withColumn("lexical_similarity", T.lexical_similarity(F.col("original_question"), F.col("perturbed_question"))) if similarity else d


def descriptives(enriched: DataFrame) -> DataFrame:
    """Per perturbation: pairs, change rates, word differences, similarity if it is there, and the share of each format."""
    c, known = F.col, [x for x in ("lexical_similarity",) if x in enriched.columns]
    share = lambda flag: F.avg(c(flag).cast("double"))

    def spread(name: str, column: str) -> list[Column]:
        return [F.avg(column).alias(f"{name}_mean"), F.median(column).alias(f"{name}_median"), F.stddev_samp(column).alias(f"{name}_std")]

    formats = ["list_of_letters", "roman_numeral", "letter", "free_text", "unknown"]
    return enriched.groupBy("perturbation_type").agg(
        F.count("*").alias("n_pairs"), share("question_text_changed").alias("question_text_changed_rate"), *spread("question_length_diff_words", "question_length_diff"),
        *spread("options_length_diff_words", "options_length_diff"), *[x for k in known for x in spread(k, k)], share("answer_position_changed").alias("answer_position_change_rate"),
        share("raw_answer_token_changed").alias("raw_answer_token_change_rate"), F.bool_or("is_task_inverted").alias("is_task_inverted"),
        *[share_of(c("answer_format") == f).alias(f"share_{f}") for f in formats],
    )


def share_of(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
