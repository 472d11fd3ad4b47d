"""Evaluation and rewards of responses to examples with their own options: the published cases, and sets of other sizes."""

import json

import pytest
from pyspark.sql import functions as F

from varipair.operators import evaluate

DRUGS = ["Amoxicillin", "Vancomycin", "Ciprofloxacin", "Acyclovir"]


def example(condition, labels="ABCD", texts=DRUGS, **more):
    return json.dumps({"question_id": "test::001", "source_dataset": "test", "source_id": "001", "condition": condition, "question": "?", "option_labels": list(labels), "option_texts": texts, "gold_index": 0} | more)


ROMAN = ["I", "II", "III", "IV"]
SET = {"gold_index": None, "gold_indices": [1, 2, 3]}
#: The published cases, as condition, labels, more of the example, completion, reward for the right answer, for its form.
CASES = [
    ("mcq", "ABCD", {}, '{"answer": "A"}', 1, 1), ("mcq", "ABCD", {}, '{"answer": "B"}', 0, 0.5), ("mcq", "ABCD", {}, "invalid text", 0, 0),
    ("roman_numeral", ROMAN, {}, '{"answer": "I"}', 1, 1), ("roman_numeral", ROMAN, {}, '{"answer": "II"}', 0, 0.25), ("roman_numeral", ROMAN, {}, '{"answer": "A"}', 0, 0),
    ("fixed_pos", "ABCD", {"gold_index": 3}, '{"answer": "D"}', 1, 1), ("fixed_pos", "ABCD", {"gold_index": 3}, '{"answer": "A"}', 0, 0.25),
    ("no_symbols", "", {}, '{"answer": "Amoxicillin"}', 1, 1), ("no_symbols", "", {}, '{"answer": "Vancomycin"}', 0, 0.25), ("no_symbols", "", {}, '{"answer": "A"}', 0, 0),
    ("none_of_the_provided", "ABCD", {}, '{"answer": "A"}', 1, 1), ("none_of_the_provided", "ABCD", {}, '{"answer": "B"}', 0, 0),
    ("incorrect", "ABCD", SET, '{"answer": ["B", "C", "D"]}', 1, 1), ("incorrect", "ABCD", SET, '{"answer": ["A", "C", "D"]}', 0, 0.5), ("incorrect", "ABCD", SET, '{"answer": "A"}', 0, 0),
]


def test_published_rewards(spark):
    rows = [(k, example(c, labels, **more), text) for k, (c, labels, more, text, _, _) in enumerate(CASES)]
    got = evaluate.batch_rewards(spark.createDataFrame(rows, "k int, example_json string, completion string"), ["correct", "symbolic"]).orderBy("k").collect()
    assert [(r["reward_correct"], r["reward_symbolic"]) for r in got] == [(float(a), float(b)) for *_, a, b in CASES]


def run(spark, *rows):
    df = spark.createDataFrame([(k, e, text) for k, (e, text) in enumerate(rows)], "k int, example_json string, completion string")
    return evaluate.evaluated(evaluate.with_examples(df, "example_json", "completion")).orderBy("k").collect()


def test_options_of_any_number(spark):
    ten = [f"option {x}" for x in "abcdefghij"]
    two = example("mcq", "AB", ["yes", "no"], gold_index=1)
    r = run(
        spark, (two, '{"answer": "C"}'), (two, "A or C"), (example("mcq", "ABCDEFGHIJ", ten, gold_index=9), "(j)"), (example("roman_numeral", ["I", "II", "III", "IV", "V", "VI"], ten[:6], gold_index=5), "It is VI"),
        (example("incorrect", "AB", ["yes", "no"], gold_index=None, gold_indices=[0]), '{"answer": ["a"]}'), (example("incorrect", "ABCD", gold_index=None, gold_indices=[1, 2, 3]), '{"answer": ["B", "C"]}'),
    )
    assert [(x["parse_success"], x["correct"]) for x in r] == [(False, None), (True, False), (True, True), (True, True), (True, True), (True, False)]
    assert r[0]["eval_note"] == "not parsed" and r[2]["selected_option_text"] == "option j"
    assert (r[4]["implied_option_index"], r[4]["selected_option_text"]) == (1, "no") and r[5]["eval_note"] == "selected 2 options, expected 3" and r[5]["implied_option_index"] is None


def test_unmatched_answers(spark):
    shown, hidden = (run(spark, (example(c, ""), '{"answer": "Penicillin"}'))[0] for c in ("no_symbols", "open"))
    assert (shown["evaluable"], shown["correct"], shown["match_method"], shown["eval_note"]) == (True, False, "no_match", "answer matches no displayed option")
    assert (hidden["evaluable"], hidden["correct"], hidden["eval_note"]) == (False, None, "free-text answer matches no reference option; needs semantic judgment")


def test_rewards_by_name(spark):
    df = spark.createDataFrame([(example("mcq"), [("user", "?"), ("assistant", '```json\n{"answer": "B"}\n```')]), (example("mcq"), [])], "example_json string, completion array<struct<role: string, content: string>>")

    @evaluate.reward("length")
    def shorter(weight, beta):
        return F.lit(-weight) * F.length(F.coalesce("raw_response", F.lit("")))

    try:
        got = evaluate.batch_rewards(df, ["format", "neurosymbolic", "length"], weight=0.5, beta=0.1).collect()
    finally:
        del evaluate.REWARDS["length"]
    assert (got[0]["reward_format"], round(got[0]["reward_neurosymbolic"], 9), got[0]["reward_length"]) == (0.8, 0.33, -13.5)
    assert (got[1]["reward_format"], got[1]["reward_neurosymbolic"]) == (0.0, 0.0)
    with pytest.raises(ValueError, match="no column of examples"):
        evaluate.batch_rewards(df.drop("example_json"), ["correct"])
    with pytest.raises(Exception, match="a row has no example"):
        evaluate.batch_rewards(df.withColumn("example_json", F.lit(None).cast("string")), ["correct"]).collect()
    with pytest.raises(Exception, match="example without question"):
        evaluate.batch_rewards(df.withColumn("example_json", F.lit('{"question_id": "a::1", "source_dataset": "a", "source_id": "1", "condition": "mcq"}')), ["correct"]).collect()
