"""A whole evaluation with its stops and its resumption, and the smaller helpers of texts, files and tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from varipair.functions import text as T
from varipair.operators import orchestrate, relational
from varipair.session import scratch
from varipair.sources import cache, gates, io


def examples(spark, n=12, broken=0):
    rows = []
    for i in range(n):
        e = {"question_id": f"s::{i}", "source_dataset": "s", "source_id": str(i), "condition": "mcq", "question": "?", "option_labels": ["A", "B"], "option_texts": ["x", "y"], "gold_index": i % 2}
        rows.append(("r", i, f"s::{i}", "mcq", "no idea" if i < broken else '{"answer": "A"}', json.dumps(e)))
    return spark.createDataFrame(rows, "run_id string, seq long, question_id string, condition string, prompt string, example_json string")


def adapter(cost=0.5, fails=()):
    def generate(request, attempt):
        if request["seq"] in fails:
            raise ConnectionError("down")
        return request["prompt"], cost

    return generate


def test_evaluation_is_published_and_costs_nothing_again(spark):
    at, config = scratch(spark, "cache"), orchestrate.config_hash("p", "m", {"t": 0}, "v1")
    e = orchestrate.evaluate_policy(examples(spark), adapter(), at, config, 100.0, scratch(spark, "out"))
    row = e.by_condition.first()
    assert (row["n"], row["n_correct"], row["cost_usd"], e.seen["n"]) == (12, 6, 6.0, 12) and e.totals.first()["n_called"] == 12
    again = orchestrate.evaluate_policy(examples(spark), adapter(fails=range(12)), at, config, 0.0, scratch(spark, "out"))
    assert again.totals.first()["n_cached"] == 12 and again.by_condition.first()["cost_usd"] == 0.0 and again.by_condition.first()["n_correct"] == 6
    assert again.responses.where("from_cache").count() == 12 and "prompt_sha256" in again.responses.columns


def test_a_ceiling_stops_and_the_cache_resumes(spark):
    at, config, out = scratch(spark, "cache"), "abc", scratch(spark, "out")
    with pytest.raises(Exception, match="CostCeilingExceeded"):
        orchestrate.evaluate_policy(examples(spark), adapter(), at, config, 2.0, out)
    assert not os.path.exists(out.removeprefix("file://")) and cache.cached(spark, at, config).count() == 4
    e = orchestrate.evaluate_policy(examples(spark), adapter(), at, config, 100.0, out)
    assert (e.totals.first()["n_cached"], e.totals.first()["n_called"]) == (4, 8) and os.path.exists(out.removeprefix("file://"))


def test_gates_stop_before_publication(spark):
    for stage, ex, ad, why in ((3, examples(spark), adapter(fails=[3]), "1 provider failures"), (2, examples(spark, broken=2), adapter(), "parse failures in stage 2: 2")):
        out = scratch(spark, "out")
        with pytest.raises(gates.Stop, match=why):
            orchestrate.evaluate_policy(ex, ad, scratch(spark, "cache"), "abc", 100.0, out, stage)
        assert not os.path.exists(out.removeprefix("file://"))


def test_cohorts(spark):
    man = spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(["train"] * 3 + ["diagnostic"] * 7)], "question_id string, split string")
    ids = lambda stage: sorted(r[0] for r in orchestrate.load_cohort(man, stage).collect())
    assert ids("1") == ["q3"] and ids("stage_2") == ["q3", "q4", "q5", "q6", "q7"] and len(ids("diagnostic")) == 7 and ids("train") == ["q0", "q1", "q2"] and ids("val") == []
    with pytest.raises(ValueError, match="unknown stage: 9"):
        orchestrate.load_cohort(man, "9")


def test_config_hash_does_not_depend_on_order():
    a, b = orchestrate.config_hash("p", "m", {"x": 1, "y": 2}, "v1"), orchestrate.config_hash("p", "m", {"y": 2, "x": 1}, "v1")
    assert a == b and len(a) == 64 and a != orchestrate.config_hash("p", "m", {"x": 1, "y": 3}, "v1")


def test_grammar_and_line_differences(spark):
    df = spark.createDataFrame([("A 80-year-old man", "a\n\nb\nc"), ("An 81-year-old", "a\nB\nc\nd"), ("A 25-year-old", ""), ("old", None), ("It has it has been", "x"), (None, "x")], "s string, b string")
    got = df.select(T.article_problem(F.col("s")), T.repeated_phrase(F.col("s")), T.changed_lines(F.lit("a\nb\nc"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["article mismatch: A 80-year-old", None, None, "missing age pattern", "missing age pattern", "missing age pattern"]
    assert [r[1] for r in got] == [None, None, None, None, "It has", None]
    assert [r[2] for r in got] == [[], [2, 4], [1, 2, 3], [1, 2, 3], [1, 2, 3], [1, 2, 3]]


def test_files(spark):
    root = scratch(spark, "files")
    assert io.read_optional_csv(spark, f"{root}/none.csv", "a int").count() == 0
    assert io.read_settings(spark, f"{root}/none", {"a": 1}) == {"a": 1} and io.epsilon(spark, f"{root}/none") == 0.125
    io.write_report(spark, {"max_abs_score_diff": 0.05, "b": {"c": [1]}}, f"{root}/report")
    assert io.read_settings(spark, f"{root}/report", {"a": 1, "b": 0}) == {"a": 1, "b": {"c": [1]}, "max_abs_score_diff": 0.05} and io.epsilon(spark, f"{root}/report") == 0.1
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "far")], "k int, split string")
    assert io.write_splits(df, f"{root}/splits", "split") == {"total_items": 3, "items": {"train": 2, "far": 1}}
    assert spark.read.schema("k int, split string").json(f"{root}/splits/all").count() == 3 and spark.read.json(f"{root}/splits/by_split/_split=far").count() == 1
    assert io.read_settings(spark, f"{root}/splits/metadata", {})["total_items"] == 3
    one, two = ([r["k"] for r in io.from_list(spark, [(k,) for k in range(50)], "k int", s, "k").collect()] for s in (1, 2))
    assert sorted(one) == list(range(50)) and one != two and one == [r["k"] for r in io.shuffled(spark.range(50).select(F.col("id").cast("int").alias("k")), 1, "k").collect()]


def test_variants_samples_and_records(spark):
    rows = spark.createDataFrame([(1, "base", "a"), (1, "base", "b"), (1, "edited", "c"), (2, "other", "d")], "k int, item string, v string")
    got = {r["k"]: (r["base"] and r["base"]["v"], r["edited"] and r["edited"]["v"]) for r in relational.variants(rows, ["k"], "item", ["v"], ["base", "edited"]).collect()}
    assert got == {1: ("b", "c"), 2: (None, None)}
    q = spark.createDataFrame([("s", i, {"A": "x"}, "A" if i else "B", "x") for i in range(300)], "s string, i int, options map<string,string>, answer_idx string, answer string")
    assert tuple(relational.consistency_sample(q, "s", "i").first()) == ("s", 200, 199)
    log = spark.createDataFrame([("r", 100, 2.0, 1.23456), ("r", 50, 4.0, 0.5)], "run string, tokens int, seconds double, memory_gb double")
    assert tuple(relational.compute_records(log, ["run"]).first()) == ("r", 25.0, 0.1, 0.00167, 1.235)
