"""Rules as data: the verifier on single facts, the generated set, defaults of files, and what the checks find."""

import json

import pytest
from pyspark.sql import functions as F

from varipair.operators import rules as R
from varipair.session import scratch


@pytest.fixture(scope="module")
def table(spark):
    return R.rule_table(spark).cache()


@pytest.fixture(scope="module")
def items(spark, table):
    ids = F.array(*[F.lit(r["rule_id"]) for r in R.RULES])
    t = spark.range(300).select(F.concat(F.lit("t"), "id").alias("template_id"), F.get(ids, (F.col("id") % 10).cast("int")).alias("rule_id"), F.expr("CAST(id div 10 AS INT)").alias("i"))
    return R.vignettes(t, table).cache()


@pytest.mark.parametrize("rule, facts, fired", [
    ("renal_01", {"egfr": "29.9"}, True), ("renal_01", {"egfr": "30"}, False), ("renal_01", {"egfr": None}, False), ("renal_01", {"crcl": "10"}, False), ("renal_01", {"egfr": "low"}, False), ("renal_01", {}, False),
    ("renal_04", {"crcl": "14.9"}, False), ("renal_04", {"crcl": "15"}, True), ("renal_04", {"crcl": "30"}, False),
    ("preg_02", {"pregnant": "true"}, True), ("preg_02", {"pregnant": "false"}, False), ("preg_02", {"pregnant": None}, False),
    ("allergy_02", {"allergy": "sulfonamide", "allergy_reaction": "stevens_johnson"}, True), ("allergy_02", {"allergy": "sulfonamide", "allergy_reaction": "rash"}, False), ("allergy_02", {"allergy_reaction": "anaphylaxis"}, False),
])
def test_verifier(spark, table, rule, facts, fired):
    r = R.verify(spark.createDataFrame([(rule, facts)], "rule_id string, facts map<string,string>"), table).first()
    spec = next(x for x in R.RULES if x["rule_id"] == rule)
    assert r["fired"] is fired and r["action"] == spec["rule_action" if fired else "default_action"]


def test_unknown_rule_fails(spark, table):
    with pytest.raises(Exception, match="no rule nothing"):
        R.verify(spark.createDataFrame([("nothing", {"a": "b"})], "rule_id string, facts map<string,string>"), table).collect()


def test_a_rule_without_conditions_never_fires(spark):
    df = spark.createDataFrame([({"a": "1"}, [])], "f map<string,string>, c array<struct<field: string, op: string, number: double, choices: array<string>>>")
    assert df.select(R.fires(F.col("f"), F.col("c"))).first()[0] is False


def test_set_of_twelve_hundred(items, table):
    assert items.count() == 1200 and R.violations(items, table).count() == 0
    assert {r["split"]: r["count"] for r in items.groupBy("split").count().collect()} == {"train": 600, "near_ood": 240, "far_ood": 360}
    assert items.where(F.size(F.split("prompt", "\n")) != 9).count() == 0  # eight lines, and an empty one before the question
    for r in R.checks(items, table).collect():
        assert (r["n_items"], r["min_age"], r["max_age"], r["n_male"]) == (120, 25, 80, 0 if r["rule_id"].startswith("preg") or r["rule_id"] == "allergy_03" else 60)
        assert not any(r[c] for c in ("unsound", "form", "dose", "article", "wrong_lines"))


def test_repeated_phrases_and_articles(items):
    assert items.where(F.col("prompt").rlike(r"(?i)\b(\w+\s+\w+)\s+\1\b")).count() == 0
    heads = [r[0].split("\n")[1] for r in items.where("age = 80").select("prompt").collect()]
    assert heads and all(h.startswith("An 80-year-old ") for h in heads)


def test_facts_are_numbers_of_the_published_bands(items):
    edited = items.where("item_type = 'edited' AND rule_id = 'renal_04'").select(F.col("facts")["crcl"].cast("int").alias("x")).agg(F.min("x"), F.max("x")).first()
    near = items.where("item_type = 'near_miss' AND rule_id = 'renal_03'").select(F.col("facts")["crcl"].cast("int").alias("x")).agg(F.min("x"), F.max("x")).first()
    assert tuple(edited) == (16, 28) and tuple(near) == (65, 82)


def test_rules_from_a_file(spark, items):
    path = scratch(spark, "rules").removeprefix("file://") + ".jsonl"
    new = [{"rule_id": "dose_9", "family": "renal", "indication": "x", "female": False, "conditions": [{"field": "age", "op": ">=", "number": 65}], "default_action": "Prescribe a.", "rule_action": "Prescribe b.", "numbers": [{"item": "edited", "field": "age", "start": 66, "modulo": 9, "step": 1}], "texts": [], "lines": []}, R.RULES[0] | {"split": None}]
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, new)) + "\n\n")
    rules = R.read_rules(spark, path, spark.createDataFrame([("renal_01", "near_ood")], "rule_id string, split string"))
    assert {r["rule_id"]: r["split"] for r in rules.collect()} == {"dose_9": "train", "renal_01": "near_ood"}
    v = R.vignettes(spark.createDataFrame([("t", "dose_9", 3)], "template_id string, rule_id string, i int"), rules)
    assert R.violations(v, rules).count() == 0 and v.count() == 4


def test_checks_find_what_is_spoilt(items, table):
    bad = items.where("rule_id = 'renal_04'").withColumn("chosen", F.when((F.col("i") == 0) & (F.col("item_type") == "base"), F.lit("Avoid gabapentin")).otherwise(F.col("chosen")))
    bad = bad.withColumn("rejected", F.when((F.col("i") == 1) & (F.col("item_type") == "edited"), F.lit("Prescribe other.")).otherwise(F.col("rejected")))
    bad = bad.withColumn("prompt", F.when((F.col("i") == 2) & (F.col("item_type") == "near_miss"), F.replace("prompt", F.lit("Family"), F.lit("family"))).otherwise(F.col("prompt")))
    r = R.checks(bad, table).first()
    assert (r["unsound"], r["form"], r["dose"], r["article"], r["wrong_lines"]) == (1, 1, 1, 0, 1)
