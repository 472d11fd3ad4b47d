"""Rules as data: a table of rules, one Column that says whether a rule fires on an item's facts, generated vignettes, and
their checks. No code names a rule; more rules come from a JSON-lines file of the same fields (`read_rules`).

A rule has `conditions` (field, op, number, choices), all of which must hold; a fact that is missing, or no number where
one is compared, never holds. `numbers` and `texts` say what a vignette's facts are, by item type and the template's number i:
start + (i mod modulo) * step, and the (i mod n)-th choice. `lines` replace a prompt's line for an item type.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_TYPES = ["base", "edited", "near_miss", "null_edit"]
SCHEMA = """rule_id string, family string, split string, indication string, female boolean, same_drug string,
 conditions array<struct<field: string, op: string, number: double, choices: array<string>>>, default_action string, rule_action string,
 avoid string, correct string, presentations array<string>,
 numbers array<struct<item: string, field: string, start: double, modulo: int, step: double>>,
 texts array<struct<item: string, field: string, choices: array<string>>>, lines array<struct<item: string, line: int, text: string>>"""
#: Rules that may be broadcast.
BROADCAST_ROWS = 100_000

EGFR = "Renal function: eGFR {egfr} mL/min/1.73m2, serum creatinine {creatinine} mg/dL."
CRCL = "Renal function: creatinine clearance {crcl} mL/min, serum creatinine {creatinine} mg/dL."
FIRST = {"split": "train", "female": False, "same_drug": None, "presentations": []}


def _numbers(**by_item):
    return [{"item": item, "field": f, "start": start, "modulo": m, "step": step} for item, specs in by_item.items() for f, start, m, step in specs]


def _renal(rule_id, base, edited, near, line, **more):
    """A rule on a laboratory value; specs are (field, start, modulo, step)."""
    return FIRST | {"rule_id": rule_id, "family": "renal", "numbers": _numbers(base=base, edited=edited, near_miss=near), "texts": [], "lines": [{"item": "base", "line": 3, "text": line}]} | more


def _pregnancy(rule_id, **more):
    texts = [{"item": k, "field": f, "choices": [v]} for k, yes, test in (("edited", "true", "positive"), ("near_miss", "false", "negative")) for f, v in (("pregnant", yes), ("beta_hcg", test))]
    lines = [{"item": "edited", "line": 4, "text": "Reproductive status: urine beta-hCG positive ({weeks} weeks gestation)."}, {"item": "near_miss", "line": 4, "text": "Reproductive status: urine beta-hCG negative."}]
    numbers = _numbers(base=[("egfr", 88, 23, 1), ("creatinine", 0.85, 5, 0.04)], edited=[("weeks", 6, 9, 1)])
    return FIRST | {"rule_id": rule_id, "family": "pregnancy", "female": True, "conditions": [{"field": "pregnant", "op": "in", "choices": ["true"]}], "numbers": numbers, "texts": texts, "lines": [{"item": "base", "line": 3, "text": EGFR}, *lines]} | more


def _allergy(rule_id, drug, reactions, named, relatives, tag, family_line, **more):
    texts = [{"item": "edited", "field": "allergy", "choices": [drug]}, {"item": "edited", "field": "allergy_reaction", "choices": reactions}, {"item": "edited", "field": "reaction_name", "choices": named}]
    texts += [{"item": "near_miss", "field": "allergy", "choices": ["none"]}, {"item": "near_miss", "field": "relative", "choices": relatives}, {"item": "near_miss", "field": "family_allergy", "choices": [f"{tag}_{r}" for r in relatives]}]
    lines = [{"item": "base", "line": 3, "text": EGFR}, {"item": "edited", "line": 5, "text": f"Drug allergies: {drug} ({{reaction_name}})."}, {"item": "near_miss", "line": 6, "text": family_line}]
    when = [{"field": "allergy", "op": "in", "choices": [drug]}, {"field": "allergy_reaction", "op": "in", "choices": reactions}]
    return FIRST | {"rule_id": rule_id, "family": "allergy", "split": "far_ood", "conditions": when, "numbers": _numbers(base=[("egfr", 88, 23, 1), ("creatinine", 0.85, 5, 0.04)]), "texts": texts, "lines": lines} | more


_BELOW_30 = lambda field: [{"field": field, "op": "<", "number": 30.0}]
_CREATININE = ("creatinine", 0.85, 5, 0.04)
_CLEARANCE = [("crcl", 90, 21, 1), ("egfr", 88, 21, 1), _CREATININE]

#: The ten published rules with their actions, bands and splits.
RULES = [
    _renal("renal_01", [("egfr", 88, 23, 1), ("crcl", 90, 23, 1), _CREATININE], [("egfr", 16, 13, 1), ("crcl", 18, 13, 1), ("creatinine", 3.2, 6, 0.1)], [("egfr", 46, 13, 1), ("crcl", 48, 13, 1), ("creatinine", 1.3, 5, 0.05)], EGFR,
           conditions=_BELOW_30("egfr"), indication="Type 2 diabetes mellitus", avoid="metformin", correct="glipizide",
           default_action="Prescribe metformin 1000 mg orally twice daily for 30 days.", rule_action="Prescribe glipizide 5 mg orally twice daily for 30 days."),
    _renal("renal_03", _CLEARANCE, [("crcl", 16, 13, 1), ("egfr", 16, 13, 1), ("creatinine", 2.6, 6, 0.1)], [("crcl", 65, 18, 1), ("egfr", 65, 18, 1), ("creatinine", 1.0, 4, 0.05)], CRCL,
           conditions=_BELOW_30("crcl"), indication="Acute uncomplicated lower urinary tract infection", avoid="nitrofurantoin", correct="fosfomycin",
           default_action="Prescribe nitrofurantoin 100 mg orally twice daily for 5 days.", rule_action="Prescribe fosfomycin 3 g orally once as a single dose for 1 day."),
    _renal("renal_04", _CLEARANCE, [("crcl", 16, 13, 1), ("egfr", 16, 13, 1), ("creatinine", 2.5, 6, 0.1)], [("crcl", 66, 18, 1), ("egfr", 66, 18, 1), ("creatinine", 0.9, 4, 0.05)], CRCL,
           conditions=[{"field": "crcl", "op": ">=", "number": 15.0}, *_BELOW_30("crcl")], indication="Postherpetic neuralgia / neuropathic pain", same_drug="gabapentin",
           avoid="gabapentin standard dose (600 mg TID)", correct="gabapentin reduced dose (300 mg BID)",
           default_action="Prescribe gabapentin 600 mg orally three times daily for 30 days.", rule_action="Prescribe gabapentin 300 mg orally twice daily for 30 days."),
    _pregnancy("preg_01", indication="Essential hypertension", avoid="lisinopril", correct="labetalol",
               default_action="Prescribe lisinopril 10 mg orally once daily for 30 days.", rule_action="Prescribe labetalol 100 mg orally twice daily for 30 days."),
    _pregnancy("preg_03", indication="Early localized Lyme disease", avoid="doxycycline", correct="cefuroxime axetil",
               default_action="Prescribe doxycycline hyclate 100 mg orally twice daily for 14 days.", rule_action="Prescribe cefuroxime axetil 500 mg orally twice daily for 14 days."),
    _renal("renal_02", _CLEARANCE, [("crcl", 16, 13, 1), ("egfr", 14, 13, 1), ("creatinine", 2.8, 6, 0.1)], [("crcl", 42, 17, 1), ("egfr", 40, 17, 1), ("creatinine", 1.4, 5, 0.05)], CRCL,
           conditions=_BELOW_30("crcl"), split="near_ood", indication="Acute deep vein thrombosis / pulmonary embolism anticoagulation", same_drug="enoxaparin",
           avoid="enoxaparin standard dose (1 mg/kg q12h)", correct="enoxaparin reduced dose (1 mg/kg q24h)",
           default_action="Prescribe enoxaparin 1 mg/kg subcutaneously every 12 hours for 14 days.", rule_action="Prescribe enoxaparin 1 mg/kg subcutaneously once every 24 hours for 14 days."),
    _pregnancy("preg_02", split="near_ood", indication="Active rheumatoid arthritis", avoid="methotrexate", correct="hydroxychloroquine",
               default_action="Prescribe oral methotrexate 15 mg once weekly for 30 days.", rule_action="Prescribe hydroxychloroquine 200 mg orally twice daily for 30 days."),
    _allergy("allergy_01", "penicillin", ["anaphylaxis"], ["anaphylaxis"], ["mother", "father", "sibling"], "penicillin_anaphylaxis", "Family history: penicillin allergy (anaphylaxis) in {relative}.",
             indication="Group A streptococcal pharyngitis", avoid="amoxicillin", correct="azithromycin",
             default_action="Prescribe amoxicillin 500 mg orally twice daily for 10 days.", rule_action="Prescribe azithromycin 500 mg orally once daily for 5 days."),
    _allergy("allergy_02", "sulfonamide", ["anaphylaxis", "stevens_johnson"], ["anaphylaxis", "Stevens-Johnson syndrome"], ["sibling", "mother", "father"], "sulfonamide_sjs", "Family history: sulfonamide allergy (Stevens-Johnson syndrome) in {relative}.",
             indication="Acute uncomplicated cystitis", avoid="TMP-SMX (trimethoprim-sulfamethoxazole)", correct="ciprofloxacin",
             default_action="Prescribe TMP-SMX 160/800 mg orally twice daily for 3 days.", rule_action="Prescribe ciprofloxacin 250 mg orally twice daily for 3 days."),
    _allergy("allergy_03", "aspirin", ["bronchospasm_polyps"], ["bronchospasm and nasal polyps"], ["father", "mother", "sibling"], "aspirin_aerd", "Family history: aspirin sensitivity (bronchospasm and nasal polyps) in {relative}.",
             female=True, indication="Primary dysmenorrhea", avoid="ibuprofen", correct="acetaminophen",
             default_action="Prescribe ibuprofen 600 mg orally every 8 hours as needed for 5 days.", rule_action="Prescribe acetaminophen 650 mg orally every 6 hours as needed for 5 days."),
]

#: Words that a response must not hold.
FORBIDDEN = ["avoid", "discontinue", "contraindicated", "allergy", "pregnancy", "renal", "switch", "instead"]
#: Where a vignette is set and the examination that closes it, in turn; those of an unchanged paraphrase are the next ones.
SETTINGS = ["in the clinic", "at the outpatient center", "at a scheduled visit", "at the urgent care center", "after a diagnostic workup"]
FINDINGS = ["Vital signs are within normal limits.", "Examination of heart and lungs is unremarkable.", "Serum electrolytes are normal.", "Liver enzymes are normal.", "No acute distress is noted.", "Resting saturation is 99% on room air.", "A chemistry profile is normal."]
#: Fixed value: what a rule without presentations of its own says.
PRESENTATION = "Clinical presentation consistent with stated indication."
QUESTION = "Question: What is the most appropriate pharmacological prescription order for this patient?"
#: Facts that a line may name.
NAMED = ["egfr", "crcl", "creatinine", "weeks", "reaction_name", "relative"]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([json.dumps(r) for r in RULES], "string").select(F.from_json("value", SCHEMA).alias("r")).select("r.*")


def read_rules(spark: SparkSession, path: str, splits: DataFrame | None = None) -> DataFrame:
    """Rules of a JSON-lines file. splits (rule_id, split) overrides the file's; a rule that neither names is `train`."""
    rules = spark.read.schema(SCHEMA).json(path)
    if splits is not None:
        rules = rules.withColumnRenamed("split", "_own").join(splits.select("rule_id", "split"), "rule_id", "left").withColumn("split", F.coalesce("split", "_own")).drop("_own")
    return rules.withColumn("split", F.coalesce("split", F.lit("train"))).select(*rules.columns)


def fires(facts: Column, conditions: Column) -> Column:
    """Whether all conditions hold on a map of facts; none hold nothing."""
    def holds(c: Column) -> Column:
        fact = facts[c["field"]]
        number = fact.try_cast("double")
        test = F.when(c["op"] == "<", number < c["number"]).when(c["op"] == "<=", number <= c["number"]).when(c["op"] == ">", number > c["number"]).when(c["op"] == ">=", number >= c["number"]).when(c["op"] == "=", number == c["number"]).when(c["op"] == "in", F.array_contains(c["choices"], fact))
        return F.coalesce(test, F.lit(False))

    return (F.size(conditions) > 0) & F.forall(conditions, holds)


def with_rule(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items with `rule`, their rule's row; an item whose rule is not in the table fails the job."""
    table = rules.select(F.col("rule_id").alias("_id"), F.struct(*rules.columns).alias("rule"))
    table = F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
    j = items.join(table, F.col("rule_id") == F.col("_id"), "left")
    missing = F.raise_error(F.concat(F.lit("no rule "), F.coalesce("rule_id", F.lit("null"))))
    return j.withColumn("rule", F.when(F.col("_id").isNull(), missing.cast(j.schema["rule"].dataType)).otherwise(F.col("rule"))).drop("_id")


def verify(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items (rule_id, facts map) with `fired` and `action`, the rule's action where it fires, else the default one."""
    j = with_rule(items, rules).withColumn("fired", fires(F.col("facts"), F.col("rule.conditions")))
    return j.withColumn("action", F.when(F.col("fired"), F.col("rule.rule_action")).otherwise(F.col("rule.default_action"))).drop("rule")


def _number(x: Column) -> Column:
    """Without a fraction where there is none, else two digits at most, as in a report."""
    rounded = F.round(x, 2)
    return F.when(rounded == F.floor(rounded), F.floor(rounded).cast("string")).otherwise(rounded.cast("string"))


def vignettes(templates: DataFrame, rules: DataFrame, count: int = 30) -> DataFrame:
    """Four items for each template (template_id, rule_id, i from 0): item_type, split, age, sex, facts, prompt, chosen,
    rejected. One narrow expansion after the join with the rules; ages run from 25 to 80 over `count` templates."""
    i = F.col("i")
    t = with_rule(templates, rules).withColumn("age", 25 + F.bround(i * 55 / F.lit(count - 1)).cast("int"))
    t = t.withColumn("sex", F.when(F.col("rule.female") | (i % 2 == 0), "female").otherwise("male")).select("*", F.explode(F.array(*map(F.lit, ITEM_TYPES))).alias("item_type"))
    kind = F.when(F.col("item_type") == "null_edit", "base").otherwise(F.col("item_type"))

    def facts(item: Column) -> Column:
        mine = lambda name: F.filter(F.col(f"rule.{name}"), lambda x: x["item"] == item)
        numbers = F.transform(mine("numbers"), lambda x: F.struct(x["field"].alias("k"), _number(x["start"] + F.pmod(i, x["modulo"]) * x["step"]).alias("v")))
        texts = F.transform(mine("texts"), lambda x: F.struct(x["field"].alias("k"), F.get(x["choices"], F.pmod(i, F.size(x["choices"])).cast("int")).alias("v")))
        female = (F.col("sex") == "female") & (item == "base")
        own = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("pregnant", "false"), ("beta_hcg", "negative"))]), lambda _: female)
        return F.map_from_entries(F.concat(numbers, texts, own))

    t = t.withColumn("facts", facts(kind)).withColumn("_shown", F.when(kind == "base", F.col("facts")).otherwise(F.map_zip_with(facts(F.lit("base")), F.col("facts"), lambda _, a, b: F.coalesce(b, a))))

    def line(n: int, default: Column) -> Column:
        own = lambda item: F.get(F.filter(F.col("rule.lines"), lambda x: (x["item"] == item) & (x["line"] == n)), 0)["text"]
        text = F.coalesce(own(kind), own(F.lit("base")), default)
        for name in NAMED:
            text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(F.col("_shown")[name], F.lit("")))
        return text

    turn = i + F.when(F.col("item_type") == "null_edit", 1).otherwise(0)
    pick = lambda xs, k: F.get(xs, F.pmod(k, F.nullif(F.size(xs), F.lit(0))).cast("int"))
    fixed = lambda xs: F.array(*map(F.lit, xs))
    said = F.coalesce(pick(F.col("rule.presentations"), i), F.lit(PRESENTATION))
    article = F.when(F.col("age").cast("string").startswith("8"), "An").otherwise("A")
    head = F.concat(article, F.lit(" "), "age", F.lit("-year-old "), "sex", F.lit(" presents "), pick(fixed(SETTINGS), turn), F.lit(" for management of "), "rule.indication", F.lit(". "), said)
    status = F.when(F.col("sex") == "female", "Reproductive status: non-pregnant.").otherwise("Reproductive status: not applicable.")
    prompt = F.concat_ws("\n", F.lit("Clinical Vignette:"), head, line(3, F.lit("")), line(4, status), line(5, F.lit("Drug allergies: none.")), line(6, F.lit("Family history: noncontributory.")), F.concat(pick(fixed(FINDINGS), turn), F.lit("\n")), F.lit(QUESTION))
    edited = F.col("item_type") == "edited"
    choice = lambda a, b: F.when(edited, F.col(f"rule.{a}")).otherwise(F.col(f"rule.{b}"))
    return t.select("template_id", "rule_id", "i", "rule.family", "rule.split", "item_type", "age", "sex", "facts", prompt.alias("prompt"), choice("rule_action", "default_action").alias("chosen"), choice("default_action", "rule_action").alias("rejected"), (~edited).alias("chosen_is_default"))


def violations(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items whose rule fires though it must not, or the other way round, or whose chosen action is not the verifier's;
    empty for a sound set."""
    return verify(items, rules).where((F.col("fired") != (F.col("item_type") == "edited")) | ~F.col("action").eqNullSafe(F.col("chosen")))


#: The lines of a prompt (from 1) in which an item may differ from its base.
MAY_DIFFER = {("edited", "renal"): [3], ("edited", "pregnancy"): [4], ("edited", "allergy"): [5], ("near_miss", "renal"): [3], ("near_miss", "pregnancy"): [4], ("near_miss", "allergy"): [6]}
MUST_CHANGE = {"null_edit": [2, 7]}


def line_differences(items: DataFrame) -> DataFrame:
    """template_id, item_type, family, `lines`: the numbers of the lines in which an item differs from its template's base.
    A template's items come together by one aggregation."""
    cut = F.split("prompt", "\n")
    g = items.groupBy("template_id").agg(F.first("family").alias("family"), F.max(F.when(F.col("item_type") == "base", F.col("prompt"))).alias("base"), F.collect_list(F.when(F.col("item_type") != "base", F.struct("item_type", cut.alias("w")))).alias("others"))
    base = F.split("base", "\n")
    changed = F.filter(F.transform(F.arrays_zip(base.alias("a"), F.col("o.w").alias("b")), lambda x, k: F.when(~x["a"].eqNullSafe(x["b"]), k + 1)), lambda k: k.isNotNull())
    return g.select("template_id", "family", "base", F.explode("others").alias("o")).select("template_id", "family", "o.item_type", changed.alias("lines"))


def checks(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule: n_items, ages, sexes and how many items break each check: unsound (verifier), form (an action is no plain
    order or holds a forbidden word), dose (a dose rule's two actions name different drugs), article, wrong_lines (an item
    differs from its base elsewhere than it may, or not where it must)."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    bad = lambda c: ~low(c).startswith("prescribe ") | F.exists(F.array(*map(F.lit, FORBIDDEN)), lambda w: F.contains(low(c), w))
    drug = F.col("rule.same_drug")
    judged = with_rule(verify(items, rules), rules).withColumn("_unsound", (F.col("fired") != (F.col("item_type") == "edited")) | ~F.col("action").eqNullSafe(F.col("chosen")))
    article = F.regexp_extract("prompt", r"(?m)^(An?) (\d+)-year-old", 1)
    wants = F.when(F.regexp_extract("prompt", r"(?m)^(An?) (\d+)-year-old", 2).startswith("8"), "An").otherwise("A")
    one = judged.groupBy("rule_id").agg(
        F.count("*").alias("n_items"), F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.count_if(F.col("sex") == "female").alias("n_female"), F.count_if(F.col("sex") == "male").alias("n_male"),
        F.count_if("_unsound").alias("unsound"), F.count_if(bad("chosen") | bad("rejected")).alias("form"), F.count_if(drug.isNotNull() & ~(F.contains(low("chosen"), drug) & F.contains(low("rejected"), drug))).alias("dose"), F.count_if(article != wants).alias("article"),
    )
    fits = F.when(F.col("item_type") == "null_edit", F.array_contains("lines", 2) & F.array_contains("lines", 7) & (F.size("lines") == 2))
    for (item, family), numbers in MAY_DIFFER.items():
        fits = fits.when((F.col("item_type") == item) & (F.col("family") == family), F.col("lines") == F.array(*map(F.lit, numbers)))
    wrong = line_differences(items).join(items.where("item_type = 'base'").select("template_id", "rule_id"), "template_id").groupBy("rule_id").agg(F.count_if(~F.coalesce(fits, F.lit(False))).alias("wrong_lines"))
    return one.join(wrong, "rule_id", "left")
