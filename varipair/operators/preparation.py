"""From benchmark rows to paired rows, examples and their checks.

Rows: source_dataset, source_id, condition, question, options (a JSON object), answer, prompt. Every check returns
rows that break it, so an empty result means a sound set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import scoring as S
from ..functions import shapes as H
from ..functions import text as T
from . import splits

#: Conditions by what their answer field holds, the text of the option that replaces a gold one.
TEXT_ANSWERS = ["open", "no_symbols"]
KEY_ANSWERS = ["roman_numeral", "none_of_the_provided", "fixed_pos"]
NO_OPTION = "None of the provided options"
SPLITS = ["train", "val", "diagnostic", "final_test"]
#: What a condition shows and what its gold answer looks like.
DISPLAY = {"open": "none", "no_symbols": "bullets"}
FORMAT = {"roman_numeral": "roman_label", "incorrect": "label_set", "open": "text", "no_symbols": "text"}


def text_of(options: Column, label: Column) -> Column:
    """The text of the option with a label; null without it."""
    return F.get(F.filter(H.options(options), lambda o: o["label"] == label), 0)["text"]


def pairs(rows: DataFrame) -> DataFrame:
    """Each question's baseline beside each other condition of it, matched by (source_dataset, source_id). Where the
    answer names what is wrong, there is no text to compare with, so its interpretation is null."""
    key = ["source_dataset", "source_id"]
    base = rows.where("condition = 'mcq'").select(*key, *[F.col(c).alias(f"original_{c}") for c in ("question", "options", "answer", "prompt")])
    other = rows.where("condition <> 'mcq'").select(*key, F.col("condition").alias("perturbation_type"), *[F.col(c).alias(f"perturbed_{c}") for c in ("question", "options", "answer", "prompt")])
    kind, raw = F.col("perturbation_type"), F.col("perturbed_answer")
    meant = F.when(kind.isin(TEXT_ANSWERS), raw).when(kind.isin(KEY_ANSWERS), text_of(F.col("perturbed_options"), raw))
    # Sorted and merged: rows that were expanded from a small file look small to Spark, and it would broadcast all baselines.
    return base.join(other.hint("merge"), key).select(
        *key, "perturbation_type", "original_question", "original_options", F.col("original_answer").alias("original_answer_letter"),
        text_of(F.col("original_options"), F.col("original_answer")).alias("original_answer_text"), "original_prompt",
        "perturbed_question", "perturbed_options", raw.alias("perturbed_answer_raw"), meant.alias("perturbed_answer_interpretation"), "perturbed_prompt",
        (kind == "incorrect").alias("is_task_inverted"),
        (T.norm_alphanumeric(F.col("perturbed_question")) != T.norm_alphanumeric(F.col("original_question"))).alias("question_text_changed"),
    )


def unpaired(rows: DataFrame) -> DataFrame:
    """Questions without each of the seven conditions exactly once."""
    g = rows.groupBy("source_dataset", "source_id").agg(F.count("*").alias("n_rows"), F.count_distinct("condition").alias("n_conditions"))
    n = len(S.CONDITIONS)
    return g.where((F.col("n_rows") != n) | (F.col("n_conditions") != n))


def unbuildable(paired: DataFrame) -> DataFrame:
    """Questions that lack a condition or whose baseline is not the same beside all conditions."""
    base = F.struct("original_question", "original_options", "original_answer_letter")
    g = paired.groupBy("source_dataset", "source_id").agg(F.count_distinct("perturbation_type").alias("n_conditions"), F.min(base).alias("lo"), F.max(base).alias("hi"))
    problem = F.when(F.col("n_conditions") < len(S.CONDITIONS) - 1, "missing perturbation rows").when(~F.col("lo").eqNullSafe(F.col("hi")), "mcq baseline differs between perturbation rows")
    return g.select("source_dataset", "source_id", problem.alias("problem")).where("problem IS NOT NULL")


def examples(paired: DataFrame) -> DataFrame:
    """Seven examples a question, each with the baseline's question, texts and gold beside its own. The baseline's
    example comes from the row of one condition, so nothing is joined or shuffled."""
    side = lambda kind, name, gold: F.struct(kind.alias("condition"), F.col(f"{name}_question").alias("question"), F.col(f"{name}_options").alias("options"), F.col(gold).alias("raw"), F.col(f"{name}_prompt").alias("prompt"))
    base, own = side(F.lit("mcq"), "original", "original_answer_letter"), side(F.col("perturbation_type"), "perturbed", "perturbed_answer_raw")
    both = F.when(F.col("perturbation_type") == "roman_numeral", F.array(base, own)).otherwise(F.array(own))
    e = paired.select("source_dataset", "source_id", "original_question", "original_options", F.col("original_answer_letter").alias("_letter"), F.explode(both).alias("_x"))
    e = e.select("*", "_x.*").withColumn("_o", H.options(F.col("original_options"))).withColumn("_p", H.options(F.col("options")))
    part = lambda opts, name: F.col(opts)[name]
    place = lambda xs, x: (F.nullif(F.array_position(xs, x), F.lit(0)) - 1).cast("int")
    c, raw = F.col("condition"), F.col("raw")
    e = e.withColumn("option_texts", part("_p", "text")).withColumn("_labels", part("_p", "label")).withColumn("mcq_texts", part("_o", "text"))
    e = e.withColumn("_set", F.array_sort(P.literal_list(F.when(c == "incorrect", raw))))
    keyed = ~c.isin(*TEXT_ANSWERS, "incorrect")
    e = e.withColumn("gold_index", F.when(keyed, place(F.col("_labels"), raw)).when(c != "incorrect", place(F.col("option_texts"), raw)))
    return e.select(
        F.concat("source_dataset", F.lit("::"), "source_id").alias("question_id"), "source_dataset", "source_id", "condition", "question",
        F.when(c.isin(TEXT_ANSWERS), F.array().cast("array<string>")).otherwise(F.col("_labels")).alias("option_labels"), "option_texts",
        (c != "open").alias("options_displayed"), F.when(keyed, F.array(raw)).when(c == "incorrect", F.col("_set")).alias("gold_labels"),
        F.when(c.isin(TEXT_ANSWERS), raw).when(keyed, F.get("option_texts", F.col("gold_index"))).alias("gold_text"), "gold_index",
        F.transform("_set", lambda x: place(F.col("_labels"), x)).alias("gold_indices"), "raw", "prompt",
        F.col("original_question").alias("mcq_question"), "mcq_texts", place(part("_o", "label"), F.col("_letter")).alias("mcq_index"),
    )


def semantic_audit(ex: DataFrame) -> DataFrame:
    """What each example changes against its baseline, and `problems`: what its condition does not allow. One
    projection, as examples carry their baseline."""
    c, texts, before, gold, was = F.col("condition"), F.col("option_texts"), F.col("mcq_texts"), F.col("gold_index"), F.col("mcq_index")
    n = F.size(before)
    old = F.get(before, was)
    question = T.norm_alphanumeric(F.col("question")) != T.norm_alphanumeric(F.col("mcq_question"))
    order, same = texts == before, F.array_sort(texts) == F.array_sort(before)
    content = F.when(c.isin("mcq", "incorrect"), False).otherwise(~F.col("gold_text").eqNullSafe(old))
    moved = F.when(c.isin("mcq", "incorrect"), False).when(c != "open", ~gold.eqNullSafe(was))
    display, form, inverted = H.observed_display(F.col("prompt")), H.observed_format(F.col("raw")), F.col("prompt").rlike(r"(?i)\bincorrect\b")
    lookup = lambda known, rest: F.coalesce(*[F.when(c == k, v) for k, v in known.items()], F.lit(rest))
    want_display, want_format = lookup(DISPLAY, "labeled"), lookup(FORMAT, "letter_label")
    letters = F.slice(F.array(*map(F.lit, "ABCDEFGHIJ")), 1, n)
    romans = F.slice(F.array(*map(F.lit, H.ROMAN_EIGHT)), 1, n)
    others = F.forall(F.sequence(F.lit(0), n - 1), lambda i: (i == was) | F.get(texts, i).eqNullSafe(F.get(before, i)))
    complement = F.filter(F.sequence(F.lit(0), n - 1), lambda i: i != was)
    none = c == "none_of_the_provided"
    found = [
        (display != want_display, F.concat(F.lit("display observed="), display, F.lit(" expected="), want_display)),
        (form != want_format, F.concat(F.lit("answer format observed="), form, F.lit(" expected="), want_format)),
        (inverted != (c == "incorrect"), F.concat(F.lit("task inversion observed="), F.initcap(inverted.cast("string")))),
        ((c == "mcq") & (F.col("option_labels") != letters), "mcq labels not consecutive letters"),
        (~c.isin("mcq", "open") & question, "question changed"),
        (c.isin("roman_numeral", "incorrect", "no_symbols") & ~order, "option texts/order changed"),
        ((c == "roman_numeral") & (F.col("option_labels") != romans), F.concat(F.lit("labels "), F.array_join("option_labels", ","))),
        (c.isin("roman_numeral", "no_symbols") & (content | moved), "gold moved or changed"),
        (none & (F.size(texts) != n), "option count changed"),
        (none & moved, "gold position changed"),
        (none & ~F.col("gold_text").eqNullSafe(F.lit(NO_OPTION)), F.concat(F.lit("gold text is "), F.coalesce("gold_text", F.lit("None")))),
        (none & F.array_contains(texts, old), "original gold text still present"),
        (none & ~others, "non-gold options changed"),
        ((c == "fixed_pos") & ~same, "option set changed"),
        ((c == "fixed_pos") & content, "gold content changed"),
        ((c == "fixed_pos") & ~gold.eqNullSafe(n - 1), F.concat(F.lit("gold not in last position (index "), F.coalesce(gold.cast("string"), F.lit("None")), F.lit(")"))),
        ((c == "incorrect") & ~F.col("gold_indices").eqNullSafe(complement), F.concat(F.lit("gold set "), F.coalesce(F.array_join("gold_labels", ","), F.lit("None")), F.lit(" != complement of mcq gold"))),
        ((c == "open") & content, "gold text differs from mcq gold text"),
    ]
    problems = F.array_compact(F.array(*[F.when(broken, F.lit(what) if isinstance(what, str) else what) for broken, what in found]))
    distinct = F.size(F.array_distinct(F.transform(texts, T.norm_alphanumeric)))
    return ex.select(
        "question_id", "condition", question.alias("question_changed"), F.size(texts).alias("option_count"), order.alias("order_same"), same.alias("set_same"), content.alias("gold_changed"),
        moved.alias("gold_moved"), inverted.alias("inverted"), display.alias("display"), form.alias("format"), (distinct < F.size(texts)).alias("duplicate_options"), F.array_join(problems, "; ").alias("problems"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per condition: how often each flag is set, the formats seen, and examples with problems."""
    flags = [F.count_if(c).alias(f"n_{c}") for c in ("question_changed", "order_same", "set_same", "gold_changed", "gold_moved", "inverted", "duplicate_options")]
    return audit.groupBy("condition").agg(F.count("*").alias("n"), *flags, F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"), F.count_if(F.col("problems") != "").alias("n_problems"))


def structural_checks(ex: DataFrame, records: DataFrame, n_options: int = 4) -> DataFrame:
    """(check, subject, detail): examples and records (question_id, condition) that do not fit. Both sides are counted
    in one aggregation."""
    key = ["question_id", "condition"]
    tagged = ex.select(*key, F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(records.select(*key, F.lit(0).alias("e"), F.lit(1).alias("r")))
    n = tagged.groupBy(*key).agg(F.sum("e").alias("e"), F.sum("r").alias("r"))
    row = lambda df, check, detail: df.select(F.lit(check).alias("check"), F.concat_ws("/", "question_id", "condition").alias("subject"), detail.cast("string").alias("detail"))
    sets = n.where("e > 0").groupBy("question_id").agg(F.count("*").alias("have"), F.lit(None).cast("string").alias("condition"))
    index = F.col("gold_index")
    bad_set = F.col("gold_indices").isNull() | (F.size("gold_indices") == 0) | F.exists("gold_indices", lambda i: i.isNull() | (i >= F.size("option_texts")))
    bad = F.when(F.col("condition") == "incorrect", bad_set).otherwise(index.isNull() | (index < 0) | (index >= F.size("option_texts")))
    return (
        row(n.where("e > 1"), "duplicate example", F.col("e"))
        .unionByName(row(n.where("e > 0 AND r = 0"), "missing record", F.col("e")))
        .unionByName(row(n.where("e = 0"), "extra record", F.col("r")))
        .unionByName(row(n.where("r > 1"), "duplicate record", F.col("r")))
        .unionByName(row(sets.where(F.col("have") != len(S.CONDITIONS)), "incomplete condition set", F.col("have")))
        .unionByName(row(ex.where(F.size("option_texts") != n_options), "option count", F.size("option_texts")))
        .unionByName(row(ex.where(bad), "invalid gold", F.when(F.col("condition") == "incorrect", F.array_join("gold_indices", ",")).otherwise(index.cast("string"))))
    )


def split_checks(manifest: DataFrame, rows: DataFrame, cohorts: dict[str, DataFrame], per_question: int = 6) -> DataFrame:
    """(check, detail, n), only of what is broken. manifest: question_id, split; rows: question_id, key (the normalised
    question), a row for each condition; cohorts: question_ids that belong in diagnostic alone."""
    named = lambda df, check: df.select(F.lit(check).alias("check"), F.concat_ws("/", "split", "other").alias("detail"), F.col("n_shared").alias("n"))
    single = lambda df, check, detail: df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(check).alias("check"), F.lit(detail).alias("detail"), "n")
    known = manifest.where(F.col("split").isin(SPLITS))
    keyed = known.join(rows.select("question_id", "key").distinct(), "question_id")
    counts = rows.groupBy("question_id").agg(F.count("*").alias("c"))
    out = named(splits.leakage(known, "question_id"), "question id").unionByName(named(splits.leakage(keyed, "key"), "question text"))
    for name, ids in cohorts.items():
        ids = ids.select("question_id").distinct()
        out = out.unionByName(single(known.where("split <> 'diagnostic'").select("question_id").distinct().join(ids, "question_id", "left_semi"), f"{name} cohort", "outside diagnostic"))
        out = out.unionByName(single(ids.join(known.where("split = 'diagnostic'"), "question_id", "left_anti"), f"{name} cohort", "not in diagnostic"))
    ids = manifest.select("question_id").distinct()
    out = out.unionByName(single(ids.join(counts, "question_id", "left_anti"), "completeness", "not among the rows"))
    out = out.unionByName(single(counts.join(ids, "question_id", "left_anti"), "completeness", "not in the manifest"))
    out = out.unionByName(single(counts.where(F.col("c") != per_question), "rows of a question", f"not {per_question}"))
    return out.unionByName(single(manifest.where(F.coalesce(~F.col("split").isin(SPLITS), F.lit(True))), "split name", "unknown"))
