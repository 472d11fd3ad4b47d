"""Responses to examples that bring their own options: parsed, evaluated, and rewarded by name.

Labels, texts and gold answers are columns of the row, so questions with two options and with ten, with letters and with
roman numerals, go through one expression. Each response's JSON is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import records
from ..functions import scoring as S
from ..functions import shapes as H
from ..functions import text as T
from .items import once

FREE = ["open", "no_symbols"]


def with_examples(rows: DataFrame, example: str, completion: str) -> DataFrame:
    """rows with `example`, the struct of the JSON in column `example`, and `raw_response`, the text of the completion: a
    string, or a chat of messages (role, content)."""
    chat = rows.schema[completion].dataType.simpleString().startswith("array")
    text = H.completion_text(F.col(completion)) if chat else F.col(completion)
    rest = [c for c in rows.columns if c not in (example, completion)]
    return once(rows.select(*rest, text.alias("raw_response"), F.col(example).alias("_json")), "example", records.example(records.parsed(F.col("_json")))).drop("_json")


def evaluated(rows: DataFrame) -> DataFrame:
    """rows (example, raw_response) with parse_success, parse_failure_reason, evaluable, correct, selected_option_index and
    _text and _indices, implied_option_index, set_size, match_method and eval_note.

    A free answer that matches no option is wrong where options are shown, and not evaluable where they are hidden."""
    e, raw = F.col("example"), F.col("raw_response")
    c, labels, texts = e["condition"], e["option_labels"], e["option_texts"]
    rows = once(rows, "_a", P.strict_answer(raw))
    free, a_set = c.isin(FREE), c == "incorrect"
    one, several, words = P.parse_label(raw, labels, F.col("_a")), P.parse_label_set(raw, labels, F.col("_a")), P.parse_free_text(raw, F.col("_a"))
    place = lambda x: (F.nullif(F.array_position(labels, x), F.lit(0)) - 1).cast("int")
    parsed = F.struct(
        F.when(~free & ~a_set, one["label"]).alias("label"), F.when(a_set, F.transform(several["labels"], place)).alias("set"), F.when(free, words["text"]).alias("text"),
        F.when(free, words["reason"]).when(a_set, several["reason"]).otherwise(one["reason"]).alias("reason"),
    )
    rows = once(rows, "_p", parsed)
    rows = once(rows, "_m", F.when(F.col("_p.text").isNotNull(), T.match_option(F.col("_p.text"), texts)))
    chosen, n = F.col("_p.set"), F.size(texts)
    ok = F.col("_p.label").isNotNull() | chosen.isNotNull() | F.col("_p.text").isNotNull()
    left = F.array_except(F.sequence(F.lit(0), n - 1), chosen)
    implied = F.when((F.size(chosen) == n - 1) & (F.size(left) == 1), F.get(left, 0))
    index = F.when(free, F.col("_m.idx")).when(~a_set, place(F.col("_p.label"))).cast("int")
    rows = rows.withColumns({"parse_success": F.coalesce(ok, F.lit(False)), "parse_failure_reason": F.col("_p.reason"), "selected_option_index": index, "selected_option_indices": chosen, "implied_option_index": implied, "set_size": F.size(chosen)})
    rows = rows.withColumn("evaluable", F.col("parse_success") & F.when(c == "open", F.col("selected_option_index").isNotNull()).otherwise(F.lit(True)))
    right = F.when(a_set, F.array_sort(chosen) == F.array_sort(F.coalesce(e["gold_indices"], F.array().cast("array<int>")))).otherwise(F.col("selected_option_index") == e["gold_index"])
    size_note = F.concat(F.lit("selected "), F.col("set_size").cast("string"), F.lit(" options, expected "), (n - 1).cast("string"))
    missed = free & F.col("parse_success") & F.col("selected_option_index").isNull()
    return rows.withColumns({
        "correct": F.when(F.col("evaluable"), F.coalesce(right, F.lit(False))),
        "selected_option_text": F.get(texts, F.when(a_set, F.col("implied_option_index")).otherwise(F.col("selected_option_index"))),
        "match_method": F.when(~F.col("parse_success"), None).when(free, F.col("_m.method")).when(a_set, "label_set").otherwise("label"),
        "eval_note": F.when(~F.col("parse_success"), "not parsed").when(a_set & (F.col("set_size") != n - 1), size_note)
        .when(missed & (c == "open"), "free-text answer matches no reference option; needs semantic judgment").when(missed, "answer matches no displayed option"),
    }).drop("_a", "_p", "_m")


#: A reward: a Column over the columns of `evaluated`.
Reward = Callable[[float, float], Column]


def _parts() -> tuple[Column, Column, Column]:
    e = F.col("example")
    # The right number of options is three of four in the rule's terms.
    size = F.when(F.col("set_size") == F.size(e["option_texts"]) - 1, 3).otherwise(0)
    answer = F.coalesce(F.col("implied_option_index"), F.col("selected_option_index"))
    return S.reward_correct(e["condition"], F.col("correct")), S.reward_symbolic(e["condition"], F.col("parse_success"), F.col("correct"), answer, size), P.format_reward(F.col("raw_response"))


#: Rewards by name, each a function of the weights of the symbolic and of the format part. More are added by `reward`.
REWARDS: dict[str, Reward] = {
    "correct": lambda weight, beta: _parts()[0],
    "symbolic": lambda weight, beta: F.lit(weight) * _parts()[1],
    "format": lambda weight, beta: _parts()[2],
    "neurosymbolic": lambda weight, beta: S.reward_total(*_parts(), weight, beta),
}


def reward(name: str):
    """Registers a reward function under a name."""
    def add(f: Reward) -> Reward:
        REWARDS[name] = f
        return f

    return add


def batch_rewards(rows: DataFrame, names: list[str], example: str = "example_json", completion: str = "completion", weight: float = 1.0, beta: float = 0.1) -> DataFrame:
    """rows with a column of each named reward (reward_<name>) of their completions. A row without an example fails the job."""
    if example not in rows.columns:
        raise ValueError("no column of examples to reward against")
    missing = F.when(F.col(example).isNull(), F.raise_error(F.lit("a row has no example")).cast("string")).otherwise(F.col(example))
    e = evaluated(with_examples(rows.withColumn(example, missing), example, completion))
    rest = [c for c in rows.columns if c not in (example, completion)]
    return e.select(*rest, *[REWARDS[n](weight, beta).alias(f"reward_{n}") for n in names])
