"""Answers out of raw model output, as Column builders.

The contract is a JSON object with an `answer`. ``strict_answer`` is an Arrow function that reads it as a strict JSON
parser does (trailing text fails, of repeated keys the last counts); all else is built-in expressions on what it finds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Labels by kind of condition.
LETTERS = ["A", "B", "C", "D"]
ROMAN = ["I", "II", "III", "IV"]
#: What a strict parser finds under `answer`: whether it is there, its kind, the name of its type, and its value.
_ANSWER = Ty.StructType([Ty.StructField("found", Ty.BooleanType()), Ty.StructField("kind", Ty.StringType()), Ty.StructField("type", Ty.StringType()), Ty.StructField("text", Ty.StringType()), Ty.StructField("items", Ty.ArrayType(Ty.StringType()))])
#: What may stand before and behind a bare label, and the reasons of failures.
BEFORE, BEHIND = r"^[\s(\[]*", r"[\s)\].,:;!]*$"
EMPTY, NO_LABEL, NO_OBJECT, NO_SET, NO_TEXT = "empty response", "no valid label found", "response not valid JSON answer object", "empty label set", "answer empty or not a string"


@F.pandas_udf(_ANSWER)
def strict_answer(raw: pd.Series) -> pd.DataFrame:
    """What a strict parser finds under `answer`: whether it is there, its kind, and its value."""
    import json

    rows = []
    for s in raw:
        try:
            obj = json.loads(s)
        except (TypeError, ValueError):
            obj = None
        if not isinstance(obj, dict) or "answer" not in obj:
            rows.append((False, None, None, None, None))
            continue
        a = obj["answer"]
        kind = "null" if a is None else "string" if isinstance(a, str) else "list" if isinstance(a, list) else "other"
        rows.append((True, kind, type(a).__name__, a if kind == "string" else None, [str(x) for x in a] if kind == "list" else None))
    return pd.DataFrame(rows, columns=["found", "kind", "type", "text", "items"])


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def literal_list(raw: pd.Series) -> pd.Series:
    """Python literals that are lists of strings; others null."""
    import ast

    def one(s):
        try:
            v = ast.literal_eval(s)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [str(x) for x in v] if isinstance(v, list) else None

    return raw.map(one)


def _pattern(labels: list[str] | Column) -> Column:
    """Any of the labels as a word, longer ones first; the labels are a list, or a column for rows with their own."""
    if isinstance(labels, Column):
        longest = F.array_sort(labels, lambda a, b: F.length(b) - F.length(a))
        return F.concat(F.lit(r"\b("), F.array_join(longest, "|"), F.lit(r")\b"))
    return F.lit(r"\b(" + "|".join(sorted(labels, key=len, reverse=True)) + r")\b")


def _among(x: Column, labels: list[str] | Column) -> Column:
    return F.array_contains(labels, x) if isinstance(labels, Column) else x.isin(labels)


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _quoted(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def _blank(raw: Column) -> Column:
    return stripped(F.coalesce(raw, F.lit(""))) == ""


def _found(text: Column, labels: list[str] | Column) -> Column:
    return F.regexp_extract_all(F.upper(text), _pattern(labels), F.lit(1))


def parse_label(raw: Column, labels: list[str] | Column, answer: Column | None = None) -> Column:
    """(label, reason): the one label that the answer names, or why there is none. Without a JSON answer the whole
    response is read. `answer` is strict_answer(raw), if it is at hand."""
    a = strict_answer(raw) if answer is None else answer
    text = F.when(a["found"], a["text"]).otherwise(raw)
    bare = F.upper(F.regexp_replace(F.regexp_replace(text, BEFORE, ""), BEHIND, ""))
    found = F.array_sort(F.array_distinct(_found(text, labels)))
    result = lambda label, reason: F.struct(label.alias("label"), reason.cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    return (
        F.when(_blank(raw), result(none, F.lit(EMPTY)))
        .when(a["found"] & (a["kind"] != "string"), result(none, F.concat(F.lit("answer is "), a["type"], F.lit(", expected a single label"))))
        .when(_among(bare, labels), result(bare, F.lit(None)))
        .when(F.size(found) == 1, result(F.get(found, 0), F.lit(None)))
        .when(F.size(found) > 1, result(none, F.concat(F.lit("ambiguous: multiple labels "), _quoted(found))))
        .otherwise(result(none, F.lit(NO_LABEL)))
    )


def parse_first_phase(raw: Column, labels: list[str] | Column) -> Column:
    """(label, status) of a plain response, which is not read as JSON: ok, unparseable or ambiguous."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(stripped(raw), BEFORE, ""), BEHIND, ""))
    found = F.array_distinct(_found(raw, labels))
    one = F.when(_among(bare, labels), bare).when(F.size(found) == 1, F.get(found, 0))
    return F.struct(one.alias("label"), F.when(one.isNotNull(), "ok").when(F.size(found) > 1, "ambiguous").otherwise("unparseable").alias("status"))


def parse_label_set(raw: Column, labels: list[str] | Column, answer: Column | None = None) -> Column:
    """(labels, reason): the labels of a JSON answer that is a list or a text, once each, in the order of `labels`."""
    a = strict_answer(raw) if answer is None else answer
    found = F.when(a["kind"] == "list", F.transform(a["items"], lambda x: F.upper(stripped(x)))).when(a["kind"] == "string", _found(a["text"], labels))
    known = labels if isinstance(labels, Column) else F.array(*map(F.lit, labels))
    bad = F.filter(found, lambda x: ~_among(x, labels))
    none = F.lit(None).cast("array<string>")
    result = lambda ls, reason: F.struct(ls.alias("labels"), reason.cast("string").alias("reason"))
    return (
        F.when(_blank(raw), result(none, F.lit(EMPTY)))
        .when(found.isNull(), result(none, F.lit(NO_OBJECT)))
        .when(F.size(found) == 0, result(none, F.lit(NO_SET)))
        .when(F.size(bad) > 0, result(none, F.concat(F.lit("invalid labels "), _quoted(bad))))
        .otherwise(result(F.array_intersect(known, found), F.lit(None)))
    )


def parse_free_text(raw: Column, answer: Column | None = None) -> Column:
    """(text, reason): a JSON answer that is a text and not blank, without white space around it."""
    a = strict_answer(raw) if answer is None else answer
    text = stripped(a["text"])
    ok = F.coalesce(text, F.lit("")) != ""
    reason = F.when(_blank(raw), EMPTY).when(~a["found"], NO_OBJECT).when(~ok, NO_TEXT)
    return F.struct(F.when(ok, text).alias("text"), reason.alias("reason"))


def format_reward(raw: Column) -> Column:
    """1 for a JSON object with an answer, 0.8 if it is one once code fences go, else 0."""
    text = stripped(F.coalesce(raw, F.lit("")))
    fenced = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.startswith(stripped(line), F.lit("```"))), "\n")
    inner = F.when(F.contains(text, F.lit("```")), fenced)
    return F.when(strict_answer(text)["found"], F.lit(1.0)).when(strict_answer(inner)["found"], F.lit(0.8)).otherwise(F.lit(0.0))


PARSERS = {"label": parse_label, "label_set": parse_label_set, "free_text": parse_free_text}
