"""Nested raw records: parsed once into a variant, then read by typed paths with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a parsed value is described, by the kind that `schema_of_variant` starts with.
KINDS = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "VOID": "NoneType"}
#: The fields of an example that must be there, and those that are lists.
REQUIRED = ["question_id", "source_dataset", "source_id", "condition", "question"]
LISTS = ["option_labels", "option_texts"]


def parsed(raw: Column) -> Column:
    """The record as a variant; null where it is no JSON."""
    return F.try_parse_json(raw)


def tagged(raw: Column) -> Column:
    """(value, format) of a cell: the variant and its observed kind, as the text itself where it is no JSON."""
    v = F.try_parse_json(raw)
    shape = F.schema_of_variant(v)
    kind = F.lit("other")
    for prefix, name in KINDS.items():
        kind = F.when(shape.startswith(prefix), name).otherwise(kind)
    text = F.when(raw.isNull(), "null").when(v.isNull(), "raw-string (not valid JSON)").otherwise(F.concat(F.lit("json ("), kind, F.lit(")")))
    return F.struct(F.when(v.isNull(), raw).otherwise(F.to_json(v)).alias("value"), text.alias("format"))


def field(record: Column, path: str, kind: str) -> Column:
    """A typed field of a variant; null where the path leads nowhere or to another kind."""
    return F.try_variant_get(record, path, kind)


def finish_reason(record: Column) -> Column:
    return field(record, "$.candidates[0].finish_reason", "string")


def thinking_tokens(record: Column) -> Column:
    """(tokens, source): as reported; 0 where the total leaves no room for any; else unknown."""
    of = lambda name: field(record, f"$.usage_metadata.{name}", "long")
    told, total, known = of("thoughts_token_count"), of("total_token_count"), of("prompt_token_count") + of("candidates_token_count")
    none = told.isNull() & (total == known)
    tokens = F.when(told.isNotNull(), told).when(none, F.lit(0).cast("long"))
    return F.struct(tokens.alias("tokens"), F.when(told.isNotNull(), "reported").when(none, "derived").otherwise("unknown").alias("source"))


def example(record: Column, strict: bool = True) -> Column:
    """An example from a variant: lists default to empty, options_displayed to true, others to null. A required field that
    is missing fails the job, or, where strict is off, is named in `missing`."""
    get = lambda name, kind="string": field(record, f"$.{name}", kind)
    gone = F.array_compact(F.array(*[F.when(get(n).isNull(), F.lit(n)) for n in REQUIRED]))
    fail = F.raise_error(F.concat(F.lit("example without "), F.array_join(gone, ", ")))
    first = F.when(F.size(gone) > 0, fail.cast("string")).otherwise(get("question_id")) if strict else get("question_id")
    lists = [F.coalesce(get(n, "array<string>"), F.array().cast("array<string>")).alias(n) for n in LISTS]
    # A gold answer is one label or a set of them.
    gold = F.coalesce(get("gold_label", "array<string>"), F.array_compact(F.array(get("gold_label"))))
    return F.struct(
        first.alias("question_id"), *[get(n).alias(n) for n in REQUIRED[1:]], *lists, F.coalesce(get("options_displayed", "boolean"), F.lit(True)).alias("options_displayed"), gold.alias("gold_labels"),
        get("gold_text").alias("gold_text"), get("gold_index", "int").alias("gold_index"), get("gold_indices", "array<int>").alias("gold_indices"), gone.alias("missing"),
    )
