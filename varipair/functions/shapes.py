"""Prompts, answer schemas, shapes of options, golds and answers, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import ROMAN, strict_answer, stripped
from .text import oxford_list, word_count

#: The texts of a prompt.
QUESTION = "Question: "
LABEL_TAIL = "Output only that single token and nothing else - no explanation, no punctuation, no reasoning."
SET_TAIL = "Output only those {0}s and nothing else - no explanation, no reasoning."
BULLET_TAIL = "Answer with only the exact text of the correct option, copied verbatim, without any letter or symbol. Output only that text and nothing else - no explanation, no reasoning."
OPEN_TAIL = "Answer with only the concise final answer (a short phrase). Output only that answer and nothing else - no explanation, no reasoning."
#: Causes of a missing answer.
CUT_EMPTY = "MAX_TOKENS truncation - zero visible output (thinking consumed entire budget)"
CUT_SHORT = "MAX_TOKENS truncation - cut off mid-preamble before JSON answer completed"
EMPTY_END = "empty response, non-MAX_TOKENS finish_reason"
UNREADABLE = "unparseable content despite normal finish_reason (not a truncation artifact)"
#: Roman numerals of the descriptive tables.
ROMAN_EIGHT = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII"]


def prompt(condition: Column, question: Column, labels: Column, texts: Column) -> Column:
    """The one template: a question, its options as the condition shows them, and what to answer with."""
    kind = F.when(condition == "roman_numeral", "roman numeral").otherwise("letter")
    labeled = F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(F.lit("("), a, F.lit(") "), b)), "\n")
    bullets = F.array_join(F.transform(texts, lambda x: F.concat(F.lit("- "), x)), "\n")
    head = F.concat(F.lit(QUESTION), question, F.lit("\n\n"))
    one = F.concat(F.lit("Answer with only the "), kind, F.lit(" of the correct option ("), oxford_list(labels), F.lit("). " + LABEL_TAIL))
    many = F.concat(
        F.lit("Exactly "), (F.size(labels) - 1).cast("string"), F.lit(" of these options are INCORRECT. Answer with only the "), kind, F.lit("s of all the incorrect options. "),
        F.replace(F.lit(SET_TAIL), F.lit("{0}"), kind),
    )
    return (
        F.when(condition == "no_symbols", F.concat(head, bullets, F.lit("\n\n" + BULLET_TAIL)))
        .when(condition == "open", F.concat(head, F.lit(OPEN_TAIL)))
        .otherwise(F.concat(head, labeled, F.lit("\n\n"), F.when(condition == "incorrect", many).otherwise(one)))
    )


def answer_schema(kind: Column, labels: Column) -> Column:
    """The JSON schema of an answer object: one label, a set of labels, or a text."""
    label = F.concat(F.lit('{"type": "string", "enum": ['), F.array_join(F.transform(labels, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]}"))
    answer = F.when(kind == "label", label).when(kind == "label_set", F.concat(F.lit('{"type": "array", "items": '), label, F.lit("}"))).otherwise('{"type": "string"}')
    return F.concat(F.lit('{"type": "object", "properties": {"answer": '), answer, F.lit('}, "required": ["answer"]}'))


def options(raw: Column) -> Column:
    """The (label, text) pairs of a JSON object of options, in its order; null if it is none."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    return F.when(F.json_object_keys(raw).isNotNull(), F.transform(entries, lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text"))))


def mean_words(opts: Column) -> Column:
    """The mean number of words of options; null without any."""
    total = F.aggregate(opts, F.lit(0), lambda n, o: n + word_count(o["text"]).cast("int"))
    return F.when(F.size(opts) > 0, total / F.size(opts))


def position(opts: Column, label: Column) -> Column:
    """Where a label stands among options, from 0; null if it does not."""
    return (F.nullif(F.array_position(F.transform(opts, lambda o: o["label"]), label), F.lit(0)) - 1).cast("int")


def answer_format(raw: Column) -> Column:
    s = stripped(raw)
    return (
        F.when(raw.isNull(), "unknown").when(s.startswith("[") & s.endswith("]"), "list_of_letters").when(s.isin(ROMAN_EIGHT), "roman_numeral")
        .when(s.rlike(r"^\p{Lu}$"), "letter").otherwise("free_text")
    )


def observed_format(gold: Column) -> Column:
    s = stripped(F.coalesce(gold, F.lit("None")))
    return F.when(s.startswith("[") & s.endswith("]"), "label_set").when(s.isin(*ROMAN, "V", "VI"), "roman_label").when(s.rlike("^[A-J]$"), "letter_label").otherwise("text")


def observed_display(text: Column) -> Column:
    return F.when(text.rlike(r"(?m)^\s*\((A|I)\)\s"), "labeled").when(text.rlike(r"\n- \S"), "bullets").otherwise("none")


def missing_cause(finish: Column, text: Column, cut: tuple[str, ...] = ("MAX_TOKENS", "FinishReason.MAX_TOKENS")) -> Column:
    blank = stripped(F.coalesce(text, F.lit(""))) == ""
    return F.when(finish.isin(*cut), F.when(blank, CUT_EMPTY).otherwise(CUT_SHORT)).when(blank, EMPTY_END).otherwise(UNREADABLE)


def contract(text: Column) -> Column:
    """Output as an answer object: as it is if it is one, without code fences if it stands in them, else wrapped."""
    wrap = lambda s: F.to_json(F.struct(s.alias("answer")))
    inner = stripped(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.startswith(line, F.lit("```"))), "\n"))
    whole = F.try_parse_json(text).isNotNull()
    fenced = text.startswith("```") & ~whole
    return F.when(strict_answer(text)["found"], text).when(fenced & strict_answer(inner)["found"], inner).when(fenced, wrap(inner)).otherwise(wrap(text))


def completion_text(messages: Column) -> Column:
    """The content of a chat's last message, else of its first."""
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.try_element_at(messages, F.lit(1))["content"])


def safe_id(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("::"), F.lit("__")), F.lit("/"), F.lit("_"))


def key_parts(key: Column) -> Column:
    """(source_dataset, source_id) of a question id."""
    return F.struct(F.split_part(key, F.lit("::"), F.lit(1)).alias("source_dataset"), F.split_part(key, F.lit("::"), F.lit(2)).alias("source_id"))


def shortened(s: Column, most: int = 300) -> Column:
    mark = F.concat(F.substring(s, 1, most), F.lit("... [truncated, full length="), F.length(s).cast("string"), F.lit("]"))
    return F.when(F.length(s) > most, mark).otherwise(s)
