"""Text functions as Column builders: normalisers, tokens, containment, skeletons, option matching.

Regular expressions carry (?U) where Python's Unicode classes are meant. None of these is a UDF except
``lexical_similarity``, which has no expression in SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that hint at the alternative action.
KEYWORDS = [
    "beta-hcg", "gestation", "anaphylaxis", "stevens-johnson", "sjs", "bronchospasm", "nasal polyps",
    "penicillin allergy", "sulfonamide allergy", "aspirin sensitivity",
]
#: What a skeleton puts marks for, in order.
SKELETON = [
    (r"\b\d{1,2}-year-old\b", "<AGE>-year-old"),
    (r"\b\d+(\.\d+)?\s*(mg/dL|mEq/L|mL/min|mmHg|bpm|mIU/mL|U/L|cm|mm/hr|%)\b", "<VALUE>"),
    (r"\b\d+\b", "<NUM>"),
    (r"\b(female|male|She|He|Her|His)\b", "<PRONOUN>"),
]


def empty_if_null(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def norm_words(s: Column) -> Column:
    """Lower case; all but a-z and 0-9 become single spaces."""
    return F.trim(F.regexp_replace(F.lower(empty_if_null(s)), "[^a-z0-9]+", " "))


def norm_no_punctuation(s: Column) -> Column:
    """Lower case; ASCII punctuation deleted; white space collapsed."""
    return collapse(F.translate(F.trim(F.lower(empty_if_null(s))), PUNCTUATION, ""))


def norm_collapse_first(s: Column) -> Column:
    """As norm_no_punctuation, but white space is collapsed before punctuation goes."""
    return F.translate(collapse(F.lower(empty_if_null(s))), PUNCTUATION, "")


def norm_alphanumeric(s: Column) -> Column:
    """Lower case; letters, digits and white space of any script stay; collapsed."""
    return collapse(F.regexp_replace(F.lower(empty_if_null(s)), r"(?U)[^\p{L}\p{N}\s]", ""))


def norm_case(s: Column) -> Column:
    """Lower case and collapsed; punctuation stays."""
    return collapse(F.lower(empty_if_null(s)))


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(empty_if_null(s), r"(?U)\s+"), lambda w: w != ""))


def words(s: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(empty_if_null(s)), F.lit(r"(?U)\b\w+\b"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; two empty ones are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_words(hay: Column, needle: Column) -> Column:
    """Whether a normalised phrase stands in a normalised text as whole words; an empty one never does."""
    return (needle != "") & F.contains(F.concat(F.lit(" "), hay, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def skeleton(s: Column) -> Column:
    """Ages, quantities, numbers and words of sex replaced by marks."""
    s = F.regexp_replace(empty_if_null(s), r"^\s+|\s+$", "")
    for pattern, mark in SKELETON:
        s = F.regexp_replace(s, pattern, mark)
    return s


def keyword_hit(s: Column, keywords: list[str] = KEYWORDS) -> Column:
    low = F.lower(empty_if_null(s))
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)).cast("int")


def repeated_phrase(s: Column) -> Column:
    """The first two words that stand twice in a row; null if none do."""
    return F.nullif(F.regexp_extract(empty_if_null(s), r"(?i)\b(\w+\s+\w+)\s+\1\b", 1), F.lit(""))


def article_problem(s: Column) -> Column:
    """An `N-year-old` that begins a line with the wrong article, or has none; null if it is right. Ages that begin with 8
    take An."""
    pattern = r"(?m)^(An?)\s+(\d+)-year-old"
    found, age = F.regexp_extract(empty_if_null(s), pattern, 1), F.regexp_extract(empty_if_null(s), pattern, 2)
    want = F.when(age.startswith("8"), "An").otherwise("A")
    return F.when(found == "", F.lit("missing age pattern")).when(found != want, F.concat(F.lit("article mismatch: "), found, F.lit(" "), age, F.lit("-year-old")))


def changed_lines(a: Column, b: Column) -> Column:
    """The numbers (from 1) of the non-blank lines in which two texts differ; one that the other lacks differs."""
    lines = lambda s: F.filter(F.split(empty_if_null(s), "\n"), lambda x: F.trim(x) != "")
    pairs = F.arrays_zip(lines(a).alias("a"), lines(b).alias("b"))
    return F.filter(F.transform(pairs, lambda x, k: F.when(~x["a"].eqNullSafe(x["b"]), k + 1)), lambda k: k.isNotNull())


def oxford_list(labels: Column) -> Column:
    """A; A or B; A, B, or C."""
    n = F.size(labels)
    return F.when(n < 3, F.array_join(labels, " or ")).otherwise(F.concat(F.array_join(F.slice(labels, F.lit(1), n - 1), ", "), F.lit(", or "), F.element_at(labels, -1)))


def match_option(answer: Column, options: Column) -> Column:
    """(idx, method) of a free answer among options (0-based): equal after normalisation; else the one maximal option
    that stands in the answer, if it is 0.4 of its length; else the one option that the answer stands in, if that is
    0.6 of the option's length. Several maximal options are ambiguous, whatever their lengths."""
    a, opts = norm_words(answer), F.transform(options, norm_words)
    at = F.transform(opts, lambda o, i: F.struct(i.alias("i"), o.alias("o")))
    exact = F.filter(at, lambda x: x["o"] == a)
    inside = F.filter(at, lambda x: contains_words(a, x["o"]))
    longest = F.filter(inside, lambda x: ~F.exists(inside, lambda y: (y["i"] != x["i"]) & contains_words(y["o"], x["o"])))
    around = F.filter(at, lambda x: contains_words(x["o"], a))
    result = lambda idx, method: F.struct(idx.cast("int").alias("idx"), F.lit(method).alias("method"))
    none = F.lit(None)
    return (
        F.when(F.size(exact) == 1, result(F.get(exact, 0)["i"], "exact"))
        .when(F.size(exact) > 1, result(none, "ambiguous_exact"))
        .when((F.size(longest) == 1) & (F.length(F.get(longest, 0)["o"]) >= 0.4 * F.length(a)), result(F.get(longest, 0)["i"], "option_in_answer"))
        .when(F.size(longest) > 1, result(none, "ambiguous_multiple_options_in_answer"))
        .when((F.size(around) == 1) & (F.length(a) >= 0.6 * F.length(F.get(around, 0)["o"])), result(F.get(around, 0)["i"], "answer_in_option"))
        .otherwise(result(none, "no_match"))
    )


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def lexical_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts after norm_alphanumeric."""
    return _ratio(norm_alphanumeric(a), norm_alphanumeric(b))
