"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule;
policies are named, versioned masks over those bits, so another policy, or the question what a rule alone
costs, needs no second look at the texts.

Cases: null text counts as empty (0 words, fails `few_words`); a null or repeated doc_id is kept row by row;
an empty table gives an empty ledger; extra columns are ignored by the ledger. Memory is that of one slice of
about 2 MB of text, or of the longest single text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Rule name and the SQL predicate that fails a document. The place in the list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": ("few_words", "repeated_windows"),
    "web/1": ("few_words", "repeated_windows", "symbols", "dup_lines"),
    "web/2": tuple(name for name, _ in RULES),
}

_SPACE, _SYMBOLS, _UPPER = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    windows = C.hash_windows(C.hash_words(words), 3)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, windows)
    hit = twice[np.minimum(at, len(twice) - 1)] == windows
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(windows)] |= hit
    return int(covered.sum())


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measure(data: bytes, length: int) -> tuple[int, ...]:
    """The measurements of one text of `length` code points, in the order of MEASURES."""
    words = data.split()
    n_lines, n_dup = duplicate_lines(data)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return len(words), length - count(_SPACE), count(_SYMBOLS), n_dup, repeat_words(words), n_lines, count(_UPPER)


def _measure(batches, keep: list[str], prefix: str):
    for part in C.steps(batches):
        chars = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_pylist()
        rows = [measure(*x) for x in zip(C.texts_of(part.column("text")), chars, strict=True)]
        columns = [part.column(k) for k in keep] + [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(prefix + m for m in MEASURES)])


def measured(docs: DataFrame, keep: list[str], prefix: str = "_m_") -> DataFrame:
    """The columns `keep` of docs and the measurements, named by the prefix and the measurement's name."""
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"`{prefix}{m}` long" for m in MEASURES])
    return C.arrow_map(docs.select(*dict.fromkeys([*keep, "text"])), _measure, schema, keep, prefix)


def failure_bits(prefix: str = "") -> Column:
    bits = F.lit(0).cast("long")
    for i, (_, predicate) in enumerate(RULES):
        predicate = re.sub(r"n_\w+|word_chars", lambda m: prefix + m[0], predicate)
        bits = bits.bitwiseOR(F.when(F.expr(predicate), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, the measurements and `failed`, the bits of the rules it fails."""
    rows = measured(docs, ["doc_id"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"_m_{m}").alias(m) for m in MEASURES)).withColumn("failed", failure_bits())


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def apply_policy(book: DataFrame, policy: str = "web/2") -> DataFrame:
    """The ledger with `base_failed` and `kept` under a named policy."""
    failed = lambda mask: F.col("failed").bitwiseAND(F.lit(mask).cast("long")) != 0
    return book.withColumn("base_failed", failed(mask_of("base/1"))).withColumn("kept", ~failed(mask_of(policy) | mask_of("base/1"))).withColumn("policy", F.lit(policy))


def ablations(book: DataFrame, policy: str = "web/2") -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects (what dropping the
    rule would bring back). One pass, partial aggregates of a few longs per task."""
    mask = mask_of(policy)
    names = POLICIES[policy]
    aggs = [F.count_if(F.col("failed").bitwiseAND(F.lit(BIT[n]).cast("long")) != 0).alias(f"f_{n}") for n in names]
    aggs += [F.count_if(F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == BIT[n]).alias(f"o_{n}") for n in names]
    aggs += [F.coalesce(F.bit_or("failed"), F.lit(0).cast("long")).alias("seen")]
    one = book.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"), (F.col("seen").bitwiseAND(F.lit(BIT[n]).cast("long")) != 0).alias("ever")) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def filter_documents(docs: DataFrame, policy: str = "web/2") -> DataFrame:
    """The rows of docs, all columns, that the policy keeps. The measurements travel with the row, so nothing
    is shuffled or joined, and rows with null or repeated ids are judged one by one."""
    reject = F.lit(mask_of(policy) | mask_of("base/1")).cast("long")
    prefix = "_m_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return measured(docs, docs.columns, prefix).where(failure_bits(prefix).bitwiseAND(reject) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(C.table(spark, sf_dir, "documents")))


def policy_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the policy does to documents. The ledger is written once; any policy is judged from it."""
    return ablations(C.written(ledger(C.table(spark, sf_dir, "documents")), "quality-ledger"))


#: DuckDB SQL for op7.
SQL7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
b AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper FROM w),
l AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines FROM (
        SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
        SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(n_upper AS BIGINT) AS n_upper
      FROM b LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 8 ELSE 0 END)
        + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, 'web/2' AS policy FROM f
"""

#: DuckDB SQL for policy_ablations.
SQL_ABLATIONS = f"""WITH b AS ({SQL7}), r(rule, bit) AS (VALUES {", ".join(f"('{n}', {BIT[n]})" for n in POLICIES["web/2"])})
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & {mask_of("web/2")} = bit) AS n_only, coalesce(bool_or(failed & bit <> 0), FALSE) AS ever FROM r LEFT JOIN b ON TRUE GROUP BY rule"""
