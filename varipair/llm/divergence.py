"""Source divergence audit: where a source's terms depart from its language's and from other sources'.

Terms are runs of letters a-z (A-Z lower-cased) and code points from U+0080. A language keeps its V terms that stand in
`min_docs` of its documents or more. A group (lang, source), and each language itself, gives a kept term of count c the
integer probability p = 1 + floor(10**9 (c + 2) / (N + 2 V)), N the sum of its counts of kept terms; two probabilities
differ by f = floor((p - q)**2 / (p + q)).

Top terms: f grows with the group's p and falls with the language's q while p > q. So the terms of a group are put in
buckets of like counts; the largest p and the least q in a bucket bound f there. Buckets are evaluated best bound first,
in rounds of twice as many, until the bounds of all unseen ones are strictly below the group's k-th value.

Pairs: a term in neither source adds f of the two probabilities of count 0, a term in one of them a value that depends on
its count alone, so counts of equal probabilities give both sums. All come from postings: (lang, term) rows by
blocks of SOURCES sources and shares of terms, one group for each pair of blocks, summed by numpy; no pair leaves it
but as a sum.

Cases: null text, lang and source are empty; each row is a document; a group without terms has its pairs (p of count 0) and
no term rows; a language without kept terms has pairs of value 0; one with one source has none; an empty table gives no rows;
extra columns are ignored. Counts are exact (products in decimals). Memory: MEMO terms of a counting task, one bucket row per
group and count class, SHARE posting rows of a group of sums.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

UNIT = 1_000_000_000
#: Sources of a posting block, posting rows of a group, count classes per doubling of the count.
SOURCES, SHARE, CLASSES = 128, 50_000, 4
#: Rows of groups or buckets that may be broadcast.
BROADCAST_ROWS = 500_000
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = "lang string, source string, term string, c long, docs long"
SUMS = "lang string, a long, b long, value long"


def _count(batches, memo: int):
    """(lang, source, term, count, documents) of what a task has read; a row with a null term for each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("docs", pa.int64())])
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def flush():
        for group in list(counts):
            c, d = counts.pop(group), docs.pop(group)
            yield C.batch_of(schema, [[group[0]] * (len(c) + 1), [group[1]] * (len(c) + 1), pa.array([*c, None], pa.binary()).cast(pa.string()), [*c.values(), 0], [*map(d.__getitem__, c), 0]])

    for part in C.steps(batches):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), C.texts_of(part.column("text")), strict=True):
            words, c = text.translate(TERMS).split(), counts[lang, source]
            before = len(c)
            c.update(words)
            docs[lang, source].update(set(words))
            held += len(c) - before
        if held > memo:
            yield from flush()
            held = 0
    yield from flush()


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c and docs of each group's terms; term null, once, for each group. Written."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = C.arrow_map(docs.select(text("lang"), text("source"), text("text")), _count, COUNTED, C.MEMO)
    return C.written(rows.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")), "divergence-counts")


def _p(c: str) -> str:
    """The probability of count c in a group of n counts where V terms are kept; null where none are."""
    return f"CAST(1 + CAST({c} + 2 AS DECIMAL(28,0)) * CAST({UNIT} AS DECIMAL(10,0)) div CAST(nullif(n + 2 * v, 0) AS DECIMAL(28,0)) AS BIGINT)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def small(df: DataFrame) -> DataFrame:
    """df for a broadcast join if it is counted to be small enough, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def kept_terms(counts: DataFrame, min_docs: int = 10) -> tuple[DataFrame, DataFrame]:
    """(kept, groups), both written. kept: lang, source, term, c, lc (the count in the language) of the kept terms that
    a group has. groups: lang, source, s (from 0 in the language), n, v, ln (n of the language), p0."""
    terms = counts.where("term IS NOT NULL")
    by_lang = terms.groupBy("lang", "term").agg(F.sum("c").alias("lc"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = C.written(terms.drop("docs").join(by_lang, ["lang", "term"]), "divergence-kept")
    of_group = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    of_lang = kept.groupBy("lang", "term").agg(F.first("lc").alias("lc")).groupBy("lang").agg(F.sum("lc").alias("ln"), F.count("*").alias("v"))
    groups = counts.where("term IS NULL").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "ln", "v"])
    s = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    return kept, C.written(groups.withColumn("s", s).withColumn("p0", F.expr(_p("0"))), "divergence-groups")


def top_terms(kept: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """lang, source, term, value, rank: the k kept terms of each group with the largest f among those with p > q."""
    q = _p("lc").replace("n + 2", "ln + 2")
    terms = kept.join(small(groups), ["lang", "source"]).select("lang", "source", "term", F.expr(_p("c")).alias("p"), F.expr(q).alias("q"), F.floor(F.log2("c") * CLASSES).cast("int").alias("bucket"))
    terms = C.written(terms.where("p > q"), "divergence-terms")
    best_first = Window.partitionBy("lang", "source").orderBy(F.col("bound").desc(), "bucket")
    buckets = terms.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).withColumn("bound", F.expr(_f("p", "q")))
    unseen = C.written(buckets.select("lang", "source", "bucket", "bound", F.row_number().over(best_first).alias("turn")), "divergence-buckets")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    best, upto = terms.select("lang", "source", "term", F.lit(0).cast("long").alias("value")).limit(0), 1
    while True:
        now = unseen.where(F.col("turn") <= upto).select("lang", "source", "bucket")
        found = terms.join(small(now), ["lang", "source", "bucket"]).select("lang", "source", "term", F.expr(_f("p", "q")).alias("value"))
        best = C.written(best.select("lang", "source", "term", "value").unionByName(found).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "divergence-best")
        kth = best.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
        unseen = C.written(unseen.where(F.col("turn") > upto).join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth").drop("kth"), "divergence-buckets")
        if unseen.isEmpty():
            return best
        upto *= 2


def _difference(p, q):
    return (p - q) ** 2 // (p + q)


def _sums(rows: pa.Table, size: int) -> pa.Table:
    """For each pair a < b of the sources in a cell: the sum over terms in either of f less f of the counts 0."""
    term, s, p, p0 = rows["term"].combine_chunks(), np.asarray(rows["s"]), np.asarray(rows["p"].fill_null(0)), np.asarray(rows["p0"].fill_null(0))
    first, second = rows["first"][0].as_py(), rows["second"][0].as_py()
    code = np.asarray(term.dictionary_encode().indices.fill_null(-1))
    zero = {int(x): int(y) for x, y in zip(s, p0, strict=True)}
    has = code >= 0
    order = np.argsort(s[has], kind="stable")
    s, code, p = s[has][order], code[has][order], p[has][order]
    of = {x: slice(*np.searchsorted(s, [x, x + 1])) for x in zero}
    seen = {x: np.unique(p[of[x]], return_counts=True) for x in zero}
    place, out = np.full(len(term) + 1, -1), []
    for a in (x for x in sorted(zero) if x // size == first):
        ca, za = code[of[a]], zero[a]
        place[ca] = np.arange(len(ca))
        for b in (x for x in sorted(zero) if x // size == second and x > a):
            cb, zb = code[of[b]], zero[b]
            if not len(ca) and not len(cb):
                continue
            at = place[cb]
            both = at >= 0
            x, y, none = p[of[a]][at[both]], p[of[b]][both], _difference(za, zb)
            value = int((_difference(seen[a][0], zb) * seen[a][1]).sum() + (_difference(za, seen[b][0]) * seen[b][1]).sum())
            value += int((_difference(x, y) - _difference(x, zb) - _difference(za, y)).sum()) - none * (len(ca) + len(cb) - len(x))
            out.append((a, b, value))
        place[ca] = -1
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    lang = rows["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language, both ways."""
    cores, blocks = kept.sparkSession.sparkContext.defaultParallelism, F.ceil(F.max("s").over(Window.partitionBy("lang")) / SOURCES + F.lit(1e-9))
    known = groups.withColumn("blocks", blocks.cast("long"))
    shares = max(2 * cores, -(-kept.count() // SHARE))
    each = kept.join(small(known), ["lang", "source"]).select("lang", "term", "s", F.expr(_p("c")).alias("p"), "p0", "blocks", F.pmod(F.xxhash64("term"), F.lit(shares)).cast("int").alias("share"))
    # One row without a term tells each cell of each of its sources.
    told = known.where("v > 0").select("lang", F.lit(None).cast("string").alias("term"), "s", F.lit(None).cast("long").alias("p"), "p0", "blocks", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    mine, other = F.expr(f"s div {SOURCES}"), F.col("other")
    cells = each.unionByName(told).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1)).alias("other"))
    cells = cells.select("lang", "term", "s", "p", "p0", F.least(mine, other).alias("first"), F.greatest(mine, other).alias("second"), "share")
    cells = cells.withColumn("cell", F.concat_ws(",", "first", "second", "share", "lang"))
    sums = C.arrow_groups(cells, "cell", _sums, SUMS, SOURCES).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    x, y = (groups.select("lang", F.col("source").alias(f"source_{k}"), F.col("s").alias(k), F.col("p0").alias(f"p_{k}"), F.col("v").alias(f"v_{k}")) for k in "ab")
    pairs = x.join(y, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.expr(f"CASE WHEN v_a = 0 THEN 0 ELSE coalesce(value, 0) + v_a * ({_f('p_a', 'p_b')}) END").cast("long")
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return pairs.select("lang", value.alias("value"), F.explode(both).alias("e")).select("lang", "e.source", "e.item", "value")


def audit(docs: DataFrame, min_docs: int = 10, k: int = 10) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept, groups = kept_terms(group_counts(docs), min_docs)
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = source_pairs(kept, groups).withColumn("rank", F.row_number().over(w))
    terms = top_terms(kept, groups, k).withColumnRenamed("term", "item")
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


#: DuckDB SQL for op13: every group against every kept term.
SQL13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, sum(lc) AS n, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        CAST(1 + (CAST(coalesce(c.c, 0) + 2 AS HUGEINT) * 1000000000) // CAST(coalesce(gn.n, 0) + 2 * l.v AS HUGEINT) AS HUGEINT) AS p,
        CAST(1 + (CAST(k.lc + 2 AS HUGEINT) * 1000000000) // CAST(l.n + 2 * l.v AS HUGEINT) AS HUGEINT) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM x WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""
