"""Hard-negative mining by bit-sliced integer products.

Components are integers, floor(256 x). A row c is a sum of bit-planes, c = -2**(B-1) b[B-1] + sum of 2**i b[i], so its
product with an anchor a is the same sum over a . b[i]. Planes are taken most significant first. While p planes are left,
they add between (2**p - 1) times the sum of a's negative components and (2**p - 1) times that of its positive ones: the
score lies in an interval, halved by each plane. A row is dropped for an anchor as soon as its interval cannot qualify: its
upper end is below the k-th best lower end, or it misses every window that is asked for. What is left at plane 0 is exact.

Spark lays out the products: rows in shares of about SHARE, anchors in shares of about ANCHORS, one group for each pair of
shares (the anchors are a stated query set, 1 % of the rows). A group returns at most k rows for an anchor and window;
these are ranked by a window over the anchor. Two passes: over rows of the anchor's label for its positives, over the
others for each positive's negatives.

Cases: rows with a null label or vector, a null or non-finite component, or one of 2**19 and more (whose product might not
fit 64 bits) take no part; an empty vector scores 0 with all; vectors of other lengths count as if filled with zeros; each
row is a row, so repeated ones rank side by side, and a repeated anchor has its rows twice; a null vec_id is no anchor and
comes last in ties; no anchors or no rows give no rows; extra columns are ignored. Memory of a task: one share of rows, their
planes and SLICE anchors' intervals with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Rows and anchors of a group, and anchors whose intervals are held at once.
SHARE, ANCHORS, SLICE = 16_384, 4_096, 64
#: Intervals are held as a matrix until this share of a slice's pairs is left.
SPARSE = 0.2
FOUND = "anchor long, anchor_id long, window long, row long, vec_id long, score long"


def vectors(embeddings: DataFrame, relabel: Column | None = None) -> DataFrame:
    """row, vec_id, label and the integer components of the rows that take part, written, so that `row` stays."""
    x = F.col("embedding")
    fits = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float(1 << 19))
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & F.forall(x, fits))
    label = F.col("label").cast("long") if relabel is None else relabel
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda e: F.floor(e.cast("double") * 256).cast("int")).alias("v"))
    return C.written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "negatives-vectors")


def planes_of(v: np.ndarray) -> list[np.ndarray]:
    """Bit-planes of two's complement, least significant first; the last one is the sign."""
    bits = max(int(v.max()).bit_length(), int(-1 - v.min()).bit_length()) + 1 if v.size else 1
    return [((v >> i) & 1).astype(np.uint8) for i in range(bits)]


def _best(low: np.ndarray, high: np.ndarray, k: int, floor: int, ceiling: int) -> np.ndarray:
    """Which intervals may be among the k best of those inside [floor, ceiling]."""
    may = (high >= floor) & (low <= ceiling)
    sure = low[may & (low >= floor) & (high <= ceiling)]
    if len(sure) >= k:
        may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
    return may


def search(anchors: np.ndarray, own: np.ndarray, windows: list[list[tuple[int, int]]], planes: list[np.ndarray], rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor the places and scores of the rows that may be among the k best of one of its windows; with them
    all that are. own: the anchors' row numbers, rows: those of the rows; an anchor is not paired with itself."""
    out, n = [], len(planes)
    kind = np.float32 if np.abs(anchors).sum(1).max(initial=0) < 1 << 24 else np.float64
    for at in range(0, len(anchors), SLICE):
        a, left = anchors[at : at + SLICE], own[at : at + SLICE, None] != rows[None, :]
        minus, plus = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
        wide = [(min(w, default=(1, 0))[0], max((c for _, c in w), default=0)) for w in windows[at : at + SLICE]]
        floor, ceiling = (np.array(x)[:, None] for x in zip(*wide, strict=True))
        cols = np.arange(left.shape[1])
        score, p = np.zeros(left.shape, np.int64), n
        while p > 0 and left.mean() > SPARSE:
            p -= 1
            part = (a.astype(kind) @ planes[p][cols].T.astype(kind)).astype(np.int64) << p
            score += -part if p == n - 1 else part
            rest = (1 << p) - 1
            left &= (score + (rest * plus)[:, None] >= floor) & (score + (rest * minus)[:, None] <= ceiling)
            used = left.any(0)
            if used.mean() < 0.5:
                cols, left, score = cols[used], left[:, used], score[:, used]
                if not len(cols):
                    break
        for i in range(len(a)):
            here = np.flatnonzero(left[i])
            s, q = score[i, here], p
            here = cols[here]
            while True:
                rest = (1 << q) - 1
                low, high = s + rest * int(minus[i]), s + rest * int(plus[i])
                keep = np.zeros(len(s), bool)
                for w in windows[at + i]:
                    keep |= _best(low, high, k, *w)
                s, here = s[keep], here[keep]
                if not q or not len(s):
                    break
                q -= 1
                part = (planes[q][here] @ a[i]).astype(np.int64) << q
                s = s + (-part if q == n - 1 else part)
            out.append((here, s))
    return out


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _found(rows: pa.Table, anchors: pa.Table, k: int, same: bool) -> pa.Table:
    """The k best rows of a group for each anchor and window: of the anchor's label, or of the others."""
    schema = pa.schema([pa.field(x, pa.int64()) for x in ("anchor", "anchor_id", "window", "row", "vec_id", "score")])
    if not rows.num_rows or not anchors.num_rows:
        return schema.empty_table()
    width = max(max(np.asarray(t["v"].combine_chunks().value_lengths()).max() for t in (rows, anchors)), 1)
    v, a = _matrix(rows["v"], width), _matrix(anchors["v"], width)
    ids, numbers, labels = rows["vec_id"].to_pylist(), np.asarray(rows["row"]), np.asarray(rows["label"])
    order = [np.iinfo(np.int64).max if x is None else x for x in ids]
    name, own, its = anchors["anchor"].to_pylist(), anchors["anchor_id"].to_pylist(), np.asarray(anchors["label"])
    asked = [[(-(1 << 62), 1 << 62)] if w is None else [(-(-80 * s // 100), s) for s in w] for w in anchors["scores"].to_pylist()]
    got: list[tuple] = []
    for label in np.unique(its):
        rows_at = np.flatnonzero((labels == label) if same else (labels != label))
        at = np.flatnonzero(its == label)
        if not len(rows_at):
            continue
        found = search(a[at], np.asarray(name)[at], [asked[i] for i in at], planes_of(v[rows_at]), numbers[rows_at], k)
        for i, (here, scores) in zip(at, found, strict=True):
            for floor, ceiling in asked[i]:
                inside = [(-s, order[r], r) for s, r in zip(scores.tolist(), rows_at[here].tolist(), strict=True) if floor <= s <= ceiling]
                got += [(name[i], own[i], ceiling, int(numbers[r]), ids[r], -s) for s, _, r in sorted(inside)[:k]]
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], schema=schema) if got else schema.empty_table()


def _searched(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int, same: bool) -> DataFrame:
    """`_found` of each pair of shares. anchors: anchor (its row), anchor_id, label, v, scores (null: no windows)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    p, q = max(1, -(-n_anchors // ANCHORS)), max(2 * cores, -(-n_rows // SHARE))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    left = rows.withColumn("group", F.explode(F.transform(every(p), lambda i: mine("row", q) * p + i)))
    right = anchors.select(*(F.col(c).alias(c) for c in anchors.columns)).withColumn("group", F.explode(F.transform(every(q), lambda j: j * p + mine("anchor", p))))
    return C.arrow_pairs(left, right, "group", _found, FOUND, k, same)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int = 5) -> DataFrame:
    """The k best other rows of each anchor's label: anchor, anchor_id, vec_id, row, score, rank."""
    asked = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v", F.lit(None).cast("array<long>").alias("scores"))
    return C.written(_ranked(_searched(rows, asked, n_rows, n_anchors, k, True), ["anchor"], k).drop("window"), "negatives-positives")


def hard_negatives(rows: DataFrame, anchors: DataFrame, k: int = 5) -> DataFrame:
    """For each row of `anchors` (some of the rows) and each of its k positives, the k best rows of other labels that
    score from 80 to 100 % of the positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    n_rows, n_anchors = rows.count(), anchors.count()
    near = positives(rows, anchors, n_rows, n_anchors, k)
    # Windows of a negative score hold nothing; positives of one score share a window.
    scores = near.where("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("scores"))
    asked = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v").join(scores, "anchor")
    far = _ranked(_searched(rows, asked, n_rows, n_anchors, k, False), ["anchor", "window"], k)
    far = far.select("anchor", F.col("window").alias("score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    both = near.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), "score").join(far, ["anchor", "score"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10).cast("long"))).otherwise(label)
    rows = vectors(C.table(spark, sf_dir, "embeddings"), moved)
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


#: DuckDB SQL for op12, for vectors of one length.
SQL12 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, b.r, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.anchor_id, p.id AS positive_id, p.k, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id NULLS LAST) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
