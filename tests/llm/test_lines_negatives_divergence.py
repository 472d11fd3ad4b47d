"""Line dedup, hard negatives and the divergence audit against brute force, with nulls, ties, repeated and extra rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from varipair.llm import divergence, lines, negatives

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_rows():
    rnd = random.Random(3)
    pool = ["License: all rights", "  license: ALL rights\t", "ÄÖ line", "äÖ line", "x", "", "   ", "\r"] + [f"line {i}" for i in range(40)]
    rows = [(1, None), (2, ""), (3, "\n"), (3, "\n"), (None, "x\nx\nx"), (None, "x\nx\nx"), (None, "y"), (4, "\n".join(["x", "own"] * 6000)), (5, "x" * 70_000)]
    return rows + [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9)))) for i in range(10, 90)]


def wanted_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, ls in cut for k in {key(x) for x in ls} if k)
    out = []
    for i, ls in cut:
        kept = [x for x in ls if seen[key(x)] < least or not key(x)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark, monkeypatch):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, batch int, h int").repartition(3)
    for limit in (1_000_000, 0):  # common keys broadcast, and salted
        monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
        got = sorted((tuple(r) for r in lines.kept_lines(docs, 10).collect()), key=repr)
        assert got == wanted_lines(rows, 10)
    assert lines.kept_lines(docs.limit(0)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_runs_level_and_leave_out_what_is_common(spark):
    batches = [[(i, f"hot\nonly {i}\nwarm {i % 4}") for i in range(b * 4, b * 4 + 4)] for b in range(5)]
    store, sizes = lines.LineRuns(spark, min_docs=3, fanout=2, buckets=4), []
    for b in batches:
        store.add(lines.keyed(spark.createDataFrame(b, "doc_id long, text string")))
        sizes.append([len(level) for level in store.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    # hot is common after the first batch and in no later run; 20 own keys and 4 warm ones, which met the last batch as common.
    assert spark.table(store.levels[0][0]).count() == 4
    assert store.common().count() == 5
    merge = store._merged(store.runs())._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in merge and "Exchange" not in merge
    store.close()


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 12).astype("float32").tolist(), int(rng.integers(0, 10))) for i in range(640)]
    rows += [(100, rows[7][1], 3), (100, rows[7][1], 3), (None, rows[8][1], 1), (700, None, 1), (701, rows[1][1], None), (702, [float("nan")] * 12, 2), (703, [None] + [0.1] * 11, 2), (704, [float("inf")] + [0.1] * 11, 2)]
    rows += [(800, [], 4), (801, [0.5] * 3, 4), (900, [-0.5] * 12, 5), (902, [1e30] * 12, 5)] + [(1000 + i, rows[0][1], i % 3) for i in range(30)]
    return rows


def wanted_negatives(rows):
    live = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) or abs(x) >= 1 << 19 for x in v):
            continue
        live.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for at, (i, label, v) in enumerate(live):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), 1 << 62 if j is None else j, lab) for b, (j, lab, w) in enumerate(live) if b != at]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            far = sorted(x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(i, j, r, None if n == 1 << 62 else n, -s, -z) for r, (z, n, _) in enumerate(far, 1)]
    return sorted(out, key=repr)


def test_hard_negatives(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, y, 0) for i, v, y in rows], "vec_id long, embedding array<float>, label int, score int")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    want = wanted_negatives(rows)
    for share, anchors in ((16_384, 4_096), (50, 3)):  # one share, and many shares of rows and of anchors
        monkeypatch.setattr(negatives, "SHARE", share)
        monkeypatch.setattr(negatives, "ANCHORS", anchors)
        v = negatives.vectors(df, moved)
        got = negatives.hard_negatives(v, v.where("vec_id % 100 = 0")).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    none = negatives.vectors(df.limit(0))
    assert negatives.hard_negatives(none, none).count() == 0


def test_search_drops_early_and_loses_nothing():
    rng = np.random.default_rng(2)
    v, a = rng.integers(-200, 200, (900, 16)), rng.integers(-200, 200, (70, 16))
    exact = a @ v.T
    asked = [[(int(np.sort(s)[-300]), int(np.sort(s)[-200])), (-5000, 5000)] for s in exact]
    for (here, scores), s, windows in zip(negatives.search(a, np.arange(70) - 100, asked, negatives.planes_of(v), np.arange(900), 5), exact, asked, strict=True):
        assert (s[here] == scores).all() and len(here) < 100
        for low, high in windows:
            assert sorted(scores[(scores >= low) & (scores <= high)])[-5:] == sorted(s[(s >= low) & (s <= high)])[-5:]


def source_rows():
    rnd = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "日本", "don't", "x1y", "É"]
    rows = [(1, None, None, None), (2, "", "en", "void"), (3, "rare words here", "la", "one"), (4, "123 !!", "la", "two"), (5, None, "en", None)]
    for i in range(10, 160):
        source = rnd.choice(["s1", "s2", "s3", "é4"])
        pick = words[: 40 if source == "s1" else 65]
        rows.append((i, " ".join(rnd.choice(pick).upper() if rnd.random() < 0.2 else rnd.choice(pick) for _ in range(rnd.randint(3, 60))), rnd.choice(["en", "de"]), source))
    return rows


def wanted_divergence(rows, k=10):
    docs = [(g or "", s or "", [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, g, s in rows]
    df, tf, by = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for g, s, w in docs:
        df[g].update(set(w))
        tf[g].update(w)
        by[g, s].update(w)
    p = lambda counts, terms: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[x] for x in terms) + 2 * len(terms)) for t in terms}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for g, s in by:
        terms = [t for t in df[g] if df[g][t] >= 10]
        own, lang = p(by[g, s], terms), p(tf[g], terms)
        pairs = [(-sum(f(own[t], q[t]) for t in terms), o.encode()) for h, o in by if h == g and o != s for q in [p(by[g, o], terms)]]
        best = [(-f(own[t], lang[t]), t.encode()) for t in terms if by[g, s][t] and own[t] > lang[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:k])):
            out += [(g, s, part, x.decode(), -v, r) for r, (v, x) in enumerate(found, 1)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    rows = source_rows()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, term int").repartition(5)
    for blocks, limit, memo in ((128, 500_000, 400_000), (2, 0, 50)):  # one block of sources; many, nothing broadcast, memos emptied often
        monkeypatch.setattr(divergence, "SOURCES", blocks)
        monkeypatch.setattr(divergence, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(divergence.C, "MEMO", memo)
        assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == wanted_divergence(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_probability_of_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 1000)], "c long, n long, v long")
    assert df.select(F.expr(divergence._p("c"))).first()[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2000)
