"""What must hold at sizes that the tests cannot have: numbers of buckets, hot names, independent discounts, long texts and
several blocks in one task."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varipair.llm import common, decontaminate, jaccard, katz, suffixes


def test_buckets_for_a_hundred_terabytes(spark):
    n = common.parts_of(spark, 100 << 40, suffixes.BUCKET_BYTES)
    df = spark.range(500).select((F.col("id") % 50 + (1 << 32)).alias("block"), F.lit(b"x").alias("data"))
    table = common.bucketed(df.coalesce(1), "many", "block", n)
    assert n > 100_000 and table.count() == 500
    plan = table.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not [t.name for t in spark.catalog.listTables() if t.name.startswith("many")]


def test_stretches():
    x = np.array([2, 2, 5, 7, 7, 7])
    assert common.stretches(x) == [(2, 0, 2), (5, 2, 3), (7, 3, 6)] and common.stretches(x[:0]) == []


def hot_rows(n, seed=1):
    """Texts of random words around one 150-byte line, half of them with one 260-byte passage too."""
    rnd = random.Random(seed)
    prose = lambda k: "".join(rnd.choice("abcdefghij ") for _ in range(k))
    line, passage = prose(150), prose(260)
    return [(i, prose(rnd.randint(150, 300)) + line + prose(rnd.randint(0, 300)) + (passage + prose(220) if i % 2 else "")) for i in range(n)]


def repeated(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(t[k : k + 200] for _, t in data for k in range(len(t) - 199))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if starts[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        out.append((i, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("in_block, in_bucket", [(64, 2_000), (2, 2_000), (1_000, 3), (1, 1)])
def test_hot_names_are_decided_as_others(spark, monkeypatch, in_block, in_bucket):
    monkeypatch.setattr(suffixes, "HOT_IN_BLOCK", in_block)
    monkeypatch.setattr(suffixes, "HOT_IN_BUCKET", in_bucket)
    rows = hot_rows(160) + [(1000, hot_rows(3)[1][1]), (1001, "z" * 900), (1002, None)]
    got = suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = repeated(rows)
    assert sum(r[2] for r in want) > 10_000 and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_a_hot_name_is_one_entry_of_its_block():
    texts = [t.encode() for _, t in hot_rows(2_000, 5)]
    runs = suffixes.Runs(texts)
    e = suffixes.Entries(runs, suffixes.HOT_IN_BLOCK)
    assert Counter(runs.name.tolist()).most_common(1)[0][1] > 1_500
    assert max(Counter(e.names.tolist()).values()) <= suffixes.HOT_IN_BLOCK and (e.times == 3).sum() >= 1
    # Bytes that one bucket has to sort: with hot names, and if there were none.
    first = suffixes._distinct(runs)[1]
    assert len(e.names) < len(first)


def test_no_bucket_gets_a_hot_name_to_sort(spark):
    rows = spark.createDataFrame(hot_rows(3_000, 7), "doc_id long, text string").repartition(4)
    n, text = 64, "text"
    blocks = common.bucketed(common.arrow_map(rows, suffixes._pack, "block long, data binary", text), "hot-blocks", "block", 4)
    ask = common.arrow_map(blocks, suffixes._ask, suffixes._ROW_DDL, n, text, suffixes.HOT_IN_BLOCK)
    verdicts = common.arrow_groups(ask, "bucket", suffixes._judge, suffixes._ROW_DDL, suffixes.HOT_IN_BUCKET)
    shipped = common.written(common.arrow_pairs(blocks, verdicts, "block", suffixes._ship, suffixes._ROW_DDL, n, text, suffixes.HOT_IN_BLOCK), "hot-shipped")
    by = {r["bucket"]: r["b"] for r in shipped.where("kind <> 'spans'").groupBy("bucket").agg(F.sum(F.length("data")).alias("b")).collect()}
    assert len(by) == n and max(by.values()) < 3 * sum(by.values()) / n


def good_turing(counts, cutoff=5):
    """Katz's discounts, written out: r* / r with r* = (r + 1) n[r + 1] / n[r], rescaled so that counts above the cutoff stay."""
    n = Counter(counts)
    common_part = (cutoff + 1) * n[cutoff + 1] / n[1]
    return [((r + 1) * n[r + 1] / (r * n[r]) - common_part) / (1 - common_part) for r in range(1, cutoff + 1)]


def test_discounts_by_the_formula():
    rnd = random.Random(11)
    counts = [min(int(rnd.paretovariate(1.1)), 60) for _ in range(20_000)]
    n = Counter(counts)
    want = good_turing(counts)
    assert all(0 < d < 1 for d in want)
    assert np.allclose(katz.discounts([n[r] for r in range(1, 7)]), want)
    # What is taken from seen n-grams is what Good and Turing leave to unseen ones: n[1].
    assert abs(sum(r * n[r] * (1 - d) for r, d in enumerate(want, 1)) - n[1]) < 1e-6 * n[1]


def test_long_texts_and_several_blocks_of_one_task(spark):
    import pyarrow as pa

    rnd = random.Random(2)
    words = ["w%d" % k for k in range(400)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40_000 if i < 2 else 30))) for i in range(12)]
    got = sorted(tuple(r) for r in katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert [r[2] for r in got] == [len(t.split()) + 1 for _, t in rows]
    # A task packs rows into blocks by their bytes; a long text is a block of its own.
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    assert [b.num_rows for b in common.steps(iter([batch]), most=50_000)] == [1, 1, 10]


def test_size_classes_cut_what_no_sketch_can_meet(spark):
    rnd = random.Random(4)
    prose = lambda k: " ".join("w%d" % rnd.randrange(5000) for _ in range(k))
    items = spark.createDataFrame([(i, prose(k)) for i, k in enumerate([40, 60, 90, 120, 200, 210] * 5)], "item_id long, text string")
    sketch = decontaminate.sketches(decontaminate._items(items))
    classes = decontaminate.size_classes(sketch)
    assert 2 <= len(classes) <= 4 and all(a[0] < b[0] for a, b in zip(classes, classes[1:], strict=False))
    docs = spark.createDataFrame([(0, prose(3000)), (1, prose(20)), (2, None)], "doc_id long, text string")
    kept = {r["doc_id"]: (r["n"], r["k"]) for r in docs.select("doc_id", decontaminate.hashes(F.col("text")).alias("hs")).select("doc_id", F.size("hs").alias("n"), F.size(decontaminate.sketched(F.col("hs"), classes)).alias("k")).collect()}
    assert kept[0][1] < 0.75 * kept[0][0] and kept[1] == (16, 0) and kept[2] == (0, 0)
    assert decontaminate.sketched(F.col("x"), []) is not None


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_katz_tables_score_other_texts(spark, order):
    rnd = random.Random(order)
    words = ["v%d" % min(int(rnd.paretovariate(0.7)), 150) for _ in range(4000)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(120)] + [(500, None), (501, "never seen words"), (502, "v1 v1 v1 v2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: r for r in katz.score_documents(docs, order).collect()}
    train = [r for r in rows if not katz.held_out(r[0])]
    model = katz.learn(spark.createDataFrame(train, "doc_id long, text string"), order)
    got = {r["doc_id"]: r for r in katz.score_with(model, docs).collect()}
    assert set(got) == set(want) and len(model.tables) == order
    for i, r in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (r["n_tokens"], r["n_known"], r["train_tokens"])
        assert abs(got[i]["score"] - r["score"]) < 1e-9 and abs(got[i]["base_score"] - r["base_score"]) < 1e-9
    assert katz.score_with(model, docs.limit(0)).count() == 0


def near_copies(n, seed=7):
    """Copies of one text of 120 words with 0 to 5 words replaced by new ones; of e and f new words apart, two link up to e + f = 3."""
    rnd = random.Random(seed)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(n):
        words = list(base)
        for at in rnd.sample(range(4, 116), 0 if i == n // 2 else rnd.choice([1, 2, 2, 3, 3, 3, 4, 5])):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_copies_meet_the_least_edited_one(spark, monkeypatch):
    rows, met = near_copies(300), []
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    counted = jaccard._counted
    monkeypatch.setattr(jaccard, "_counted", lambda pairs: (met.append(pairs.count()), counted(pairs))[1])
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in sets}
    # The last join has what no hub has joined, and few of those can be a link.
    assert met[0] < 1_000
