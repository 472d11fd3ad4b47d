"""The training-data operators on small cases with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns, against brute force, exact round trips or the libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from varipair.llm import chat, common, decontaminate, edits, jaccard, katz, pieces, quality, suffixes, tokenstore, warc

public = pytest.importorskip("public_tokenizers")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def corpus(seed=1):
    """(doc_id, text, n): copies, near copies, nulls, empty and short texts, repeated rows and ids, a long text."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 7))).replace(" ", "") or "w" for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, base), (7, base.upper() if base.isascii() else base), (8, base), (8, base), (None, base), (9, passage), (10, "x" * 450), (11, prose(4000))]
    for i in range(12, 40):
        w = base.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(50)
        rows.append((i, " ".join(w) if i % 3 else prose(80) + "\n" + passage + "\n" + prose(30)))
    return [(i, t, 7) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, n long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n long")


def texts():
    return [(i, (t or "")) for i, t, _ in corpus()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_quality(docs, empty):
    got = quality.apply_policy(quality.ledger(docs)).collect()
    want = []
    for i, t in texts():
        w = t.encode().split()
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)))
    same([tuple(r)[:6] for r in got], want)
    assert quality.ledger(empty).count() == 0
    ablation = {r["rule"]: r for r in quality.ablations(quality.ledger(docs)).collect()}
    assert ablation["few_words"]["n_failed"] == sum(len(t.split()) < 50 for _, t in texts())
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(public.path("byte_bpe_50k.json")), common.fresh_path(spark, "store")
    tokenstore.write_store(docs, path, public.path("byte_bpe_50k.json"), 2)
    ids = [(i, tok.encode(t, add_special_tokens=False).ids + [2]) for i, t in texts()]
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.verify(spark, path).collect()], [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids])
    rows = sorted(tokenstore.read_ids(spark, path).collect(), key=lambda r: r["start"])
    same([(r["doc_id"], r["ids"]) for r in rows], ids)
    assert [r["start"] for r in rows] == np.cumsum([0] + [len(r["ids"]) for r in rows])[:-1].tolist()
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in ids), key=lambda i: -1 if i is None else i)
    chunks = tokenstore._read(spark, path).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    none = common.fresh_path(spark, "store")
    tokenstore.write_store(empty, none, public.path("byte_bpe_50k.json"), 2)
    assert tokenstore.verify(spark, none).count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x := sp.encode(t) + [2]), sha(" ".join(map(str, x))), sha(sp.decode(x))) for i, t in texts()]
    same(map(tuple, pieces.digests(docs, path, 2).collect()), want)
    back = pieces.decode_documents(pieces.encode_documents(docs, path, 2), path)
    same([(r["doc_id"], r["text"]) for r in back.collect()], texts())
    assert pieces.digests(empty, path, 2).count() == 0
    table, rnd = pieces.load(path), random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "ing", "é", "▁", "中", "<s>", "\0", "😀", ",", "..", "1", "ou"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        ids = sp.encode(s)
        assert table.encode(s).tolist() == ids and table.decode(ids) == sp.decode(ids) == table.decoded(table.encode(s)).decode()


def test_edits(spark, docs, empty):
    from tokenizers import Tokenizer

    path, rnd = public.path("byte_bpe_50k.json"), random.Random(2)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    log = [(rnd.randint(1, 45), k, rnd.randint(-5, 900), rnd.randint(0, 200), rnd.choice(["", " new words", "x", "\n\n", "<|endoftext|>", " "])) for k in range(300)] + [(None, 1, 1, 1, "z"), (6, 7, None, None, None)]
    got = edits.apply_edits(edits.count_tokens(docs, path), spark.createDataFrame(log, "doc_id long, seq long, start long, length long, text string"), path).collect()
    want = []
    for i, t in texts():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        for _, start, length, new in sorted((k, s or 0, c or 0, x or "") for d, k, s, c, x in log if d is not None and d == i):
            start = max(0, min(start, len(t)))
            t = t[:start] + new + t[start + max(0, length) :]
        want.append((i, n, len(tok.encode(t, add_special_tokens=False).ids), t))
    same([(r["doc_id"], r["n_tokens"], r["n_tokens_after"], r["text_after"]) for r in got], want)
    assert edits.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(docs, empty, order):
    got = katz.score_documents(docs, order).collect()
    tok = [(i, t.encode().translate(LOWER).split() + [None]) for i, t in texts()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    # Histories: the start of a text is 0 and stands once before it.
    grams = lambda w: [[(tuple(([0] + w)[max(0, k + 2 - n) : k + 1]) if n > 1 else (), x) for k, x in enumerate(w)] for n in range(1, order + 1)]
    count = [Counter() for _ in range(order)]
    for i, w in tok:
        if not held(i):
            for k, (c, own) in enumerate(zip(count, grams(w), strict=True)):
                c.update(g for g in own if len(g[0]) == k)
    ds = [katz.discounts([Counter(c.values())[r] for r in range(1, 7)]) for c in count]
    after = [defaultdict(dict) for _ in range(order)]
    for c, a in zip(count, after, strict=True):
        for (h, w), n in c.items():
            a[h][w] = n
    left = lambda k, c: ds[k][c - 1] * c if c <= 5 else c
    size = lambda a: sum(a.values()) + (not any(c <= 5 for c in a.values()))
    unknown = 1 - sum(left(0, c) for c in after[0][()].values()) / size(after[0][()])

    def p(h, w):
        a = after[len(h)].get(h)
        if a and w in a:
            return left(len(h), a[w]) / size(a)
        if not h:
            return unknown
        return (alpha(h) if a else 1) * p(h[1:], w)

    def alpha(h):
        a = after[len(h)][h]
        return (1 - sum(left(len(h), c) for c in a.values()) / size(a)) / (1 - sum(p(h[1:], x) for x in a))

    for a in after[1:]:
        for h in list(a)[:20]:  # exactly normalised: all known words, and one that was never seen
            assert abs(sum(p(h, w) for w in after[0][()]) + p(h, "never") - 1) < 1e-9
    want, total = {}, sum(count[0].values())
    for i, w in tok:
        base = sum(math.log10((count[0][(), x] + 0.5) / (total + 0.5 * (len(count[0]) + 1))) for x in w)
        want.setdefault(i, []).append((held(i), len(w), sum(count[0][(), x] > 0 for x in w), total, base, sum(math.log10(p(h, x)) for h, x in grams(w)[-1])))
    assert len(got) == len(tok)
    for r in got:
        assert any(tuple(r)[1:5] == x[:4] and abs(r["base_score"] - x[4]) < 1e-6 and abs(r["score"] - x[5]) < 1e-6 for x in want[r["doc_id"]])
    assert katz.score_documents(empty, order).count() == 0


def test_suffix_order():
    rnd = random.Random(3)
    for _ in range(200):
        s = np.array([rnd.randint(1, rnd.choice([1, 2, 3, 200])) for _ in range(rnd.randint(0, 90))], np.int64)
        assert suffixes.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_dedup(docs, empty):
    got = suffixes.repeated_bytes(docs).collect()
    data = [(i, t.encode()) for i, t in texts()]
    starts = Counter(t[k : k + 200] for _, t in data for k in range(len(t) - 199))
    want = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if starts[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        want.append((i, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    same(map(tuple, got), want)
    out = suffixes.dedupe(docs)
    assert out.columns == docs.columns and suffixes.dedupe(empty).count() == 0
    assert {r["doc_id"] for r in out.collect()} >= {1, 2, 3, 4, 5, 11}


def components(rows):
    sets = []
    for i, t in rows:
        w = t.encode().translate(LOWER).split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def test_jaccard(docs, empty):
    same(map(tuple, jaccard.link_components(docs).collect()), components(texts()))
    assert jaccard.link_components(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {2, 3, 4, 6} <= {r["doc_id"] for r in kept.collect()}


def test_clashing_columns(spark, docs):
    names = ["_d", "_t", "_k", "_l", "_n", "_c", "_key", "_doc", "_lesser", "_times", "_kept", "_N_bytes", "_n_removed", "_m_n_words", "_leak_doc", "block", "data", "kind", "bucket", "node", "root", "token"]
    wide = docs.select("*", *[F.lit(i).alias(x) for i, x in enumerate(names)])
    items = spark.createDataFrame([(None, "one two three four five six"), (1, "x y")], "item_id long, text string")
    for out in (quality.filter_documents(wide), jaccard.keep_one(wide), suffixes.dedupe(wide), decontaminate.drop_leaks(wide, items)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all([r[x] for x in names] == list(range(len(names))) for r in rows)


def test_items_of_one_id_or_none(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "other words that leak nothing at all here"), (None, text + " more")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (7, text[:40]), (7, "other words that leak nothing at all"), (7, text[:40])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item_shingles"]) for r in decontaminate.find_leaks(docs, items).collect()}
    n = max(1, len(text[:40].split()) - 4)
    assert (1, None, 26) in got and (None, None, 26) in got and (2, 7, 3) in got and {x for x in got if x[0] == 2} == {(2, 7, 3)}
    assert {x[2] for x in got if x[0] == 1 and x[1] == 7} <= {n}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()} == set()


def test_runs_of_long_and_periodic_texts():
    """Texts beyond a piece are hashed in overlapping parts; each window must be in exactly one run."""
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3 * suffixes.PIECE_BYTES + 77)).encode()
    parts = [b"x" * 700, b"short", long, b"abc" * 300, long[1000:1400]]
    runs, windows, at = suffixes.Runs(parts), [], 0
    for p in parts:
        windows += range(at, at + max(0, len(p) - suffixes.WIDTH + 1))
        at += len(p)
    assert sorted(k for a, b in zip(runs.first, runs.last, strict=True) for k in range(a, b + 1)) == windows
    data = b"".join(parts)
    named = defaultdict(set)
    for a, b, name in zip(runs.first.tolist(), runs.last.tolist(), runs.name.tolist(), strict=True):
        inside = [data[k : k + suffixes.WIDTH] for k in range(a, b + 1)]
        assert len(set(inside)) == len(inside)
        for x in inside:
            named[x].add(name)
    assert all(len(v) == 1 for v in named.values())


def test_suffix_order_to_a_depth():
    rnd = random.Random(4)
    for _ in range(100):
        s, depth = [rnd.randint(1, rnd.choice([1, 2, 4])) for _ in range(rnd.randint(0, 120))], rnd.choice([2, 7, 30])
        order = suffixes.suffix_order(np.array(s, np.int64), depth).tolist()
        heads = [s[i : i + depth] for i in order]
        assert sorted(order) == list(range(len(s))) and heads == sorted(heads)


def test_byte_bpe_columns():
    import pyarrow as pa

    from varipair.llm import bytebpe

    rnd = random.Random(6)
    signs = [" ", " ", " ", "\n", "\t", "a", "b", "Foo", "don't", "'s", "é", "日本", "...", "!", "#$", "1", "23", "\1", "\0", "\u2003", "<|endoftext|>", "\x1c", "²", "🙂"]
    rows = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12))) for _ in range(5000)] + ["", None, " ", "\n"]
    bpe = bytebpe.load(public.path("byte_bpe_50k.json"))
    want = [e.ids for e in bpe.tokenizer.encode_batch([t or "" for t in rows], add_special_tokens=False)]
    for _ in range(2):
        ids, ends = bpe.encode_column(pa.array(rows))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_keep_one_decides_by_row(spark, docs):
    rnd = random.Random(4)
    prose = lambda: " ".join("w%d" % rnd.randrange(10**6) for _ in range(40))
    a, b, c, d, e, f, g = (prose() for _ in range(7))
    rows = [(1, a), (None, a), (None, b), (2, c), (3, c), (3, d), (None, e), (None, e), (4, f), (4, f), (4, f + " end"), (5, f), (None, None), (None, None), (6, ""), (6, ""), (7, g), (7, g + " end")]
    kept = jaccard.keep_one(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    four, seven = ([t for i, t in got if i == k] for k in (4, 7))
    assert len(four) == 1 and four[0] in (f, f + " end") and len(seven) == 1 and seven[0] in (g, g + " end")
    same([r for r in got if r[0] not in (4, 7)], [(1, a), (None, b), (2, c), (3, d), (None, e), (None, None), (None, None), (6, ""), (6, "")])
    group = {k: c for k, (_, _, c) in enumerate(components([(k, t) for k, (_, t) in enumerate(texts())]))}
    words = {k for k, (_, t) in enumerate(texts()) if t.split()}
    least = {}
    for k in words:
        least[group[k]] = min(least.get(group[k], (True, 0)), (texts()[k][0] is None, texts()[k][0] or 0))
    want = [None if no else i for no, i in least.values()] + [i for k, (i, _) in enumerate(texts()) if k not in words]
    same([r["doc_id"] for r in jaccard.keep_one(docs).collect()], want)


def test_jaccard_near_copies_at_the_threshold(spark):
    rnd, rows = random.Random(9), []
    base = ["w%d" % rnd.randrange(10**6) for _ in range(60)]
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = "e%d" % rnd.randrange(10**6)
        rows.append((i, " ".join(w)))
    same(map(tuple, jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), components(rows))


def test_warc(spark):
    html = "<p>" + "same words " * 20 + "</p>"
    rows = [(1, "http://a/1", html), (2, "http://a/2", html), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 70000 + "\x1f\x8b\x08"), (2, "http://a/2", html), (None, "u", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    files = warc.write_archive(pages, common.fresh_path(spark, "warc"))
    want = [("response" if i == 1 or len((h or "").encode()) < 100 or i == 7 else "revisit", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows]
    for split in (37, 1000, 1 << 20):
        got = warc.read_archive(files, split).collect()
        same([(r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in got], want)
        same([bytes(r["payload"]) for r in got if r["record_type"] == "response"], [(h or "").encode() for (_, _, h), w in zip(rows, want, strict=True) if w[0] == "response"])
    import gzip

    first = files.orderBy("file").first()["file"].removeprefix("file://")
    assert gzip.open(first).read().startswith(b"WARC/1.1")
    none = warc.write_archive(pages.limit(0), common.fresh_path(spark, "warc"))
    assert warc.read_archive(none).count() == 0


def test_chat(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [("user", None)], 7: [b]}
    rows = [(i, k, r, t, 0) for i, turns in logs.items() for k, (r, t) in enumerate(turns)] + [(3, 0, "user", "hi", 0), (None, 0, "user", "hi", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert sorted(got) == [3, 5, 6, 7] and got[3]["n_copies"] == 2 and got[3]["n_turns"] == 3
    assert got[5]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_decontaminate(spark, docs, empty):
    passage = next(t for i, t, _ in corpus() if i == 9)
    w = passage.split()
    items = spark.createDataFrame([(1, passage), (2, " ".join(w[:20])), (3, None), (4, ""), (5, "ONE"), (6, " ".join(w[:10] + ["q"] * 40)), (2, " ".join(w[:20]))], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items)
    cut = lambda t: {tuple(x[k : k + 5]) for x in [t.encode().translate(LOWER).split()] if x for k in range(max(1, len(x) - 4))}
    want = {(i, j) for i, t in texts() for j, q in ((1, passage), (2, " ".join(w[:20])), (5, "ONE"), (6, " ".join(w[:10] + ["q"] * 40))) if 4 * len(cut(t) & cut(q)) >= 3 * len(cut(q))}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    kept = decontaminate.drop_leaks(docs, items)
    bad = {i for i, _ in want}
    assert kept.columns == docs.columns and kept.count() == sum(i not in bad for i, _ in texts())
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, d), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0


def test_policy_ablations_agree_with_sql(spark):
    import duckdb

    from varipair.llm import quality

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(f"SELECT rule, n_failed, n_only, ever FROM ({quality.SQL_ABLATIONS})").fetchall()
    got = [tuple(r) for r in quality.policy_ablations(spark, d).select("rule", "n_failed", "n_only", "ever").collect()]
    assert sorted(got) == sorted(want)
