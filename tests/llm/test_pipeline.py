"""The pipeline's five stages against a plain Python pipeline, row by row, and what each does with nulls and empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

public = pytest.importorskip("public_tokenizers")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = b" \t\n\r\x0b\x0c"


def corpus():
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefghijklmnoé") for _ in range(rnd.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, item, base = prose(70), prose(40), prose(140)
    rows = [(1, None), (2, ""), (3, "few words"), (4, "# " * 80), (5, "same line here\n" * 40), (6, prose(90).upper()), (7, base), (8, base), (9, base + " tail"), (8, prose(100)), (None, base), (None, prose(120))]
    for i in range(10, 30):
        w = base.split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(9)
        rows.append((i, " ".join(w)))
    rows += [(i, prose(60) + " " + passage + " " + prose(60)) for i in range(30, 36)]
    rows += [(i, prose(80) + "\n" + item + "\n" + prose(20)) for i in range(36, 39)] + [(39, prose(80) + " " + " ".join(item.split()[:33]) + " " + prose(50)), (40, prose(80) + " " + " ".join(item.split()[:25]) + " " + prose(50))]
    rows += [(41, prose(6000)), (42, passage), (43, passage)]
    rows += [(i, prose(rnd.randint(55, 200))) for i in range(50, 70)]
    return rows, [(1, item), (2, prose(12)), (3, None)]


def words_of(text):
    return (text or "").encode().split()


def kept_by_rules(rows):
    out = []
    for i, t in rows:
        data = (t or "").encode()
        w = data.split()
        n, chars = len(w), sum(len(x.decode()) for x in w)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j + k for j in range(n - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
        symbols, upper = sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), sum(65 <= c <= 90 for c in data)
        bad = n < 50 or 100 * len(again) > 50 * n or chars < 2 * n or chars > 14 * n or 10 * symbols > 3 * n or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or 2 * upper > chars
        if not bad:
            out.append((i, t))
    return out


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    # The smallest doc_id of a group stays, null ids last.
    return [rows[min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))] for g in groups.values()]


def without_repeats(rows):
    data = [(i, t, (t or "").encode()) for i, t in rows]
    starts = Counter(d[k : k + 200] for _, _, d in data for k in range(len(d) - 199))
    out = []
    for i, t, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            if starts[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        if not gone.any():
            out.append((i, t))
        elif not gone.all():
            # A character that is covered in part stays.
            kept, at = [], 0
            for ch in t:
                size = len(ch.encode())
                kept.append("" if gone[at : at + size].all() else ch)
                at += size
            out.append((i, "".join(kept)))
    return out


def without_leaks(rows, items):
    need = [shingles(q) for _, q in items if shingles(q)]
    return [(i, t) for i, t in rows if not any(4 * len(shingles(t) & q) >= 3 * len(q) for q in need)]


def digests(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    return out


def plain(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_and_the_whole(spark, folder):
    rows, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = [kept_by_rules, one_of_each, without_repeats, lambda x: without_leaks(x, items)]
    sizes = [len(rows)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:4], plan, strict=True):
        rows = brute(rows)
        docs = corpus_pipeline.common.written(stage(spark, docs, folder), f"test-{name}")
        assert plain(docs) == sorted(rows, key=str), name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(len(rows))
    assert all(a > b for a, b in zip(sizes, [*sizes[1:3], sizes[4]], strict=False)), sizes
    want = sorted(digests(rows), key=str)
    assert sorted(map(tuple, corpus_pipeline.STAGES[4][1](spark, docs, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == want


def test_the_chain_over_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
