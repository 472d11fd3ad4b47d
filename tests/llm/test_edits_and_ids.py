"""Edits in several batches over a written state, and the whole queries of operators 1 and 10 against the library."""

import random
import zlib

import numpy as np
import pytest

from varipair.llm import common, edits, tokenstore

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def applied(text, log):
    for _, start, length, new in sorted(log):
        start = max(0, min(start, len(text)))
        text = text[:start] + new + text[max(start, min(start + max(0, length), len(text))) :]
    return text


def test_two_batches_over_a_written_state(spark, tokenizer):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghié ") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    texts = {i: " ".join(rnd.choice(words) for _ in range(6000 if i < 3 else 40)) for i in range(12)} | {50: "", 51: None}
    path = public.path("byte_bpe_50k.json")
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    state = common.written(edits.count_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path), "edit-state")
    now = {i: t or "" for i, t in texts.items()}
    for batch in range(3):
        log = [(i, k, rnd.randint(-3, len(t) + 3), rnd.randint(0, 9), rnd.choice(words)) for i, t in now.items() for k in range(rnd.randint(0, 4))]
        done = common.written(edits.apply_edits(state, spark.createDataFrame(log, "doc_id long, seq long, start long, length long, text string"), path), f"edited-{batch}")
        before, now = now, {i: applied(t, [e[1:] for e in log if e[0] == i]) for i, t in now.items()}
        got = {r["doc_id"]: r for r in done.collect()}
        for i in now:
            assert (got[i]["text_after"], got[i]["n_tokens"], got[i]["n_tokens_after"]) == (now[i], count(before[i]), count(now[i])), (batch, i)
        # Of the long texts little is encoded again, in later batches too: their trees come from the state.
        assert all(got[i]["n_chars_encoded"] < 0.2 * len(now[i]) for i in range(3))
        state = edits.state_after(done)


def test_op1_over_its_table(spark, tokenizer):
    docs = common.table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    log = {}
    for r in edits.edit_log(docs).collect():
        log.setdefault(r["doc_id"], []).append((r["seq"], r["start"], r["length"], r["text"]))
    got = edits.op1(spark, SF).collect()
    assert len(got) == len(text) and "text_after" not in got[0].asDict()
    for r in got:
        after = applied(text[r["doc_id"]], log[r["doc_id"]])
        want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (text[r["doc_id"]], after)]
        assert [r["n_tokens"], r["n_tokens_after"], r["n_chars_after"], r["n_edits"]] == [*want, len(after), 3]


def test_op10_over_its_table(spark, tokenizer):
    text = {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents").collect()}
    start, want = 0, []
    for i in sorted(text):
        ids = tokenizer.encode(text[i], add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.op10(spark, SF).collect())
    assert got == want
