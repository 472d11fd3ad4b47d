"""Katz backoff scores: Good-Turing discounted n-grams up to three words, learnt from and applied to one table.

Tokens are lower-cased words and an end of text. Training texts give counts c(h, w) of a word w after a history h: none,
the word before (or the start of the text), or the two before. C(h) is their sum, and c* the Good-Turing count (Katz's
form for counts up to CUTOFF, higher ones as they are):

    P(w | h) = c*(h, w) / D(h)          for an n-gram that was seen; D(h) = C(h),
               alpha(h) P(w | h')       else, if h was seen; h' is h without its first word,
               P(w | h')                if it was not.
    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over the same w): each P(. | h) sums to 1.

A word that was never seen has what the discounts of the single words leave. A history all of whose counts are above the
cutoff gives nothing away; it has D(h) = C(h) + 1, so that it can back off.

How: texts are packed into blocks, a bucketed table that every round reads where it lies. In round k a block sends each
bucket of histories its distinct n-grams of k words with its own training counts; a bucket adds them up and answers with
the totals, and with what alpha needs of a history: the sum of the lower P and how many words were seen 1 .. CUTOFF times.
The answers of all rounds are partitioned tables in the shared folder, from which each block is scored, order by order.
`learn` keeps the buckets' n-grams and counts too, as partitioned tables that score any other texts (`score_with`).
Round 1 also numbers the words, frequent ones low, so n-grams are exact from there on and take few bytes. A history that
stands in one block only (the counts of the round before say so) is finished there and not sent. A count travels once a
block, however often it occurs there, so a frequent word or pair is no hot key. Discounts come from counts of counts, added
up by Spark.

Cases: null text is empty (one end token); doc_id null trains; repeated rows count each time; an empty table gives no
rows; extra columns are ignored; without training texts all words are unknown. Memory: a block, or a bucket's part of all
blocks. Words are numbered by 64-bit hashes; two of n meet with a chance of n * n / 2**65.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: The longest n-grams, 1 to 3, and the highest count that is discounted.
ORDER, CUTOFF = 3, 5
_END, _START = np.uint64(0x9E3779B97F4A7C15), 0
_BLOCK = pa.schema([("block", pa.int64()), ("data", pa.binary())])
_ROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("data", pa.binary()), ("numbers", pa.list_(pa.int64()))])
_ROW_DDL = "kind string, bucket int, block long, level int, data binary, numbers array<long>"
_LOW32 = np.uint64(0xFFFFFFFF)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _tokens(batches, learns: bool | None):
    """Blocks: ids, nulls, held-out marks, tokens of each text, the sorted hashes of distinct tokens, and the tokens.
    learns: whether the texts are learnt from; None: those that are not held out."""
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    for part in C.steps(batches, most=BLOCK_BYTES):
        ids, sizes, hashes = part.column("doc_id").to_pylist(), [], []
        for data in C.texts_of(part.column("text")):
            words = data.translate(C.LOWER).split()
            sizes.append(len(words) + 1)
            hashes += [C.hash_words(words), np.array([_END])]
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        data = C.pack(
            np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array([held_out(i) if learns is None else not learns for i in ids], np.uint8),
            np.array(sizes, np.uint32), vocabulary, planes(tokens),
        )
        yield C.batch_of(_BLOCK, [[(task << 32) + n], [data]])
        n += 1


def planes(a: np.ndarray) -> np.ndarray:
    """Unsigned numbers by their bytes: the width, all lowest bytes, all next ones ..., which compresses well."""
    a = np.asarray(a)
    width = 4 if not len(a) or int(a.max()) < 1 << 32 else 8
    return np.r_[np.uint8(width), np.ascontiguousarray(np.ascontiguousarray(a, f"<u{width}").view(np.uint8).reshape(-1, width).T).ravel()]


def unplaned(data: np.ndarray) -> np.ndarray:
    width = int(data[0])
    return np.ascontiguousarray(data[1:].reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return C.batch_of(_ROW, list(map(list, zip(*rows, strict=True))))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)], schema=_ROW) if rows else _ROW.empty_table()


def counts_of_counts(total: np.ndarray) -> list[int]:
    """How many n-grams were seen, how often in all, and how many 1 .. CUTOFF + 1 times."""
    return [int((total > 0).sum()), int(total.sum()), *np.bincount(total[(total > 0) & (total <= CUTOFF + 1)], minlength=CUTOFF + 2)[1:].tolist()]


def discounts(n: list[int]) -> list[float]:
    """d_1 .. d_CUTOFF from the numbers of n-grams seen 1 .. CUTOFF + 1 times; half a count where these numbers
    do not give a discount between 0 and 1."""
    half = [(r - 0.5) / r for r in range(1, CUTOFF + 1)]
    if min(n) == 0:
        return half
    common = (CUTOFF + 1) * n[CUTOFF] / n[0]
    if common >= 1:
        return half
    d = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) for r in range(1, CUTOFF + 1)]
    return [x if 0 < x < 1 else h for x, h in zip(d, half, strict=True)]


class Discounted:
    """The Good-Turing counts of one order, from its counts of counts."""

    def __init__(self, numbers: list[int]):
        self.distinct, self.total = numbers[:2]
        self.table = np.array([0.0, *discounts(numbers[2:])]) * np.arange(CUTOFF + 1)
        self.given = np.arange(1, CUTOFF + 1) - self.table[1:]
        # Of the single words: what unknown words share.
        low = np.array(numbers[2 : 2 + CUTOFF])
        self.size = self.total + (not low.any())
        self.unknown = ((not low.any()) + float(low @ self.given)) / self.size

    def left(self, count: np.ndarray) -> np.ndarray:
        return np.where(count <= CUTOFF, self.table[np.minimum(count, CUTOFF)], count)

    def word(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.left(count) / self.size, self.unknown)


def _summed(by: np.ndarray, n: int, total: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per history: the sum of the lower P of the words seen after it, and how many were seen 1 .. CUTOFF times."""
    low = np.zeros((n, CUTOFF), np.int32)
    for r in range(1, CUTOFF + 1):
        low[:, r - 1] = np.bincount(by[total == r], minlength=n)
    return np.bincount(by, weights=np.where(total > 0, lower, 0.0), minlength=n), low


class Level:
    """The distinct n-grams of one order in a block, in order of (history, word): histories `key` with their counts in
    all training and in all held-out texts; per n-gram its history `by`, its word, the block's two counts, the count of the
    n-gram without its first word, and the size D of the history without its first word."""

    def __init__(self, key, count, by, word, own, low_count, low_size, lower: Discounted, whole: bool):
        self.key, (self.count, self.count_held), self.by, self.word, (self.own, self.held) = key, count, by, word, own
        self.low_count, self.low_size = low_count, low_size
        n, (own, held) = len(key), own
        self.start = np.r_[0, np.cumsum(np.bincount(by, minlength=n))]
        inside = lambda w: np.bincount(by, weights=w, minlength=n).astype(np.int64)
        self.sent = np.arange(n) if whole else np.flatnonzero((self.count != inside(own)) | (self.count_held != inside(held)))
        self.asks = np.zeros(n, bool)
        self.asks[by[own == 0]] = True
        self.total, self.total_held = own.astype(np.int64), held.astype(np.int64)
        self.lower_sum, self.low = _summed(by, n, own, lower.left(low_count) / low_size[by])
        self.own_low = self.low.any(axis=1)

    def dealt(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The histories that are sent, by bucket, and their buckets."""
        bucket = (C.mix(self.key[self.sent].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return self.sent[order], bucket[order]

    def children(self, which: np.ndarray) -> np.ndarray:
        n = self.start[which + 1] - self.start[which]
        return np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def questions(self, block: int, level: int, n_buckets: int) -> list[tuple]:
        histories, bucket = self.dealt(n_buckets)
        rows = []
        for b, lo, hi in C.stretches(bucket):
            h = histories[lo:hi]
            c, key = self.children(h), self.key[h]
            data = C.pack(
                planes(C.gaps(key >> np.uint64(32))), planes(key & _LOW32), planes(self.start[h + 1] - self.start[h]), planes(self.low_size[h]), self.asks[h].astype(np.uint8),
                planes(self.word[c]), planes(self.own[c]), planes(self.low_count[c]), planes(self.held[c]),
            )
            rows.append(("ask", b, block, level, data, None))
        done = np.ones(len(self.key), bool)
        done[self.sent] = False
        return [*rows, ("stats", block % n_buckets, None, level, None, counts_of_counts(self.own[done[self.by]]))]

    def hear(self, answers: list[tuple[int, bytes]], n_buckets: int) -> None:
        """Take totals, and for histories with a word that this block's training texts lack, what alpha needs."""
        got = [C.unpack(d) for _, d in sorted(answers, key=lambda x: x[0])]
        histories, _ = self.dealt(n_buckets)
        if len(histories):
            total, low = np.concatenate([unplaned(g[0]) for g in got]), np.concatenate([g[1] for g in got]).astype(bool)
            c, asks = self.children(histories), histories[self.asks[histories]]
            if len(total) != len(c) or len(low) != len(histories):
                raise ValueError("a block did not get all of its answers")
            self.total[c], self.total_held[c] = total, np.concatenate([unplaned(g[4]) for g in got])
            self.own_low[histories] = low
            self.lower_sum[asks] = np.concatenate([g[2] for g in got])
            self.low[asks] = np.concatenate([unplaned(g[3]).reshape(-1, CUTOFF) for g in got])

    def sizes(self) -> np.ndarray:
        """D of each history."""
        return self.count + ~self.own_low


class Block:
    """A block, its words as numbers, and its n-grams as far as answers have come."""

    def __init__(self, data: bytes, answers: list[tuple], numbers: list[list[int]], n_buckets: int, order: int, whole: bool = False):
        self.whole = whole
        self.ids, self.null, self.held, self.sizes, self.words, tokens = C.unpack(data)
        self.tokens = unplaned(tokens)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = self.held[self.doc] == 0
        self.discounts = [Discounted(x) for x in numbers]
        self.levels: list[Level] = []
        self.of_token: list[np.ndarray] = []
        heard = {k: [(b, d) for b, at, d in answers if at == k] for k in range(1, order + 1)}
        if not answers:
            return
        got = [C.unpack(d) for _, d in sorted(heard[1], key=lambda x: x[0])]
        self.number, self.count, self.count_held = (np.concatenate([unplaned(g[i]) for g in got]) for i in (0, 1, 2))
        if len(self.count) != len(self.words):
            raise ValueError("a block did not get all of its answers")
        for k in range(2, min(order, len(numbers) + 1) + 1):
            self.levels.append(self._second() if k == 2 else self._third())
            if k <= len(numbers):
                self.levels[-1].hear(heard[k], n_buckets)

    def counts(self, which: np.ndarray, train: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each of n things stands in training and in held-out texts."""
        return np.bincount(which[train], minlength=n).astype(np.int32), np.bincount(which[~train], minlength=n).astype(np.int32)

    def _distinct(self, key: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        grams, of_token = np.unique(key, return_inverse=True)
        at = np.full(len(self.tokens), -1, np.int32)
        at[tokens] = of_token
        self.of_token.append(at)
        return grams, self.counts(of_token, self.train[tokens], len(grams))

    def _second(self) -> Level:
        number = self.number[self.tokens].astype(np.uint64)
        before = np.empty(len(number), np.uint64)
        before[1:] = number[:-1]
        before[np.cumsum(self.sizes, dtype=np.int64) - self.sizes] = _START
        self.grams, own = self._distinct((before << np.uint64(32)) | number, np.arange(len(number)))
        key, by = np.unique(self.grams >> np.uint64(32), return_inverse=True)
        order = np.argsort(self.number)
        place = lambda numbers: order[np.searchsorted(self.number[order], numbers)]
        word = (self.grams & _LOW32).astype(np.int64)
        # A text begins as often as it ends.
        end, at = np.searchsorted(self.words, _END), place(np.maximum(key.astype(np.int64), self.number.min()))
        seen = tuple(np.where(key == _START, count[end], count[at]) for count in (self.count, self.count_held))
        # What a pair's word is among the block's words, any of its tokens knows.
        self.word_of = np.empty(len(word), np.int64)
        self.word_of[self.of_token[0]] = self.tokens
        return Level(key, seen, by, word, own, self.count[self.word_of], np.full(len(key), self.discounts[0].size, np.int64), self.discounts[0], self.whole)

    def _third(self) -> Level:
        two, of_token = self.levels[0], self.of_token[0]
        later = np.ones(len(self.tokens), bool)
        later[np.cumsum(self.sizes, dtype=np.int64) - self.sizes] = False
        at = np.flatnonzero(later)
        number = self.number[self.tokens[at]].astype(np.uint64)
        grams, own = self._distinct((of_token[at - 1].astype(np.uint64) << np.uint64(32)) | number, at)
        history, by = np.unique(grams >> np.uint64(32), return_inverse=True)
        history, key = history.astype(np.int64), self.grams[history.astype(np.int64)]
        # The triple that ends at a token, without its first word, is the pair that ends there; the pair's history is what
        # the triple's history has without its first word.
        triple, pair = self.of_token[1][at], of_token[at]
        self.shorter, low_history = np.empty(len(grams), np.int64), np.empty(len(key), np.int64)
        self.shorter[triple] = pair
        low_history[by[triple]] = two.by[pair]
        return Level(key, (two.total[history], two.total_held[history]), by, (grams & _LOW32).astype(np.int64), own, two.total[self.shorter], two.sizes()[low_history], self.discounts[1], self.whole)

    def probabilities(self) -> list[np.ndarray]:
        """P of each distinct word, pair and triple of the block, each order from the one below."""
        out = [self.discounts[0].word(self.count)]
        for level, disc, shorter in zip(self.levels, self.discounts[1:], (lambda: self.word_of, lambda: self.shorter), strict=False):
            lower, size = out[-1][shorter()], level.sizes()
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = (~level.own_low + sum(level.low[:, r] * given for r, given in enumerate(disc.given))) / size / (1 - level.lower_sum)
            back = np.where(level.count > 0, alpha, 1.0)[level.by] * lower
            out.append(np.where(level.total > 0, disc.left(level.total) / size[level.by], back))
        return out


def _ask_words(batches, n_buckets: int):
    for batch in batches:
        for name, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            block = Block(data, [], [], n_buckets, 1)
            own, held = block.counts(block.tokens, block.train, len(block.words))
            yield _rows([("ask", b, name, 1, C.pack(np.frombuffer(C.pack_sorted(block.words[lo:hi]), np.uint8), planes(own[lo:hi]), planes(held[lo:hi])), None) for b, lo, hi in C.stretches(C.bucket_of(block.words, n_buckets))])


def _answer_words(group: pa.Table, n_buckets: int, keep: bool = False) -> pa.Table:
    """To each block: numbers of its words, from 1, and their counts. A bucket numbers its words by falling counts, those
    that a stored model does not have after those that it has. keep: also the bucket's part of a model."""
    kinds, blocks, parts = group.column("kind").to_pylist(), group.column("block").to_pylist(), [C.unpack(d) for d in group.column("data").to_pylist()]
    bucket = group.column("bucket")[0].as_py()
    keys = [C.unpack_sorted(p[0].tobytes()) for p in parts]
    word, at = np.unique(np.concatenate(keys), return_inverse=True)
    total, held = (np.bincount(at, weights=np.concatenate([unplaned(p[i]) for p in parts]), minlength=len(word)).astype(np.int64) for i in (1, 2))
    number = np.zeros(len(word), np.int64)
    for kind, p, key in zip(kinds, parts, keys, strict=True):
        if kind == "model":
            number[np.searchsorted(word, key)] = unplaned(p[3])
    new = np.flatnonzero(number == 0)
    number[new[np.lexsort((word[new], -total[new]))]] = 1 + (-(-int(number.max(initial=0)) // n_buckets) + np.arange(len(new))) * n_buckets + bucket
    if len(word) and int(number.max()) >= 1 << 32:
        raise ValueError("more than 2**32 words")
    rows, lo = [("stats", bucket, None, 1, None, counts_of_counts(total))], 0
    for kind, block, n in zip(kinds, blocks, map(len, keys), strict=True):
        which = at[lo : lo + n]
        if kind == "ask":
            rows.append(("answer", bucket, block, 1, C.pack(planes(number[which]), planes(total[which]), planes(held[which])), None))
        lo += n
    if keep:
        seen = total > 0
        rows.append(("model", bucket, None, 1, C.pack(np.frombuffer(C.pack_sorted(word[seen]), np.uint8), planes(total[seen]), planes(np.zeros(int(seen.sum()), np.int64)), planes(number[seen])), None))
    return _table(rows)


def _ask(blocks: pa.Table, answers: pa.Table, n_buckets: int, level: int, numbers: list[list[int]], whole: bool = False) -> pa.Table:
    if not blocks.num_rows:
        return _ROW.empty_table()
    name = blocks.column("block")[0].as_py()
    heard = list(zip(*(answers.column(c).to_pylist() for c in ("bucket", "level", "data")), strict=True))
    return _table(Block(blocks.column("data")[0].as_py(), heard, numbers, n_buckets, level, whole).levels[-1].questions(name, level, n_buckets))


def _answer(group: pa.Table, level: int, numbers: list[list[int]], keep: bool = False) -> pa.Table:
    """To each block: totals of its n-grams, and what alpha needs of its histories. keep: also the bucket's part of a
    model, which has the form of a question with the training counts."""
    kinds, blocks, data, stats = (group.column(c).to_pylist() for c in ("kind", "block", "data", "numbers"))
    bucket = group.column("bucket")[0].as_py()
    rows = [("stats", bucket, None, level, None, [sum(x) for x in zip(*(s for s in stats if s is not None), strict=True)])] if "stats" in kinds else []
    asked = [(k, b, d) for k, b, d in zip(kinds, blocks, data, strict=True) if k in ("ask", "model")]
    parts = [C.unpack(d) for _, _, d in asked]
    if not parts:
        return _table(rows)
    keys = [(np.cumsum(unplaned(p[0])).astype(np.uint64) << np.uint64(32)) | unplaned(p[1]).astype(np.uint64) for p in parts]
    n_words = [unplaned(p[2]) for p in parts]
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    low_size = np.empty(len(key), np.int64)
    low_size[place] = np.concatenate([unplaned(p[3]) for p in parts])
    of = np.repeat(place, np.concatenate(n_words))
    word, own, low_count, held = (np.concatenate([unplaned(p[i]) for p in parts]) for i in (5, 6, 7, 8))
    grams, first, at = np.unique((of.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_index=True, return_inverse=True)
    by = (grams >> np.uint64(32)).astype(np.int64)
    total, held = (np.bincount(at, weights=w, minlength=len(grams)).astype(np.int64) for w in (own, held))
    lower = Discounted(numbers[level - 2]).left(low_count[first]) / low_size[by]
    lower_sum, low = _summed(by, len(key), total, lower)
    rows.append(("stats", bucket, None, level, None, counts_of_counts(total)))
    h = c = 0
    for (kind, block, _), p, n in zip(asked, parts, n_words, strict=True):
        mine = place[h : h + len(n)]
        asks = mine[p[4].astype(bool)]
        which = at[c : c + int(n.sum())]
        if kind == "ask":
            rows.append(("answer", bucket, block, level, C.pack(planes(total[which]), low[mine].any(axis=1).astype(np.uint8), lower_sum[asks], planes(low[asks].ravel()), planes(held[which])), None))
        h, c = h + len(n), c + int(n.sum())
    if keep:
        seen = np.flatnonzero(total > 0)
        has, n = np.unique(by[seen], return_counts=True)
        nothing = np.zeros(len(seen), np.int64)
        stored = C.pack(
            planes(C.gaps(key[has] >> np.uint64(32))), planes(key[has] & _LOW32), planes(n), planes(low_size[has]), np.zeros(len(has), np.uint8),
            planes((grams[seen] & _LOW32).astype(np.int64)), planes(total[seen]), planes(low_count[first][seen]), planes(nothing),
        )
        rows.append(("model", bucket, None, level, stored, None))
    return _table(rows)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(blocks: pa.Table, answers: pa.Table, n_buckets: int, order: int, numbers: list[list[int]], whole: bool = False) -> pa.Table:
    if not blocks.num_rows:
        return _SCORES.empty_table()
    heard = list(zip(*(answers.column(c).to_pylist() for c in ("bucket", "level", "data")), strict=True))
    b = Block(blocks.column("data")[0].as_py(), heard, numbers, n_buckets, order, whole)
    one, per = b.discounts[0], lambda w: np.bincount(b.doc, weights=w, minlength=len(b.sizes))
    base = np.log10((b.count + 0.5) / (one.total + 0.5 * (one.distinct + 1)))
    p = b.probabilities()
    logs = np.log10(p[0])[b.tokens]
    for of_token, of_gram in zip(b.of_token, p[1:], strict=True):
        has = of_token >= 0
        logs[has] = np.log10(of_gram)[of_token[has]]
    columns = [pa.array(b.ids, mask=b.null.astype(bool)), b.held.astype(bool), b.sizes.astype(np.int64), per((b.count > 0)[b.tokens]).astype(np.int64), np.full(len(b.ids), one.total), per(base[b.tokens]), per(logs)]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=_SCORES)


_SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _blocks(docs: DataFrame, total: int, learns: bool | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.bucketed(C.arrow_map(rows, _tokens, "block long, data binary", learns), "katz-blocks", "block", C.parts_of(docs.sparkSession, total, 2 * BLOCK_BYTES))


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs, learnt from those
    that are not held out."""
    if not 1 <= order <= 3:
        raise ValueError("n-grams have one to three words")
    total = C.text_bytes(docs)
    n, blocks = C.parts_of(docs.sparkSession, total, BUCKET_BYTES), _blocks(docs, total, None)
    table = C.written(C.arrow_groups(C.arrow_map(blocks, _ask_words, _ROW_DDL, n), "bucket", _answer_words, _ROW_DDL, n), "katz-1", codec="uncompressed", partition_by="kind")
    answers, numbers = table.where("kind = 'answer'"), [_numbers(table)]
    for level in range(2, order + 1):
        asked = C.arrow_pairs(blocks, answers, "block", _ask, _ROW_DDL, n, level, numbers)
        table = C.written(C.arrow_groups(asked, "bucket", _answer, _ROW_DDL, level, numbers), f"katz-{level}", codec="uncompressed", partition_by="kind")
        answers, numbers = answers.unionByName(table.where("kind = 'answer'")), [*numbers, _numbers(table)]
    return C.arrow_pairs(blocks, answers, "block", _score, _SCORES_DDL, n, order, numbers)


class Model(NamedTuple):
    """A stored model: tables of n-grams by order and bucket of the history, with their counts and what the order below
    gives them; the counts of counts of each order; the number of buckets."""

    tables: list[DataFrame]
    numbers: list[list[int]]
    n_buckets: int


def learn(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all rows of docs, its tables in the shared folder."""
    total = C.text_bytes(docs)
    n, blocks = C.parts_of(docs.sparkSession, total, BUCKET_BYTES), _blocks(docs, total, True)
    table = C.written(C.arrow_groups(C.arrow_map(blocks, _ask_words, _ROW_DDL, n), "bucket", _answer_words, _ROW_DDL, n, True), "katz-learn-1", partition_by="kind")
    tables, answers, numbers = [table.where("kind = 'model'")], table.where("kind = 'answer'"), [_numbers(table)]
    for level in range(2, order + 1):
        asked = C.arrow_pairs(blocks, answers, "block", _ask, _ROW_DDL, n, level, numbers, True)
        table = C.written(C.arrow_groups(asked, "bucket", _answer, _ROW_DDL, level, numbers, True), f"katz-learn-{level}", partition_by="kind")
        tables, answers, numbers = [*tables, table.where("kind = 'model'")], answers.unionByName(table.where("kind = 'answer'")), [*numbers, _numbers(table)]
    return Model(tables, numbers, n)


def score_with(model: Model, docs: DataFrame) -> DataFrame:
    """As score_documents, of any rows under a stored model. Blocks ask the buckets of its tables, order by order; what
    they hold themselves counts for nothing, so held_out is true."""
    n, numbers = model.n_buckets, model.numbers
    blocks = _blocks(docs, C.text_bytes(docs), False)
    columns = [f.name for f in _ROW]
    asked = C.arrow_map(blocks, _ask_words, _ROW_DDL, n)
    answers = None
    for level, stored in enumerate(model.tables, 1):
        if level > 1:
            asked = C.arrow_pairs(blocks, answers, "block", _ask, _ROW_DDL, n, level, numbers[: level - 1], True)
        both = asked.where("kind = 'ask'").unionByName(stored.select(*columns))
        groups = C.arrow_groups(both, "bucket", _answer_words, _ROW_DDL, n) if level == 1 else C.arrow_groups(both, "bucket", _answer, _ROW_DDL, level, numbers[: level - 1])
        table = C.written(groups, f"katz-score-{level}", codec="uncompressed", partition_by="kind").where("kind = 'answer'")
        answers = table if answers is None else answers.unionByName(table)
    return C.arrow_pairs(blocks, answers, "block", _score, _SCORES_DDL, n, len(model.tables), numbers, True)


def _numbers(table: DataFrame) -> list[int]:
    return [x or 0 for x in table.where("kind = 'stats'").agg(*[F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(CUTOFF + 3)]).first()]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.table(spark, sf_dir, "documents"))
