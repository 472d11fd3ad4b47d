"""Suffix-array dedup: the bytes covered by a string of WIDTH bytes that starts anywhere else too.

The suffixes that can matter are found first. Every window of WIDTH bytes is named by the least hash of the GRAM-byte
strings in it, so equal windows have equal names wherever they stand. Neighbours whose least string stands at one
place (the last of equal ones) form a run, so no two windows of a run are equal; its bytes go into one bucket by its
name. A run whose bytes occur twice is repeated as a whole. A name that occurs in one run only has unique windows.
What is left, runs that share a name but not all bytes, is sorted: each bucket builds the suffix array of its
distinct runs by the difference-cover algorithm (sort the triples at places 1 and 2 modulo 3, name them, name triples
of names again until a name spans WIDTH symbols or all differ, sort the places 0 modulo 3 by their first symbol and
the rank behind it, merge), and compares the first WIDTH bytes of neighbours in it, byte by byte. As all equal windows
are in one bucket, the buckets' arrays together decide as one array would.

Texts lie in blocks, a bucketed table of the shared folder, and are read there by every step, so only names, verdicts,
spans and the bytes to be sorted move. A run's bytes travel from one block each, however many copies there are, so
a passage that a third of all texts share is one run in its bucket. Where its surroundings differ, the runs around it
share a name and are all distinct. Such a hot name (more than HOT_IN_BLOCK distinct runs in a block, which then sends one
entry for it, or HOT_IN_BUCKET in all) is not sorted: each block sends the hash of each of its windows once, to buckets
of the hash, so neither its runs nor an equal window of theirs meets in one task.

Cases: null text is empty; texts below WIDTH bytes have no window; repeated rows cover each other; matches never
cross documents; an empty table gives no rows; extra columns are kept by `dedupe`, whatever their names. Names and bytes
of runs, and windows of hot names, are compared by 64-bit hashes each. Memory: a block of 8 MB or the longest text, some 100 bytes for each byte of a
piece of 128 KB, and some 100 for each byte of a bucket's runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH, GRAM = 200, 100
BLOCK_BYTES = 8 << 20
#: Bytes that are hashed at once, and bytes of text for each bucket of names.
PIECE_BYTES, BUCKET_BYTES = 128 << 10, 4 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_VALUES = C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BLOCK = pa.schema([("block", pa.int64()), ("data", pa.binary())])
_ROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
_ROW_DDL = "kind string, bucket int, block long, data binary"
UNIQUE, REPEATED, SORT, REPEATED_SORT, HASH = 0, 1, 2, 3, 4
#: A name with more distinct runs than this in a block, or in its bucket, is decided by hashes of its windows.
HOT_IN_BLOCK, HOT_IN_BUCKET = 64, 2_000
_HOT = 3


# ---- the difference-cover suffix sort ----------------------------------------------------------------------------


def _names(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of triples, equal ones alike, and how many differ."""
    most = 1 + max(int(x.max(initial=0)) for x in (first, second, third))
    if most < 1 << 21:
        key = (first.astype(np.int64) * most + second) * most + third
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((third, second, first))
        new = np.zeros(max(0, len(order) - 1), bool)
        for k in (first, second, third):
            new |= np.diff(k[order]) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[True, new]) if len(order) else 0
    return rank, int(new.sum()) + 1


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def suffix_order(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffix array of s (symbols from 1). With a depth, suffixes that agree in so many symbols are neighbours
    in any order."""
    n = len(s)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    ones, twos = np.arange(1, n, 3), np.arange(2, n, 3)
    names, distinct = _names(*(np.concatenate([t[ones + k], t[twos + k]]) for k in range(3)))
    span, cut = 3, len(ones)
    while distinct < len(names) and (depth is None or span < depth):
        # A name and those one and two spans behind, at places of its residue, make a triple of names.
        names, distinct = _names(names, *(np.concatenate([_shifted(names[:cut], k), _shifted(names[cut:], k)]) for k in (span // 3, 2 * span // 3)))
        span *= 3
    rank = np.zeros(n + 4, np.int64)
    rank[ones], rank[twos] = names[:cut], names[cut:]
    # Place 0 against 1: the first symbol, then the ranks behind. Against 2: two symbols, then the ranks behind.
    wide = np.int64(n + 4)
    one = lambda p: t[p] * wide + rank[p + 1]
    zeros = np.arange(0, n, 3)
    pair = np.concatenate([t[twos] * (int(t.max(initial=0)) + 1) + t[twos + 1], t[zeros] * (int(t.max(initial=0)) + 1) + t[zeros + 1]])
    _, code = np.unique(pair, return_inverse=True)
    two_of = code[: len(twos)] * wide + rank[twos + 2], code[len(twos) :] * wide + rank[zeros + 2]
    order = np.lexsort((two_of[1], one(zeros)))
    zeros, zeros_two = zeros[order], two_of[1][order]
    a = np.searchsorted(np.sort(one(ones)), one(zeros))
    b = np.searchsorted(np.sort(two_of[0]), zeros_two)
    sample = np.concatenate([ones, twos])
    sample = sample[np.argsort(rank[sample], kind="stable")]
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zeros)) + a + b] = zeros
    out[out < 0] = sample
    return out


def equal_neighbours(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Which neighbours in order begin with the same `width` bytes of data, compared in words of eight bytes: the last
    one first, and the others for those that are still alike."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alike = np.arange(max(0, len(order) - 1))
    places = [width - 8, *range(0, width - 8, 8)] if width >= 8 else range(width)
    for at in places:
        x, y = order[alike] + at, order[alike + 1] + at
        if width >= 8:
            same = np.ascontiguousarray(words[x]).view("<u8").ravel() == np.ascontiguousarray(words[y]).view("<u8").ravel()
        else:
            same = data[x] == data[y]
        alike = alike[same]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[alike] = True
    return out


# ---- windows, names and runs ---------------------------------------------------------------------------------------


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE_BYTES + WIDTH, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours, from minima of runs of 1, 2, 4 ..."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _pieces(texts: list[bytes]):
    """(place in the block, bytes, ends of texts in it): texts of WIDTH bytes or more, short ones together, long ones
    in parts that overlap by WIDTH - 1 bytes."""
    held, size, place, base = [], 0, 0, 0
    for text in texts:
        if held and (len(text) < WIDTH or size + len(text) > PIECE_BYTES):
            yield base, held
            held, size = [], 0
        if len(text) > PIECE_BYTES:
            step = PIECE_BYTES - WIDTH + 1
            for at in range(0, len(text) - WIDTH + 1, step):
                yield place + at, [text[at : at + PIECE_BYTES]]
        elif len(text) >= WIDTH:
            if not held:
                base = place
            held.append(text)
            size += len(text)
        place += len(text)
    if held:
        yield base, held


class Runs:
    """The runs of windows of a block of texts: start of the first and of the last window, name, and a hash of the
    bytes."""

    def __init__(self, texts: list[bytes]):
        got = [(*self._of(parts), base) for base, parts in _pieces(texts)]
        join = lambda i, kind: np.concatenate([x[i] for x in got]).astype(kind, copy=False) if got else np.empty(0, kind)
        shift = np.repeat(np.array([x[4] for x in got], np.int64), [len(x[0]) for x in got]) if got else 0
        self.first, self.last, self.name, self.bytes = join(0, np.int64) + shift, join(1, np.int64) + shift, join(2, np.uint64), join(3, np.uint64)

    @staticmethod
    def _of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * _UP[: len(data)], out=sums[1:])
        grams = C.mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1])
        name = sliding_min(grams, WIDTH - GRAM + 1)
        ok, at = np.zeros(len(name) + 1, bool), 0
        for part in parts:
            ok[at : at + len(part) - WIDTH + 1] = True
            at += len(part)
        # A run goes on while the least string stays the same one: no other value, and none like it comes in.
        new = grams[WIDTH - GRAM :] == name
        new[1:] |= (name[1:] != name[:-1]) | ~ok[:-2]
        new[0] = True
        new &= ok[:-1]
        stop = ok[:-1].copy()
        stop[:-1] &= new[1:] | ~ok[1:-1]
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        # Least hashes are small: spread them over the buckets.
        return first, last, C.mix(name[first] + np.uint64(1)), C.mix((sums[last + WIDTH] - sums[first]) * _DOWN[first])


def _pack(batches, text: str):
    """Blocks of rows: all columns as an Arrow stream."""
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    for part in C.steps(batches, text, BLOCK_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.Table.from_batches([part]).combine_chunks().to_batches()[0])
        yield C.batch_of(_BLOCK, [[(task << 32) + n], [sink.getvalue().to_pybytes()]])
        n += 1


def _open(data: bytes, text: str) -> tuple[pa.RecordBatch, list[bytes]]:
    """The rows of a block and their texts."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    return batch, C.texts_of(batch.column(text))


def _distinct(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of runs by (name, bytes), the first of each distinct one in it, and each run's distinct number."""
    order = np.lexsort((runs.bytes, runs.name))
    name, content = runs.name[order], runs.bytes[order]
    new = np.ones(len(order), bool)
    new[1:] = (name[1:] != name[:-1]) | (content[1:] != content[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


class Entries:
    """What a block says of its distinct runs: one entry for each, or one for all of a name that is hot in the block; the
    order of the runs, each run's distinct number, the first run of each, and the entry of each distinct run."""

    def __init__(self, runs: Runs, hot: int):
        self.order, self.first, self.number = _distinct(runs)
        names, contents = runs.name[self.order][self.first], runs.bytes[self.order][self.first]
        times = np.minimum(np.diff(np.r_[self.first, len(self.order)]), 2).astype(np.uint8)
        start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.empty(0, np.int64)
        many = np.diff(np.r_[start, len(names)]) > hot
        times[start[many]] = _HOT
        own = np.ones(len(names), bool)
        own[np.repeat(many, np.diff(np.r_[start, len(names)]))] = False
        own[start] = True
        self.entry = np.cumsum(own) - 1
        self.names, self.contents, self.times = names[own], contents[own], times[own]


def _ask(batches, n_buckets: int, text: str, hot: int):
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            e = Entries(Runs(_open(data, text)[1]), hot)
            rows = [("ask", b, block, C.pack(np.frombuffer(C.pack_sorted(e.names[lo:hi]), np.uint8), e.contents[lo:hi], e.times[lo:hi])) for b, lo, hi in C.stretches(C.bucket_of(e.names, n_buckets))]
            if rows:
                yield C.batch_of(_ROW, list(map(list, zip(*rows, strict=True))))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table(C.batch_of(_ROW, list(map(list, zip(*rows, strict=True)))).columns, schema=_ROW) if rows else _ROW.empty_table()


def _judge(group: pa.Table, most: int) -> pa.Table:
    """For each entry of each block: unique, repeated, to be sorted, repeated and to be sorted by this block for all,
    or, for all entries of a hot name, to be decided by window hashes."""
    blocks, parts = group.column("block").to_pylist(), [C.unpack(d) for d in group.column("data").to_pylist()]
    names = [C.unpack_sorted(p[0].tobytes()) for p in parts]
    name, content = np.concatenate(names), np.concatenate([p[1] for p in parts])
    times = np.concatenate([p[2] for p in parts]).astype(np.int64)
    order = np.lexsort((content, name))
    name, content = name[order], content[order]
    new_name = np.r_[True, name[1:] != name[:-1]]
    new = new_name.copy()
    new[1:] |= content[1:] != content[:-1]
    starts = np.flatnonzero(new)
    count = np.add.reduceat(times[order], starts)
    first_of_name = np.flatnonzero(new_name[starts])
    variants = np.diff(np.r_[first_of_name, len(starts)])
    single = np.add.reduceat((count == 1).astype(np.int64), first_of_name) > 0
    mixed = np.repeat((variants > 1) & single, variants)
    hot = np.repeat(((variants > most) & single) | (np.maximum.reduceat(np.maximum.reduceat(times[order], starts), first_of_name) == _HOT), variants)
    verdict = np.where(count > 1, np.where(mixed, REPEATED_SORT, REPEATED), np.where(mixed, SORT, UNIQUE)).astype(np.uint8)
    verdict[hot] = HASH
    spread = np.repeat(verdict, np.diff(np.r_[starts, len(order)]))
    later = np.ones(len(order), bool)
    later[starts] = False
    spread[later & (spread == REPEATED_SORT)] = REPEATED
    reply = np.empty(len(order), np.uint8)
    reply[order] = spread
    rows, at = [], 0
    for block, n in zip(blocks, map(len, names), strict=True):
        rows.append(("verdict", group.column("bucket")[0].as_py(), block, C.pack(reply[at : at + n])))
        at += n
    return _table(rows)


def _window_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every window of the runs."""
    size = last + WIDTH - first
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES, side="right")))
        k = size[lo:hi]
        at = np.repeat(first[lo:hi] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        sums = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(_VALUES[data[at]] * _UP[: len(at)], out=sums[1:])
        inside = np.flatnonzero(at <= np.repeat(last[lo:hi], k))
        hashes.append(C.mix((sums[inside + WIDTH] - sums[inside]) * _DOWN[inside]))
        places.append(at[inside])
        lo = hi
    return np.concatenate(hashes), np.concatenate(places)


def _ship(blocks: pa.Table, verdicts: pa.Table, n_buckets: int, text: str, hot: int) -> pa.Table:
    """The repeated runs of a block as spans; the bytes of those to be sorted, to their buckets; and of hot names the window
    hashes, to buckets of the hash. A window that stands twice in the block is a span already; its hash goes as a witness."""
    if not blocks.num_rows:
        return _ROW.empty_table()
    block = blocks.column("block")[0].as_py()
    texts = _open(blocks.column("data")[0].as_py(), text)[1]
    runs, data = Runs(texts), np.frombuffer(b"".join(texts), np.uint8)
    e = Entries(runs, hot)
    got = sorted(zip(verdicts.column("bucket").to_pylist(), verdicts.column("data").to_pylist(), strict=True))
    verdict = np.concatenate([C.unpack(d)[0] for _, d in got]) if got else np.empty(0, np.uint8)
    if len(verdict) != len(e.names):
        raise ValueError("a block did not get all of its verdicts")
    verdict = verdict[e.entry] if len(verdict) else verdict
    of_run = verdict[e.number] if len(e.number) else np.empty(0, np.uint8)
    hit = (of_run == REPEATED) | (of_run == REPEATED_SORT)
    spans = [(runs.first[hit], runs.last[hit] + WIDTH)]
    rows = []
    windows = np.flatnonzero(of_run == HASH)
    if len(windows):
        hashes, places = _window_hashes(data, runs.first[windows], runs.last[windows])
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        start = np.flatnonzero(new)
        times = np.diff(np.r_[start, len(hashes)])
        twice = places[np.repeat(times > 1, times)]
        spans.append((twice, twice + WIDTH))
        hashes, places = hashes[start], np.where(times > 1, -1, places[start])
        for b, lo, hi in C.stretches(C.bucket_of(hashes, n_buckets)):
            rows.append(("windows", b, block, C.pack(np.frombuffer(C.pack_sorted(hashes[lo:hi]), np.uint8), places[lo:hi].astype(np.int32 if len(data) < 1 << 31 else np.int64))))
    rows.append(("spans", block % n_buckets, block, C.pack(*map(np.concatenate, zip(*spans, strict=True)))))
    chosen = e.order[e.first[(verdict == SORT) | (verdict == REPEATED_SORT)]]
    size = runs.last[chosen] + WIDTH - runs.first[chosen]
    for b, lo, hi in C.stretches(C.bucket_of(runs.name[chosen], n_buckets)):
        r, k = chosen[lo:hi], size[lo:hi]
        at = np.repeat(runs.first[r] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        rows.append(("sort", b, block, C.pack(runs.first[r], k, data[at])))
    return _table(rows)


def _same_windows(group: pa.Table) -> list[tuple]:
    """Spans of the windows whose hash other blocks have too."""
    blocks, parts = group.column("block").to_pylist(), [C.unpack(d) for d in group.column("data").to_pylist()]
    hashes, places = np.concatenate([C.unpack_sorted(p[0].tobytes()) for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    order = np.argsort(hashes, kind="stable")
    alike = hashes[order][1:] == hashes[order][:-1]
    hit = np.zeros(len(order), bool)
    hit[1:] |= alike
    hit[:-1] |= alike
    chosen = np.sort(order[hit & (places[order] >= 0)])
    return [("spans", 0, blocks[i], C.pack(places[chosen[lo:hi]], places[chosen[lo:hi]] + WIDTH)) for i, lo, hi in C.stretches(owner[chosen])]


def _sort(group: pa.Table) -> pa.Table:
    """Suffix array of a bucket's runs; the windows whose neighbours in it begin with the same WIDTH bytes. Spans that
    are known already pass."""
    kinds = np.array(group.column("kind").to_pylist())
    known, hashed = group.filter(pa.array(kinds == "spans")), group.filter(pa.array(kinds == "windows"))
    group = group.filter(pa.array(kinds == "sort"))
    if hashed.num_rows:
        known = pa.concat_tables([known, _table(_same_windows(hashed))])
    if not group.num_rows:
        return known
    blocks, parts = group.column("block").to_pylist(), [C.unpack(d) for d in group.column("data").to_pylist()]
    first, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    data = np.concatenate([p[2] for p in parts])
    # Symbols: 1 ends a run, bytes are 2 to 257.
    start = np.cumsum(size + 1) - (size + 1)
    s = np.ones(int((size + 1).sum()), np.int32)
    run = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    place = np.arange(len(s)) - start[run]
    s[place < size[run]] = data.astype(np.int32) + 2
    windows = place + WIDTH <= size[run]
    order = suffix_order(s, WIDTH)
    order = order[windows[order]]
    same = equal_neighbours(np.maximum(s - 2, 0).astype(np.uint8), order, WIDTH)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    found = np.sort(order[hit])
    rows = []
    if len(found):
        begin, whose = first[run[found]] + place[found], owner[run[found]]
        edges = np.flatnonzero(np.r_[True, (found[1:] != found[:-1] + 1), True])
        new, last = edges[:-1], edges[1:] - 1
        cuts = np.searchsorted(whose[new], np.arange(len(blocks) + 1))
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if lo < hi:
                rows.append(("spans", 0, blocks[i], C.pack(begin[new[lo:hi]], begin[last[lo:hi]] + WIDTH)))
    return pa.concat_tables([known, _table(rows)])


def _covered(spans: pa.Table, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for data in spans.column("data").to_pylist():
        for at, step in zip(C.unpack(data), (1, -1), strict=True):
            np.add.at(edge, at, np.int32(step))
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _finish(blocks: pa.Table, spans: pa.Table, mode: str, names: list[str], text: str) -> pa.Table:
    batch, texts = _open(blocks.column("data")[0].as_py(), text)
    gone = _covered(spans, sum(map(len, texts)))
    rows, start = [], 0
    for data in texts:
        out = gone[start : start + len(data)]
        start += len(data)
        if not out.any():
            rows.append((len(data), 0, 0, None if mode == "text" else hashlib.sha256(data).hexdigest()))
            continue
        codes, out = np.frombuffer(data, np.uint8), out.copy()
        edges = np.diff(np.r_[False, out, False].astype(np.int8))
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if mode == "text":
            # Characters that are covered in part stay.
            follows = (codes & 0xC0) == 0x80
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                while x < y and follows[x]:
                    out[x], x = False, x + 1
                while x < y < len(data) and follows[y]:
                    y -= 1
                    out[y] = False
        kept = codes[~out].tobytes()
        rows.append((len(data), int(out.sum()), len(a), kept.decode() if mode == "text" else hashlib.sha256(kept).hexdigest()))
    got = list(map(list, zip(*rows, strict=True)))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([*batch.columns, *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names=[*batch.schema.names, *names])


def _run(docs: DataFrame, mode: str, names: list[str], text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    total = C.text_bytes(docs)
    n = C.parts_of(spark, total, BUCKET_BYTES)
    blocks = C.bucketed(C.arrow_map(docs, _pack, "block long, data binary", text), "suffix-blocks", "block", C.parts_of(spark, total, 2 * BLOCK_BYTES))
    verdicts = C.arrow_groups(C.arrow_map(blocks, _ask, _ROW_DDL, n, text, HOT_IN_BLOCK), "bucket", _judge, _ROW_DDL, HOT_IN_BUCKET)
    shipped = C.arrow_pairs(blocks, verdicts, "block", _ship, _ROW_DDL, n, text, HOT_IN_BLOCK)
    spans = C.arrow_groups(shipped, "bucket", _sort, _ROW_DDL)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{names[0]} long, {names[1]} long, {names[2]} long, {names[3]} string"]
    return C.arrow_pairs(blocks, spans, "block", _finish, ", ".join(fields), mode, names, text)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(rows, "digest", ["n_bytes", "n_removed", "n_spans", "kept_sha256"]).drop("text")


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with the repeated bytes taken out of text (whole characters only). Rows of
    which nothing is left go, those that had no text stay. A column n_chars follows the text."""
    n_bytes, n_removed, n_spans, kept = names = [C.free_name(docs.columns, x) for x in ("_n_bytes", "_n_removed", "_n_spans", "_kept")]
    out = _run(docs, "text", names).where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_bytes)))
    new = {"text": F.when(F.col(n_removed) > 0, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(n_removed) > 0, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(C.table(spark, sf_dir, "documents"))
