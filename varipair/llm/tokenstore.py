"""Token ids in a content-addressed store.

The id stream of each document is cut where a rolling hash of the last ids asks for it, so equal passages give
equal chunks wherever they stand. A store is a folder of three tables:

  kind=chunk    key (BLAKE2b-128 of the ids), n, payload (ids as little-endian u2, or u4 where one needs it)
  kind=recipe   doc_id, key, n_tokens, digests (chunk keys in order), sizes (u4 ids of each), root (Merkle root)
  stream        the recipes in ascending doc_id order, with `start`, the ids of all documents before

Each chunk is stored once. Verification reads every chunk back, recomputes its key, size and CRC, recomputes
each Merkle root from the keys, and combines the CRCs of a document's chunks into that of its ids, so payloads
are not moved again; `read_ids` moves them and returns the ids themselves.

Cases: null text is empty and has the end id only; rows with null or repeated doc_id are documents of their
own (null first, ties in order of their key, which names the place in the input); an empty table gives an empty store; extra columns are ignored.
Work in memory: one slice of texts, and the keys of the last 100,000 chunks that a task gave out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Ids of the rolling window, and the smallest, usual and largest chunk.
WINDOW, LEAST, USUAL, MOST = 8, 64, 512, 4096
_KEY = 16
#: Bytes of text that are encoded at once.
SLICE_BYTES = 3 << 20
#: Keys of chunks that a task remembers to have given out; others go out again, and the shuffle drops them.
GIVEN = 100_000
_POLY = np.uint64(0xEDB88320)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_ROWS = "kind string, key binary, doc_id long, n_tokens long, digests binary, sizes binary, root binary, n int, payload binary"
_ROW_SCHEMA = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("sizes", pa.binary()), ("root", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])


def rolling(stream: np.ndarray) -> np.ndarray:
    """The rolling hash of each WINDOW neighbours: sums of their mixed values times powers of an odd base, from
    running sums, divided by the power at the window's start; the upper bits, as low ones mix little."""
    n = len(stream) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    values, at = np.unique(stream, return_inverse=True) if int(stream.max()) >= 1 << 20 else (np.arange(int(stream.max()) + 1), stream)
    sums = np.zeros(len(stream) + 1, np.uint64)
    np.cumsum(C.mix(values.astype(np.uint64) + np.uint64(1))[at] * _powers(_BASE, len(stream)), out=sums[1:])
    return ((sums[WINDOW:] - sums[:-WINDOW]) * _powers(_INVERSE, n)) >> np.uint64(40)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; a table of them is kept for slices of the usual size."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(n, base, np.uint64)
        held[:1] = 1
        held = np.cumprod(held)
        if n <= SLICE_BYTES:
            _POWERS[base] = held
    return held[:n]


def marks_of(stream: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Per document of a stream of ids: the places behind an id where the rolling hash of the last WINDOW ids of
    that document is 0 modulo USUAL."""
    hits = np.flatnonzero((rolling(stream) & np.uint64(USUAL - 1)) == 0)
    starts = np.r_[0, ends[:-1]]
    lows, highs = np.searchsorted(hits, starts), np.searchsorted(hits, ends - WINDOW, side="right")
    hits = hits.tolist()
    return [[x - start + WINDOW for x in hits[a:b]] for a, b, start in zip(lows.tolist(), highs.tolist(), starts.tolist(), strict=True)]


def cut(n: int, marks: list[int]) -> list[tuple[int, int]]:
    """Chunk bounds of n ids: at marks, LEAST ids at least and MOST at most."""
    bounds, at = [], 0
    for mark in marks:
        while mark - at > MOST:
            bounds.append((at, at + MOST))
            at += MOST
        if mark - at >= LEAST:
            bounds.append((at, mark))
            at = mark
    while n - at > MOST:
        bounds.append((at, at + MOST))
        at += MOST
    if at < n:
        bounds.append((at, n))
    return bounds


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=_KEY).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" + ids.astype("<u2").tobytes()) if small else (b"\4" + ids.astype("<u4").tobytes())


def unpack_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def _encode(batches, path: str, end_id: int):
    """Recipe rows, and the chunks that this task has not lately given out."""
    from pyspark import TaskContext

    from . import bytebpe

    bpe, task, given, row = bytebpe.load(path), TaskContext.get().partitionId(), set(), 0
    for part in C.steps(batches, most=SLICE_BYTES):
        ids, ends = bpe.encode_column(part.column("text"))
        stream, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
        packed = stream.astype("<u2") if not len(stream) or int(stream.max()) < 1 << 16 else None
        chunks, recipes, start = [], [], 0
        for doc_id, stop, marks in zip(part.column("doc_id").to_pylist(), ends.tolist(), marks_of(stream, ends), strict=True):
            keys, sizes = [], []
            for a, b in cut(stop - start, marks):
                ids = stream[start + a : start + b]
                keys.append(key := digest(ids.tobytes()))
                sizes.append(b - a)
                if key not in given:
                    given.add(key)
                    chunks.append((key, b - a, b"\2" + packed[start + a : start + b].tobytes() if packed is not None else pack_ids(ids)))
            # A task that runs again meets its rows in the same order, so its place names a row.
            recipes.append((digest(b"recipe %d %d" % (task, row)), doc_id, stop - start, b"".join(keys), np.array(sizes, "<u4").tobytes(), merkle_root(keys)))
            row, start = row + 1, stop
        if len(given) > GIVEN:
            given.clear()
        C.trim()
        none = [None] * (len(chunks) + len(recipes))
        c, r = (list(map(list, zip(*x, strict=True))) if x else [[] for _ in range(w)] for x, w in ((chunks, 3), (recipes, 6)))
        no_c, no_r = none[: len(chunks)], none[: len(recipes)]
        yield C.batch_of(_ROW_SCHEMA, [
            ["chunk"] * len(chunks) + ["recipe"] * len(recipes), c[0] + r[0], no_c + r[1], no_c + r[2], no_c + r[3], no_c + r[4], no_c + r[5], c[1] + no_r, c[2] + no_r,
        ])


def _once(batches):
    """The first row of each key, of rows in order of their keys."""
    last = None
    for batch in batches:
        keys = batch.column("key")
        if len(keys):
            new = np.r_[keys[0].as_py() != last, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False).astype(bool)]
            last = keys[-1].as_py()
            yield batch.filter(pa.array(new))


def _running(batches):
    """Adds the ids before each document within its partition."""
    at = 0
    for batch in batches:
        n = np.asarray(batch.column("n_tokens").to_numpy(zero_copy_only=False), np.int64)
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], names=[*batch.schema.names, "before"])
        at = int(ends[-1]) if len(ends) else at


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode docs and write the store at path, a folder that all executors share."""
    spark = docs.sparkSession
    n = C.shuffle_partitions(spark)
    rows = C.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _encode, _ROWS, tokenizer, end_id)
    C.arrow_map(rows.repartition(n, "key").sortWithinPartitions("key"), _once, _ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/rows")
    order = _read(spark, path).where("kind = 'recipe'").select("doc_id", "key", "n_tokens", "digests", "sizes", "root").repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    fields = "doc_id long, key binary, n_tokens long, digests binary, sizes binary, root binary, part int"
    C.arrow_map(order.withColumn("part", F.spark_partition_id()), _running, fields + ", before long").write.option("compression", "zstd").parquet(f"{path}/stream")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(f"{path}/rows")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with their `start`. The offsets of partitions are as many rows as there are partitions."""
    rows = spark.read.parquet(f"{path}/stream")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("part", "base", "before")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bits reflected."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint64), np.asarray(b, np.uint64))
    b, out = b.copy(), np.zeros(b.shape, np.uint64)
    for i in range(31, -1, -1):
        out ^= b * ((a >> np.uint64(i)) & np.uint64(1))
        b = (b >> np.uint64(1)) ^ (_POLY * (b & np.uint64(1)))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What CRC-32s add to that of a longer string in which n_bytes follow."""
    power = np.full(crc.shape, 1 << 31, np.uint64)  # x to the power 0
    square = np.uint64(1 << 30)  # x
    left = n_bytes.astype(np.uint64) << np.uint64(3)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        power[odd] = times(power[odd], square)
        square = times(square, square)
        left >>= np.uint64(1)
    return times(power, crc)


def _check_chunks(batches):
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])
    for batch in batches:
        keys, out = batch.column("key").to_pylist(), []
        for key, payload in zip(keys, batch.column("payload").to_pylist(), strict=True):
            data = unpack_ids(payload).tobytes()
            if digest(data) != key:
                raise ValueError(f"chunk {key.hex()} does not hold what its key says")
            out.append((len(data) // 4, zlib.crc32(data)))
        yield C.batch_of(schema, [keys, [x[0] for x in out], [x[1] for x in out]])


def _entries(batches):
    """A row for each chunk of each document; checks the Merkle roots."""
    schema = pa.schema([("uid", pa.binary()), ("seq", pa.int32()), ("key", pa.binary()), ("size", pa.int64()), ("after", pa.int64())])
    for batch in batches:
        rows = []
        for uid, digests, sizes, root in zip(*(batch.column(c).to_pylist() for c in ("key", "digests", "sizes", "root")), strict=True):
            keys, n = [digests[i : i + _KEY] for i in range(0, len(digests), _KEY)], np.frombuffer(sizes, "<u4").astype(np.int64)
            if merkle_root(keys) != root:
                raise ValueError(f"the recipe {uid.hex()} does not have its Merkle root")
            after = 4 * (n.sum() - np.cumsum(n))
            rows += zip([uid] * len(keys), range(len(keys)), keys, n.tolist(), after.tolist(), strict=True)
        for i in range(0, len(rows), 100_000):
            yield C.batch_of(schema, list(map(list, zip(*rows[i : i + 100_000], strict=True))))


def _shifted(batches):
    schema = pa.schema([("uid", pa.binary()), ("n", pa.int64()), ("part_crc", pa.int64())])
    for batch in batches:
        if batch.num_rows:
            crc, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
            yield C.batch_of(schema, [batch.column("uid"), batch.column("n"), shift_crc(crc.astype(np.uint64), after).astype(np.int64)])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Fails on a chunk or recipe that does
    not match its digest, on a missing chunk and on a wrong size."""
    recipes = stream(spark, path)
    chunks = C.arrow_map(_read(spark, path).where("kind = 'chunk'").select("key", "payload"), _check_chunks, "key binary, n long, crc long")
    entries = C.arrow_map(recipes.select("key", "digests", "sizes", "root"), _entries, "uid binary, seq int, key binary, size long, after long")
    sized = entries.join(chunks, "key", "left").select("uid", "after", "crc", F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.lit("a chunk is missing or has another size")).cast("long")).alias("n"))
    crcs = C.arrow_map(sized, _shifted, "uid binary, n long, part_crc long").groupBy("uid").agg(F.sum("n").alias("n"), F.bit_xor("part_crc").alias("ids_crc32"))
    whole = recipes.select("doc_id", "start", "n_tokens", F.col("key").alias("uid")).join(crcs, "uid", "left")
    return whole.select("doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a document has another number of ids")).cast("long")).alias("n_tokens"), "ids_crc32")


def _join_payloads(batches):
    schema = pa.schema([("uid", pa.binary()), ("ids", pa.list_(pa.int64()))])
    for batch in batches:
        ids = [np.concatenate([unpack_ids(p["payload"]) for p in sorted(parts, key=lambda p: p["seq"])]).astype(np.int64) for parts in batch.column("parts").to_pylist()]
        yield C.batch_of(schema, [batch.column("uid"), pa.array(ids, pa.list_(pa.int64()))])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of each document, put together from the store."""
    recipes = stream(spark, path)
    entries = C.arrow_map(recipes.select("key", "digests", "sizes", "root"), _entries, "uid binary, seq int, key binary, size long, after long")
    parts = entries.join(_read(spark, path).where("kind = 'chunk'").select("key", "payload"), "key").groupBy("uid").agg(F.collect_list(F.struct("seq", "payload")).alias("parts"))
    return recipes.select("doc_id", "start", F.col("key").alias("uid")).join(C.arrow_map(parts, _join_payloads, "uid binary, ids array<long>"), "uid").drop("uid")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.fresh_path(spark, "tokenstore")
    write_store(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return verify(spark, path)
