"""What the training-data operators share: table access, the shared folder, Arrow helpers, word rules.

Words everywhere are maximal runs of bytes other than space and 0x09-0x0D, so ``bytes.split()`` finds them.
Hashes of words and windows are 64 bits of xxh3; two different words meet with a chance of about
n * n / 2**65, some 3e-7 for the largest vocabulary measured here.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of text that one step inside a Python worker turns into lists at once.
STEP_BYTES = 2 << 20
#: Entries of a worker's memo of words; it is emptied beyond that, which changes no result.
MEMO = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a session on one machine may go
    without that setting (tests); it gets a temporary folder. Others raise: their executors' disks are not shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/varipair-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read again. Cuts lineage: a lost executor costs no recomputation
    of what stands before, and rows that were dealt by chance stay as they were dealt."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    out = df.write.option("compression", codec)
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of buckets; a bucket number is a group of its own, several to a folder beyond that.
MOST_BUCKETS = 20_000


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """df as a table in the shared folder in buckets of key, n or MOST_BUCKETS, read again. Later groupings and cogroups on
    key read it where it lies, so its rows move in no shuffle; how many keys share a bucket changes no group. A task writes one
    file for each bucket that its rows are in. The catalog entry goes at once; the files are the caller's to clear."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    table = os.path.basename(path).replace("-", "_")
    df.write.option("compression", "uncompressed").option("path", path).bucketBy(min(n, MOST_BUCKETS), key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def stretches(ascending: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each stretch of equal values."""
    if not len(ascending):
        return []
    at = np.flatnonzero(np.r_[True, ascending[1:] != ascending[:-1], True])
    return list(zip(ascending[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))


def text_bytes(docs: DataFrame) -> int:
    """The bytes of all texts, from which the numbers of blocks and buckets follow."""
    from pyspark.sql import functions as F

    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def parts_of(spark: SparkSession, total: int, each: int) -> int:
    """How many parts of `each` bytes hold `total`, and no fewer than the session asks for."""
    return max(shuffle_partitions(spark), -(-total // each))


def free_name(columns: list[str], wish: str) -> str:
    """A column name that is none of columns, in any letter case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """After a task: empty the memo of words, which a next task fills in a moment, and give memory that is free back to
    the system, where the C library can; a worker that waits holds none for others."""
    import ctypes

    WORD_HASH.clear()

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def _remote(fn: Callable, args: tuple) -> tuple:
    return ROOT, fn.__module__, fn.__qualname__, args


def arrow_map(df: DataFrame, fn: Callable, schema: str, *args) -> DataFrame:
    """mapInArrow with a module-level function, found by name on the workers (from --py-files, PYTHONPATH or,
    on one machine, this repository), so that its module's memos live as long as the worker."""
    root, module, name, args = _remote(fn, args)

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        m = importlib.import_module(module)
        yield from getattr(m, name)(batches, *args)
        m.C.trim()

    return df.mapInArrow(run, schema)


def arrow_groups(df: DataFrame, key: str, fn: Callable, schema: str, *args) -> DataFrame:
    """groupBy(key).applyInArrow with a module-level function of a pyarrow Table."""
    root, module, name, args = _remote(fn, args)

    def run(group):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        m = importlib.import_module(module)
        out = getattr(m, name)(group, *args)
        m.C.trim()
        return out

    return df.groupBy(key).applyInArrow(run, schema)


def arrow_pairs(left: DataFrame, right: DataFrame, key: str, fn: Callable, schema: str, *args) -> DataFrame:
    """Cogroup of two frames on key with a module-level function of two pyarrow Tables."""
    root, module, name, args = _remote(fn, args)

    def run(a, b):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        m = importlib.import_module(module)
        out = getattr(m, name)(a, b, *args)
        m.C.trim()
        return out

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(np.asarray(offsets(batch.column(column))))
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class WordHash(dict):
    """Word to the 8 bytes of its hash, little-endian, in memory that stays bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return h


WORD_HASH = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(WORD_HASH.__getitem__, words)), "<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur3, on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbours; empty where there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out ^ hashes[k : k + n]) + np.uint64(k + 1)
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as a width byte, then fixed-width differences: about 6 bytes a key for a block."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string, for rows that travel between stages."""
    import zstandard

    head = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        head.append(a.dtype.str[1:].encode().ljust(4) + np.array([len(a)], "<u8").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*head, *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    out, at = [], 4 + 12 * n
    for i in range(n):
        kind = raw[4 + 12 * i : 8 + 12 * i].strip().decode()
        length = int(np.frombuffer(raw, "<u8", 1, 8 + 12 * i)[0])
        a = np.frombuffer(raw, "<" + kind if kind[0] != "b" else kind, length, at)
        out.append(a)
        at += a.nbytes
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the upper 32 bits, so that ascending keys have ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) is connected to. Large-star and small-star
    rounds on minima, so no node's neighbours are collected; each round is a table in the shared folder."""
    from pyspark.sql import functions as F

    spark = edges.sparkSession
    both = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        # Large star: every larger neighbour of u is tied to the least node around u.
        around = both.select("u", "v").union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = written(small, name)
        # Done when all nodes are leaves of stars: nobody is both above and below an edge, or above two.
        more = after.groupBy("u").count().where("count > 1").limit(1).count() or after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi").limit(1).count()
        if not more:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = after
