"""A cache of model responses as a data source: `spark.read.format("response_cache")`, written in two phases.

Records have a key (question_id, condition), a configuration, the digest of the prompt and the response. They lie in
buckets of the question_id, below a folder for their configuration, as Parquet files of the tasks that wrote them. A write
is one batch of records: tasks write files that no reader looks at, and send back their names; only when all have ended
the driver publishes the names in one small file, by a rename. So a reader sees all of a write or nothing, a task that is lost
or stopped leaves nothing visible, and a write that fails deletes what its tasks had written (`vacuum`: what lost executors
left). A record that holds a secret ends the write before a byte of it is stored.

A later write of a key replaces the earlier one; of one write, the record with the greatest response. A filter on question_id
by equality or IN reads only the buckets of those keys.

Options: path (a URI that all executors reach), config_hash, buckets (when the folder is made; 64), secrets (a JSON list;
only for writes).
"""

from __future__ import annotations

import json
import re
import sys
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

# Workers get the classes by value and need not import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: version of the record layout.
CACHE_SCHEMA = "phase2a_cache_v1"
FIELDS = ("question_id", "condition", "cache_schema", "config_hash", "prompt_version", "prompt_sha256", "prompt", "response")
SCHEMA = ", ".join(f"{name} string" for name in FIELDS)
#: Requests up to this number are looked up by their keys, more by a join with the whole cache.
FEW_KEYS = 1_000


class CacheIncompatible(RuntimeError):
    pass


class SecretFound(RuntimeError):
    pass


def bucket_of(question_id: str | None, buckets: int) -> int:
    return zlib.crc32((question_id or "").encode()) % buckets


class Store:
    """Paths and files of one configuration's folder."""

    def __init__(self, options: dict[str, str]):
        self.config_hash = options["config_hash"]
        folder = self.config_hash[:16]
        if not re.fullmatch(r"[A-Za-z0-9_-]+", folder):
            raise ValueError("a configuration hash names a folder: letters, digits, - and _")
        self.fs, root = pafs.FileSystem.from_uri(options["path"])
        self.root, self.wanted = f"{root.rstrip('/')}/{folder}", int(options.get("buckets", 64))

    def _names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(x.base_name for x in found if x.is_file and not x.base_name.startswith("."))

    def _read(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def publish(self, name: str, content: dict) -> None:
        """A file that appears whole, by a rename."""
        folder, _, base = f"{self.root}/{name}".rpartition("/")
        self.fs.create_dir(folder)
        with self.fs.open_output_stream(f"{folder}/.{base}") as f:
            f.write(json.dumps(content).encode())
        self.fs.move(f"{folder}/.{base}", f"{folder}/{base}")

    def buckets(self, make: bool = False) -> int:
        """The number of buckets, fixed when the folder is made."""
        if not self._names("meta"):
            if not make:
                return self.wanted
            self.publish(f"meta/{time.time_ns():020d}-{uuid.uuid4().hex}.json", {"buckets": self.wanted})
        return self._read(f"meta/{self._names('meta')[0]}")["buckets"]

    def files(self) -> list[tuple[int, str, str]]:
        """(bucket, commit, path) of all published files."""
        return [(b, name, path) for name in self._names("commits") for b, path in self._read(f"commits/{name}")["files"]]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]
    rows: int


class CacheWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options, self.write_id = options, uuid.uuid4().hex
        self.count = Store(options).buckets(make=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows go to one file per bucket as they come; what a failing task has written it deletes itself."""
        store, secrets = Store(self.options), [x for x in json.loads(self.options.get("secrets", "[]")) if x]
        open_files: dict[int, tuple[str, pq.ParquetWriter]] = {}
        rows = 0
        try:
            for batch in iterator:
                self._check(batch, store, secrets)
                table = pa.Table.from_batches([batch]).select(list(FIELDS))
                where = pa.array([bucket_of(x, self.count) for x in table.column("question_id").to_pylist()], pa.int32())
                for b in pc.unique(where).to_pylist():
                    if b not in open_files:
                        path = f"data/bucket={b:05d}/{self.write_id}-{uuid.uuid4().hex}.parquet"
                        store.fs.create_dir(f"{store.root}/{path}".rpartition("/")[0])
                        open_files[b] = path, pq.ParquetWriter(f"{store.root}/{path}", table.schema, filesystem=store.fs, compression="zstd")
                    open_files[b][1].write_table(table.filter(pc.equal(where, b)))
                rows += batch.num_rows
            for _, writer in open_files.values():
                writer.close()
        except BaseException:
            for path, writer in open_files.values():
                writer.close()
                if store.fs.get_file_info(f"{store.root}/{path}").is_file:
                    store.fs.delete_file(f"{store.root}/{path}")
            raise
        return Written([(b, path) for b, (path, _) in open_files.items()], rows)

    @staticmethod
    def _check(batch: pa.RecordBatch, store: Store, secrets: list[str]) -> None:
        for column in batch.columns:
            for secret in secrets:
                if pc.any(pc.match_substring(column.cast(pa.string()), secret)).as_py():
                    raise SecretFound("secret value found in response record - refusing to write")
        if pc.any(pc.not_equal(pc.fill_null(batch.column("config_hash"), ""), store.config_hash)).as_py():
            raise CacheIncompatible("record of another configuration")

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if files:
            Store(self.options).publish(f"commits/{time.time_ns():020d}-{uuid.uuid4().hex}.json", {"files": files})

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what this write's tasks have left, those that were killed too."""
        store = Store(self.options)
        for x in store.fs.get_file_info(pafs.FileSelector(f"{store.root}/data", recursive=True, allow_not_found=True)):
            if x.is_file and x.base_name.startswith(self.write_id):
                store.fs.delete_file(x.path)


class Bucket(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class CacheReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.keys = options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("question_id",):
                keys = set(f.value if isinstance(f, In) else [f.value])
                self.keys = keys if self.keys is None else self.keys & keys
            yield f  # Spark filters the rows of a bucket

    def partitions(self) -> list[Bucket]:
        store, by = Store(self.options), {}
        count = store.buckets()
        wanted = None if self.keys is None else {bucket_of(k, count) for k in self.keys}
        for b, commit, path in store.files():
            if wanted is None or b in wanted:
                by.setdefault(b, []).append((commit, path))
        return [Bucket(files) for _, files in sorted(by.items())] or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        """The last record of each key. A bucket is in memory once; their number follows from the cache's size."""
        store, tables = Store(self.options), []
        for n, (_, path) in enumerate(sorted(partition.files)):
            t = pq.read_table(f"{store.root}/{path}", filesystem=store.fs, partitioning=None)
            tables.append(t.append_column("_n", pa.array([n] * t.num_rows, pa.int32())))
        if not tables:
            return
        # The commits' names sort by time; files of one commit count as one.
        commits = sorted({c for c, _ in partition.files})
        at = {n: commits.index(c) for n, (c, _) in enumerate(sorted(partition.files))}
        table = pa.concat_tables(tables)
        table = table.set_column(table.num_columns - 1, "_n", pa.array([at[n] for n in table.column("_n").to_pylist()], pa.int32()))
        order = pc.sort_indices(table, sort_keys=[("question_id", "ascending"), ("condition", "ascending"), ("_n", "descending"), ("response", "descending")])
        table, last = table.take(order), None
        keep = []
        for key in zip(table.column("question_id").to_pylist(), table.column("condition").to_pylist(), strict=True):
            keep.append(key != last)
            last = key
        yield from table.filter(pa.array(keep)).select(list(FIELDS)).combine_chunks().to_batches(max_chunksize=10_000)


def vacuum(path: str, config_hash: str, older_than_s: float = 86_400) -> int:
    """Delete files that no commit names and that are older than any running write: what lost executors left."""
    store = Store({"path": path, "config_hash": config_hash})
    live = {p for _, _, p in store.files()}
    found = store.fs.get_file_info(pafs.FileSelector(f"{store.root}/data", recursive=True, allow_not_found=True))
    dead = [x.path for x in found if x.is_file and x.path.removeprefix(f"{store.root}/") not in live and x.mtime_ns / 1e9 < time.time() - older_than_s]
    for x in dead:
        store.fs.delete_file(x)
    return len(dead)


class ResponseCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "response_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CacheReader:
        return CacheReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CacheWriter:
        if overwrite:
            raise ValueError("the cache is appended to; a later write of a key replaces the earlier one")
        return CacheWriter(dict(self.options))


def _options(spark: SparkSession, path: str, config_hash: str) -> dict[str, str]:
    spark.dataSource.register(ResponseCache)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return {"path": path, "config_hash": config_hash}


def put(responses: DataFrame, path: str, config_hash: str, secrets: list[str] = (), buckets: int = 64) -> None:
    """responses (question_id, condition, prompt_version, prompt, response) into the cache, all or nothing."""
    text = lambda name: F.col(name).cast("string").alias(name)
    rows = responses.select(text("question_id"), text("condition"), F.lit(CACHE_SCHEMA).alias("cache_schema"), F.lit(config_hash).alias("config_hash"), text("prompt_version"), F.sha2(text("prompt"), 256).alias("prompt_sha256"), text("prompt"), text("response"))
    rows.write.format("response_cache").options(**_options(responses.sparkSession, path, config_hash), buckets=buckets, secrets=json.dumps(list(secrets))).mode("append").save()


def cached(spark: SparkSession, path: str, config_hash: str) -> DataFrame:
    return spark.read.format("response_cache").options(**_options(spark, path, config_hash)).load()


def lookup(requests: DataFrame, path: str, config_hash: str) -> DataFrame:
    """requests (question_id, condition, prompt, ...) with `response`, null if there is none. A record of another
    configuration, layout or prompt, null ones too, fails the job. Few requests read only the buckets of their keys."""
    spark = requests.sparkSession
    have = cached(spark, path, config_hash)
    few = requests.select(F.col("question_id").cast("string")).distinct().limit(FEW_KEYS + 1).collect()
    if len(few) <= FEW_KEYS:
        have = have.where(F.col("question_id").isin([r[0] for r in few if r[0] is not None]))
    have = have.select(F.col("question_id").alias("_q"), F.col("condition").alias("_c"), F.struct("config_hash", "cache_schema", "prompt_sha256", "response").alias("_r"))
    j = requests.join(have, (F.col("question_id").cast("string") == F.col("_q")) & F.col("condition").cast("string").eqNullSafe(F.col("_c")), "left")
    other = ~(F.col("_r.config_hash").eqNullSafe(F.lit(config_hash)) & F.col("_r.cache_schema").eqNullSafe(F.lit(CACHE_SCHEMA)))
    changed = ~F.col("_r.prompt_sha256").eqNullSafe(F.sha2(F.col("prompt").cast("string"), 256))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"CacheIncompatible: {why}: "), "_q", F.lit("/"), F.coalesce("_c", F.lit("")))).cast("string")
    response = F.when(F.col("_r").isNull(), None).when(other, fail("produced under a different configuration")).when(changed, fail("rendered prompt changed under the same version")).otherwise(F.col("_r.response"))
    return j.withColumn("response", response).drop("_q", "_c", "_r")
