"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A store of runs tells in how many documents each line key stands. A run is a table of (h, g, n): 128 bits of a key in
two columns and the number of documents, in buckets of both, sorted by them. A batch of documents is counted, loses by a
merge anti-join the keys that a run already proves common (n >= min_docs: more sightings decide nothing), and adds what
is left as a run of level 0. When a level has `fanout` runs they are merged into one of the next level. Runs lie in
buckets, so neither the anti-join nor a merge moves their rows.

A key is the line without space and 0x09-0x0D at both ends, A-Z lower-cased. Keys of at least one code point in at
least min_docs documents lose all their lines in every document.

Cases: null or empty text is one empty line, which has no key and stays; each row is a document, so rows of one doc_id
(null too) and repeated rows count each and get a row each; a line that a document repeats counts once for it and is
dropped everywhere in it; an empty table gives no rows; extra columns are ignored. A text is in memory once, with its
lines; a line that a third of all documents hold is one row of each task's partial counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Common keys that may be broadcast, 16 bytes each.
BROADCAST_ROWS = 1_000_000
#: Copies of each common key where they are not broadcast; a hot line's rows go to as many tasks.
SALTS = 32
BLANKS = " \t\n\x0b\x0c\r"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text that one batch of the store counts, and the fewest batches of a corpus.
BATCH_BYTES, LEAST_BATCHES = 1 << 40, 4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """For each line struct(h, g) of its key; null for a line without one."""
    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(BLANKS))
        return F.when(k != "", F.struct(F.xxhash64(F.lit(1), k).alias("h"), F.xxhash64(F.lit(2), k).alias("g")))

    return F.transform(lines_of(F.translate(text, UPPER, SMALL)), key)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t1 and t2 (128 bits of the text), the keys of its lines and the number of such rows. Equal rows become
    one, on the map side first, so that copies of one row meet in no task."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), line_keys(text).alias("keys"))
    return rows.groupBy("doc_id", "t1", "t2").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"))


class LineRuns:
    """The store. Batches are frames with `keys` (array of struct(h, g), null for none) and `copies`."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or C.shuffle_partitions(spark)
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{C.shared_dir(self.spark)}/{name}"
        rows.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            C.remove(self.spark, f"{C.shared_dir(self.spark)}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one, by full outer merge joins of neighbours."""
        tables = [self.spark.table(name) for name in names]
        while len(tables) > 1:
            pairs = [tables[i : i + 2] for i in range(0, len(tables), 2)]
            tables = [_merge(*p) if len(p) == 2 else p[0] for p in pairs]
        return tables[0]

    def add(self, batch: DataFrame) -> None:
        """Count a batch, leave out what is known to be common, add the rest as a run; merge full levels."""
        seen = batch.select("copies", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k"))
        fresh = seen.groupBy(F.col("k.h").alias("h"), F.col("k.g").alias("g")).agg(F.sum("copies").alias("n"))
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).where(F.col("n") >= self.min_docs).select("h", "g"), ["h", "g"], "left_anti")
        self._write(fresh, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                full = self.levels[level]
                self._write(self._merged(full), level + 1)
                self.levels[level] = []
                self._drop(full)

    def common(self) -> DataFrame:
        """(h, g) of the keys in at least min_docs documents."""
        if not self.runs():
            return self.spark.createDataFrame([], "h long, g long")
        return self._merged(self.runs()).where(F.col("n") >= self.min_docs).select("h", "g")

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), ["h", "g"], "full")
    return both.select("h", "g", (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("n"))


def common_lines(keys: DataFrame, batches: int, min_docs: int = 10, fanout: int = 2) -> DataFrame:
    """The common keys of a written table of `keyed` rows with a column `batch`, as a written table."""
    store = LineRuns(keys.sparkSession, min_docs, fanout)
    for b in range(batches):
        store.add(keys.where(F.col("batch") == b))
    common = C.written(store.common(), "common-lines")
    store.close()
    return common


def dropped_places(keys: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, t1, t2 and the places (from 0) of the lines that go; only documents that lose one."""
    at = keys.select("doc_id", "t1", "t2", F.posexplode("keys").alias("pos", "k")).where("k IS NOT NULL").select("doc_id", "t1", "t2", "pos", F.col("k.h").alias("h"), F.col("k.g").alias("g"))
    if common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = at.join(F.broadcast(common), ["h", "g"], "left_semi")
    else:
        salted = common.select("h", "g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hit = at.withColumn("salt", F.pmod(F.xxhash64("t1", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"], "left_semi")
    return hit.groupBy("doc_id", "t1", "t2").agg(F.collect_list("pos").alias("gone"))


def kept_lines(docs: DataFrame, min_docs: int = 10, fanout: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped and `kept`, the text of the lines that stay, for each row of docs."""
    spark = docs.sparkSession
    batches = max(LEAST_BATCHES, -(-C.text_bytes(docs) // BATCH_BYTES))
    keys = C.written(keyed(docs).withColumn("batch", F.pmod(F.xxhash64("t1", "doc_id"), F.lit(batches)).cast("int")), "line-keys", partition_by="batch")
    gone = dropped_places(keys, common_lines(keys, batches, min_docs, fanout)).withColumnsRenamed({"doc_id": "_d", "t1": "_t1", "t2": "_t2"})
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    # array_except works by a hash set, so a text of many lines takes time in proportion to them.
    stay = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(lines_of(F.col("text"))), stay)[0])
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return both.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_lines(C.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for op11.
SQL11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT r, doc_id, i, w[i] AS line, translate(trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (
  SELECT r, doc_id, count(*) AS n_lines, count(c.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
  FROM l LEFT JOIN c ON l.k = c.k GROUP BY r, doc_id)
"""
