"""Benchmark decontamination by size-partitioned MinHash containment. DataFrame functions only.

An item of q distinct five-word shingles leaks into a document that holds at least need = ceil(0.75 q) of them.
A document that does misses at most q - need of the item's shingles, so it holds one of any q - need + 1 of them:
of the bottom-k MinHash sketch with k = q - need + 1 smallest hashes. Items are partitioned by size (powers of two of q).
A class has a bound, the greatest hash in its items' sketches: about the k-th of q parts of the hash range. A document is
sketched for the classes whose items may be in it (its shingles reach their least need): the hashes up to a class's bound,
cut in the row, so that only they become rows. A shared sketch value of an item that is not too large makes a candidate
pair, with recall 1; exact containment on the shingles themselves then decides.

Words are runs of other than space and 0x09-0x0D, A-Z lower-cased; with fewer than five words the whole sequence
is the one shingle; without words there is none and nothing matches.

Cases: items are told apart by (item_id, text), null ids too; null text has no words; rows of one doc_id (null too) and one text are one document; an empty table gives no
pairs; extra columns are ignored in the search and kept by the filter. Benchmark sketches are broadcast only if
counted and small; otherwise both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Sketch rows that may be broadcast, 16 bytes each.
BROADCAST_ROWS = 1_000_000
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL)
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable, which the optimiser does not copy."""
    return F.transform(F.array(value), body)[0]


def shingles(w: Column, size: int = 5) -> Column:
    """The runs of `size` words, joined by spaces; fewer words are one run."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(runs)


def hashes(text: Column, size: int = 5) -> Column:
    """64-bit hashes of the distinct shingles of a text."""
    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(w))).otherwise(runs)

    return F.array_distinct(_bound(words(text), of))


def _items(items: DataFrame) -> DataFrame:
    """Distinct items: the struct `item` of item_id and a hash of the text, and the text."""
    return items.select(F.struct("item_id", F.xxhash64("text").alias("of_text")).alias("item"), F.col("text").alias("item_text")).dropDuplicates(["item"])


def sketches(items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """item, its text, q, need and the k smallest hashes of each item, one row each."""
    sized = items.select("item", "item_text", hashes(F.col("item_text")).alias("h")).withColumn("q", F.size("h").cast("long"))
    sized = sized.where("q > 0").withColumn("need", F.ceil(F.col("q") * threshold).cast("long"))
    return sized.select("item", "item_text", "q", "need", F.explode(F.slice(F.array_sort("h"), F.lit(1), (F.col("q") - F.col("need") + 1).cast("int"))).alias("h"))


def size_classes(sketch: DataFrame) -> list[tuple[int, int]]:
    """(least need, bound) of each class of items by size; at most 64 rows come to the driver."""
    rows = sketch.groupBy(F.floor(F.log2("q")).alias("size")).agg(F.min("need").alias("need"), F.max("h").alias("bound")).collect()
    return sorted((r["need"], r["bound"]) for r in rows)


def sketched(hs: Column, classes: list[tuple[int, int]]) -> Column:
    """The hashes of a document that may meet a sketch of some class."""
    n = F.size(hs)
    # The greatest bound of the classes that the document can hold; null, and so nothing, if there are none.
    bound = F.greatest(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), *[F.when(n >= need, F.lit(top).cast("bigint")) for need, top in classes])
    return F.filter(hs, lambda h: h <= bound)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs with containment >= threshold: doc_id, text_hash, item_id, n_item_shingles, n_shared, containment.
    Items of one item_id (null too) with several texts are searched one by one and have a row each."""
    items = _items(items)
    sketch = sketches(items, threshold)
    small = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sized = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    classes = size_classes(sketch)
    rows = texts.select("doc_id", "text_hash", hashes(F.col("text")).alias("hs")).select("doc_id", "text_hash", F.size("hs").alias("n"), F.explode(_bound(F.col("hs"), lambda hs: sketched(hs, classes))).alias("h"))
    found = rows.join(sized(sketch.select("item", "need", "h")), "h").where("n >= need")
    pairs = found.groupBy("doc_id", "text_hash", "item").agg(F.lit(1).alias("one")).drop("one")
    return verified(texts, items, pairs, threshold)


def verified(texts: DataFrame, items: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs whose exact containment reaches the threshold. Only candidates' texts are cut again."""
    wanted = pairs.groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("items"))
    cut = lambda text: F.array_distinct(_bound(words(text), lambda w: shingles(w)))
    w = wanted.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    held = texts.join(w, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_t"))).dropDuplicates(["doc_id", "text_hash"])
    have = held.select("doc_id", "text_hash", F.explode("items").alias("item"), cut(F.col("text")).alias("have"))
    need = items.select(F.col("item").alias("_i"), cut(F.col("item_text")).alias("want"))
    both = have.join(need, F.col("item.of_text").eqNullSafe(F.col("_i.of_text")) & F.col("item.item_id").eqNullSafe(F.col("_i.item_id")))
    shared = both.select("doc_id", "text_hash", F.col("item.item_id").alias("item_id"), F.size("want").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("want", "have")).cast("long").alias("n_shared"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).where(F.col("n_shared") >= F.ceil(F.col("n_item_shingles") * threshold))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of docs, all columns, that no item leaks into."""
    d, t = (C.free_name(docs.columns, x) for x in ("_leak_doc", "_leak_text"))
    leaks = find_leaks(docs, items, threshold).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col(t)), "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("text_hash")


#: DuckDB SQL for op9.
_CUT = """SELECT DISTINCT {id} AS id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
        WHERE len(w) > 0)"""
SQL9 = f"""
WITH d AS ({_CUT.format(id="doc_id", table="documents")}),
b AS ({_CUT.format(id="item", table="(SELECT DISTINCT {'id': item_id, 'of': text} AS item, text FROM benchmark)")}),
q AS (SELECT id, count(*) AS q FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item, count(*) AS n FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item.id AS item_id, q AS n_item_shingles, n AS n_shared, n / q AS containment
FROM m JOIN q ON q.id = item WHERE 4 * n >= 3 * q
"""
