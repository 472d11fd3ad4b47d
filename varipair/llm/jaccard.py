"""N-gram Jaccard join with adaptive multi-match prefixes; returns the components of its links.

A document's set is its distinct five-word shingles, as 64-bit hashes. Two sets link at Jaccard >= 0.75.

1. Equal sets are one node, named by a 64-bit hash of the set. Postings of all nodes are dealt by shingle;
   shingles of one node only cannot be shared and are dropped from here on, counted in their node's size.
2. Per node, shared shingles stand in order of document frequency, rarest first. A node of n shingles must share
   ceil(0.75 n), so a link has l common shingles within the first n - ceil(0.75 n) + l of both sides, for any l.
   Each node picks its own l: longer prefixes cost more postings, but ask for l matches before a verification.
   A pair uses the smaller l of the two.
3. Candidates come from the postings of a shingle: first with the most central node that has it (the one with the
   highest mean logarithm of the document frequency over all its shingles: those of its own count 0, so of near
   copies the least edited one is most central), then with one central node of each of several parts, last between all nodes
   that are not yet connected. The last round verifies a pair only after the matches its level asks for; a hub is
   verified after one. So large groups of copies cost one verification a node, not one a pair, and no link that
   decides connectivity is left untested, as the last round counts all matches of a pair. The last join compares bitmaps: each shared shingle flips one
   of 256 bits, so two sets differ in at least as many shingles as their bitmaps differ in bits, and a pair
   that differs too much for the similarity is no candidate.
4. Candidate pairs are verified on their shared shingles; verified links give components by star contraction.

Cases: words are runs of other than space and 0x09-0x0D, A-Z lower-cased; fewer than five words are one shingle;
null or wordless text has an empty set, no links, and its own doc_id as component; rows with null doc_id take
part, and a component's id is its smallest non-null one; repeated rows are linked; an empty table gives no rows;
extra columns are ignored. Two nodes share a 64-bit name with a chance of n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket of shingles or nodes: half as many take less memory of a task and more rows of blocks.
BUCKET_BYTES = 16 << 20
#: Longest multi-match level that is considered, and the cost of verifying a shingle against reading a posting.
LEVELS, VERIFY = 8, 0.05
#: Parts of a posting list that give a hub each, by round.
HUB_PARTS = (4, 16)


def shingle_set(data: bytes, size: int = 5) -> np.ndarray:
    words = data.translate(C.LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(C.hash_windows(C.hash_words(words), min(size, len(words))))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


# ---- 1. postings ---------------------------------------------------------------------------------------------

_POSTS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])


def _postings(batches, n_buckets: int):
    """Per block of texts: a row of document entries, and for each bucket of shingles a row of postings."""
    for part in C.steps(batches, most=BLOCK_BYTES):
        ids, seen, nodes, sizes, sets, names, entry_n = part.column("doc_id"), {}, [], [], [], [], []
        for data in C.texts_of(part.column("text")):
            s = shingle_set(data)
            name = xxhash.xxh3_64_intdigest(s.tobytes())
            names.append(name)
            entry_n.append(len(s))
            if len(s) and name not in seen:
                seen[name] = len(nodes)
                nodes.append(name)
                sizes.append(len(s))
                sets.append(s)
        rows = [("docs", int(names[0] % n_buckets), C.pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.array(entry_n, np.uint32), np.array(names, np.uint64)))]
        if sets:
            keys = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            node_names, node_sizes = np.array(nodes, np.uint64), np.array(sizes, np.uint32)
            for b, lo, hi in C.stretches(C.bucket_of(keys, n_buckets)):
                here, local = np.unique(owner[lo:hi], return_inverse=True)
                local = local.astype(np.uint16 if len(here) < 1 << 16 else np.uint32)
                rows.append(("posts", b, C.pack(np.frombuffer(C.pack_sorted(keys[lo:hi]), np.uint8), local, node_names[here], node_sizes[here])))
        yield C.batch_of(_POSTS, list(map(list, zip(*rows, strict=True))))


_SHARED = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])


def _share(group: pa.Table, n_buckets: int) -> pa.Table:
    """The postings of one bucket of shingles: those of two nodes or more, dealt by node. Document entries pass."""
    kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
    rows = [("docs", 0, d) for k, d in zip(kinds, data, strict=True) if k == "docs"]
    parts = [C.unpack(d) for k, d in zip(kinds, data, strict=True) if k == "posts"]
    if parts:
        bucket = next(b for k, b in zip(kinds, group.column("bucket").to_pylist(), strict=True) if k == "posts")
        keys = np.concatenate([C.unpack_sorted(p[0].tobytes()) for p in parts])
        node = np.concatenate([p[2][p[1]] for p in parts])
        size = np.concatenate([p[3][p[1]] for p in parts])
        order = np.lexsort((node, keys))
        keys, node, size = keys[order], node[order], size[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])
        keys, node, size = keys[once], node[once], size[once]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[starts, len(keys)])
        df = np.repeat(count, count).astype(np.uint32)
        rank = np.repeat(np.cumsum(count > 1), count).astype(np.uint64)
        keep = df > 1
        node, size, df, token = node[keep], size[keep], df[keep], (np.uint64(bucket) << np.uint64(32)) | rank[keep]
        order = np.argsort(node, kind="stable")
        node, size, df, token = node[order], size[order], df[order], token[order]
        for b, lo, hi in C.stretches(C.bucket_of(node, n_buckets)):
            rows.append(("shared", b, C.pack(C.gaps(node[lo:hi]), size[lo:hi], df[lo:hi], token[lo:hi])))
    return pa.table(C.batch_of(_SHARED, list(map(list, zip(*rows, strict=True)))).columns, schema=_SHARED) if rows else _SHARED.empty_table()


def _entries(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])
    for batch in batches:
        for data in batch.column("data").to_pylist():
            ids, null, n, node = C.unpack(data)
            yield C.batch_of(schema, [pa.array(ids, mask=null.astype(bool)), n.astype(np.int64), pa.array(node.view(np.int64), mask=n == 0)])


# ---- 2. prefixes ---------------------------------------------------------------------------------------------

_PREFIX = pa.schema([("kind", pa.string()), ("token", pa.int64()), ("node", pa.int64()), ("pos", pa.int32()), ("layer", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("s", pa.int64()), ("central", pa.float64()), ("data", pa.binary()), *((f"m{k}", pa.int64()) for k in range(4))])
#: The columns of a bitmap.
MARKS = ["m0", "m1", "m2", "m3"]


def choose_level(df: np.ndarray, prefix: int, n: int, most: int) -> int:
    """The l with the least estimated cost: postings read in a prefix longer by l - 1, and verifications of as
    many candidates as the postings can give when each needs l of them."""
    best, at = None, 1
    for level in range(1, min(LEVELS, most) + 1):
        if prefix + level - 1 > len(df):
            break
        read = float(df[: prefix + level - 1].sum())
        cost = read + read / level * VERIFY * n
        if best is None or cost < best:
            best, at = cost, level
    return at


def _prefixes(group: pa.Table, percent: int) -> pa.Table:
    """Per node of the bucket: prefix rows and a row with its shared shingles, unless it can have no partner."""
    parts = [C.unpack(d) for d in group.column("data").to_pylist()]
    node = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    size, df, token = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    order = np.lexsort((token, df, node))
    node, size, df, token = node[order], size[order].astype(np.int64), df[order], token[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    bit = C.mix(token) & np.uint64(255)
    flip = np.uint64(1) << (bit & np.uint64(63))
    marks = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, flip, np.uint64(0)), starts).view(np.int64).tolist() for k in range(4)]
    cols: list[list] = [[] for _ in _PREFIX.names]
    for lo, hi, *bits in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], *marks, strict=True):
        n, shared = int(size[lo]), hi - lo
        spare = n - int(least_overlap(size[lo], percent)) - (n - shared)
        if spare < 0:
            continue
        name, central = int(node[lo : lo + 1].view(np.int64)[0]), float(np.log(df[lo:hi]).sum() / n)
        level = choose_level(df[lo:hi], spare + 1, n, int(least_overlap(size[lo], percent)))
        k = min(spare + level, shared)
        layers = np.maximum(1, np.arange(1, k + 1) - spare)
        for c, v in zip(cols, (["prefix"] * k, token[lo : lo + k].astype(np.int64).tolist(), [name] * k, list(range(1, k + 1)), layers.tolist(), [level] * k, [n] * k, [shared] * k, [central] * k, *([[None] * k] * 5)), strict=True):
            c += v
        for c, v in zip(cols, ("set", None, name, None, None, level, n, shared, central, C.pack_sorted(np.sort(token[lo:hi])), *bits), strict=True):
            c.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(cols, _PREFIX.types, strict=True)], schema=_PREFIX)


# ---- 3. and 4. candidates and links ----------------------------------------------------------------------------


def _verify(batches, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    last: tuple = (None, None)
    for batch in batches:
        out_a, out_b = [], []
        for a, b, n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb")), strict=True):
            if last[0] != a:
                last = a, C.unpack_sorted(x)
            both = len(np.intersect1d(last[1], C.unpack_sorted(y), assume_unique=True))
            if 100 * both >= percent * (n + m - both):
                out_a.append(a)
                out_b.append(b)
        yield C.batch_of(schema, [out_a, out_b])


def _counted(pairs: DataFrame) -> DataFrame:
    """Pairs that meet in as many shingles as the smaller of their levels asks for."""
    return pairs.groupBy("a", "b", "level").agg(F.count("*").alias("k")).where(F.col("k") >= F.col("level")).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that reach the similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("data").alias("xa"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("data").alias("xb"))
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    joined = pairs.join(y, "b").join(x, "a").where(fits).select("a", "b", "na", "nb", "xa", "xb")
    return C.arrow_map(joined, _verify, "a long, b long", percent)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return C.written(_links(pairs.distinct(), sets, percent), "jaccard-links")


def _pairs(left: DataFrame, right: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """Rows of two posting frames that meet in a shingle: nodes a < b and the smaller of their levels.

    A pair shares at most the lesser s, the shared shingles of either side; a bound below the similarity drops it
    in the join. exact: keep only rows that can be one of the first l shingles a linked pair has in common, where
    l is the smaller level: within the l-prefixes, and with enough shingles behind that place on both sides.
    Where both have bitmaps, the bits that differ and the shingles that no other node has bound what they share."""
    rooted, marked = "root" in left.columns, all(c in f.columns for f in (left, right) for c in MARKS)
    r = right.select("token", *[F.col(c).alias(f"_{c}") for c in ("node", "pos", "layer", "level", "n", "s", *(["root"] if rooted else []), *(MARKS if marked else []))])
    most, level, sizes = F.least("s", "_s"), F.least("level", "_level"), percent * (F.col("n") + F.col("_n"))
    meets = (left["token"] == r["token"]) & (F.col("node") != F.col("_node")) & ((100 + percent) * most >= sizes)
    if rooted:
        meets &= F.col("root") != F.col("_root")
    if exact:
        meets &= (F.col("node") < F.col("_node")) & (F.col("layer") <= level) & (F.col("_layer") <= level)
        meets &= (100 + percent) * (level + F.least(F.col("s") - F.col("pos"), F.col("_s") - F.col("_pos"))) >= sizes
    if marked:
        apart = F.col("n") - F.col("s") + F.col("_n") - F.col("_s")
        for c in MARKS:
            apart += F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}")))
        meets &= (100 + percent) * (F.col("n") + F.col("_n") - apart) >= 2 * sizes
    return left.join(r, meets).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"), level.alias("level"))


def _central(posts: DataFrame, *keys) -> DataFrame:
    """One row per shingle (and part): its most central node. Maxima are taken before the shuffle."""
    top = posts.groupBy("token", *keys).agg(F.max(F.struct("central", "node", "pos", "layer", "level", "n", "s", *(["root"] if "root" in posts.columns else []))).alias("t"))
    return top.select("token", "t.*")


def _forest(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _rooted(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """posts of shingles whose nodes are in several components, with root."""
    named = posts.join(roots.withColumnRenamed("root", "_r"), "node", "left").withColumn("root", F.coalesce("_r", "node")).drop("_r")
    split = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return named.join(split, "token", "left_semi")


def link_components(docs: DataFrame, percent: int = 75, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    n = C.parts_of(spark, C.text_bytes(docs), bucket_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posts = C.arrow_map(rows, _postings, "kind string, bucket int, data binary", n)
    shared = C.written(C.arrow_groups(posts, "bucket", _share, "kind string, bucket int, data binary", n), "jaccard-shared", partition_by="kind")
    prefix = C.written(C.arrow_groups(shared.where("kind = 'shared'"), "bucket", _prefixes, "kind string, token long, node long, pos int, layer int, level int, n long, s long, central double, data binary, m0 long, m1 long, m2 long, m3 long", percent), "jaccard-prefix", partition_by="kind")
    postings = prefix.where("kind = 'prefix'").select("token", "node", "pos", "layer", "level", "n", "s", "central")
    sets = prefix.where("kind = 'set'").select("node", "n", "data")

    # Hub rounds: each node with the most central node of its shingles' lists, then of each part of the lists.
    # A hub stands for its list, so it is verified after one match; lists in one component are done.
    roots = C.components(_linked(_pairs(postings, _central(postings), percent).select("a", "b"), sets, percent))
    for parts in HUB_PARTS:
        again = _rooted(postings, roots)
        hubs = _central(again.withColumn("part", F.pmod(F.xxhash64("node", F.lit(parts)), F.lit(parts))), "part")
        # What a round has joined is kept as a forest: one edge for each node but the roots.
        links = _forest(roots).union(_linked(_pairs(again, hubs, percent).select("a", "b"), sets, percent))
        roots = C.components(links)
    # Last: all nodes of a list that are not connected, with as many matches as their levels ask for.
    rest = _rooted(postings, roots).join(prefix.where("kind = 'set'").select("node", *MARKS), "node")
    roots = C.components(_forest(roots).union(_linked(_counted(_pairs(rest, rest, percent, exact=True)), sets, percent)))

    entries = C.arrow_map(shared.where("kind = 'docs'").select("data"), _entries, "doc_id long, n_shingles long, node long")
    classes = entries.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = classes.select("node", "root").join(named, "root").select("node", "component_id")
    return entries.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, with one row of each component: that with the smallest doc_id (null last), of
    several texts under it the one with the least key, of equal rows any one. Rows without words have no links and
    all stay. The verdict is on (doc_id, key), where key is a 64-bit hash of doc_id and text, so rows that only share
    a doc_id, null too, do not share it."""
    k, d, other, other_d, times = (C.free_name(docs.columns, x) for x in ("_key", "_doc", "_lesser", "_lesser_doc", "_times"))
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    rows = docs.select(key.alias(k), docs["doc_id"].cast("long").alias(d), docs["text"].cast("string").alias("text"))
    # Beside the other stages of a pipeline memory is short, and what quality rules left is less to shuffle.
    linked = link_components(rows.select(F.col(k).alias("doc_id"), "text"), percent, BUCKET_BYTES // 2).where("n_shingles > 0")
    of_key = linked.groupBy(F.col("doc_id").alias(k)).agg(F.min("component_id").alias("component"), F.count("*").alias(times))
    seen = C.written(of_key.join(rows.groupBy(k).agg(F.min(d).alias(d)), k), "jaccard-keys")
    first = seen.groupBy("component").agg(F.min(F.struct(F.col(d).isNull().alias("no_id"), d, k)).alias("t")).select(F.col(f"t.{k}").alias(k))
    lesser = seen.join(first, k, "left_anti").select(F.col(k).alias(other), F.col(d).alias(other_d))
    many = seen.where(F.col(times) > 1).join(first, k, "left_semi").select(k)
    kept = docs.withColumn(k, key).join(lesser, (F.col(k) == F.col(other)) & docs["doc_id"].cast("long").eqNullSafe(F.col(other_d)), "left_anti")
    one = kept.join(many, k, "left_semi").dropDuplicates([k])
    return kept.join(many, k, "left_anti").unionByName(one).drop(k)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(C.table(spark, sf_dir, "documents"))


#: DuckDB SQL for op4.
SQL4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
