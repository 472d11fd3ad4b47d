"""Overlap of texts: exact, contained, near; and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .ordered import running


def exact_overlap(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Shared normalised texts and how many rows of each side have one. Both sides are counted by key first."""
    side = lambda df, n: df.select(key(F.col("text")).alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias(n))
    j = side(a, "na").join(side(b, "nb"), "k")
    return j.agg(F.count("*").alias("shared_keys"), F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"))


def contained_phrases(docs: DataFrame, items: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, item_id) where the item's normalised text stands in the document's. An equi-join on a hash of the item's
    first `width` words finds places; only those are compared. Shorter items use all of their words."""
    it = items.select("item_id", T.norm_words(F.col("text")).alias("needle")).where("needle <> ''").withColumn("w", F.split("needle", " "))
    it = it.withColumn("len", F.least(F.size("w"), F.lit(width))).withColumn("head", F.xxhash64(F.slice("w", F.lit(1), F.col("len"))))
    lens = [r[0] for r in it.select("len").distinct().collect()]  # at most `width` numbers
    d = docs.select("doc_id", T.norm_words(F.col("text")).alias("hay"))

    def runs(w, n):
        return F.transform(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: i + n - 1 <= F.size(w)), lambda i: F.xxhash64(F.slice(w, i, n)))

    def heads(w):
        return F.array_distinct(F.concat(*[runs(w, n) for n in lens])) if lens else F.array().cast("array<bigint>")

    # The words are a lambda's variable, so that they are cut once.
    found = d.select("doc_id", F.explode(F.transform(F.array(F.split("hay", " ")), heads)[0]).alias("head"))
    pairs = found.join(it.select("item_id", "needle", "head"), "head").select("doc_id", "item_id", "needle").distinct()
    return pairs.join(d, "doc_id").where(T.contains_words(F.col("hay"), F.col("needle"))).select("doc_id", "item_id")


def _word_sets(df: DataFrame, *keys: str, least_chars: int) -> DataFrame:
    """keys, `_k` (a digest of the normalised text), `_row` and `_w`, the set of words as 64-bit hashes whose last bit says
    whether the word has least_chars. Texts without words are left out. Stored, so that texts are normalised once."""
    d = df.select(*keys, T.norm_words(F.col("text")).alias("_k"))
    hashed = lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(x) >= least_chars).cast("long"))
    w = F.transform(F.array_distinct(F.split("_k", " ")), hashed)
    # A filter before this would normalise each text twice.
    return written(d.select(*keys, F.sha2("_k", 256).alias("_k"), F.monotonically_increasing_id().alias("_row"), w.alias("_w")), "overlap-sets").where("_k <> sha2('', 256)")


def _long_words(sets: DataFrame, *keys: str) -> DataFrame:
    return sets.select(*keys, F.explode(F.filter("_w", lambda x: x.bitwiseAND(F.lit(1)) == 1)).alias("t"))


#: Longs of a bitmap.
MARKS = 8


def _sketches(sets: DataFrame, key: str, name: str) -> DataFrame:
    """A row for each text: key, and as a struct its number of words and a bitmap in which each word flips one of 512 bits."""
    mark = "coalesce(bit_xor(CASE WHEN (shiftright(h, 7) & 7) = {0} THEN shiftleft(1L, CAST(shiftright(h, 1) & 63 AS INT)) END), 0L) AS m{0}"
    each = sets.select("_row", key, F.size("_w").alias("n"), F.explode("_w").alias("h")).groupBy("_row", key, "n").agg(*[F.expr(mark.format(k)) for k in range(MARKS)])
    return each.select(key, F.struct("n", *[f"m{k}" for k in range(MARKS)]).alias(name))


def _bounded(pairs: DataFrame, x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """The pairs (their first key that of x, their second that of y) that can reach the threshold: sets differ in as many words
    as their bitmaps in bits at least, and few pairs are left by that bound."""
    a, b = x.columns[0], y.columns[0]
    both, apart = F.col("_x.n") + F.col("_y.n"), sum((F.bit_count(F.col(f"_x.m{k}").bitwiseXOR(F.col(f"_y.m{k}"))) for k in range(MARKS)), F.greatest("_x.n", "_y.n") * 0)
    apart = F.greatest(apart, F.abs(F.col("_x.n") - F.col("_y.n")))
    # A margin for rounding; the similarity itself decides.
    may = both - apart >= (both + apart) * (threshold - 1e-9)
    return pairs.join(_sketches(x, a, "_x"), a).join(_sketches(y, b, "_y"), b).where(may).select(*pairs.columns)


def _alike(pairs: DataFrame, x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """pairs with `jaccard`, of those that reach the threshold. Only those that bitmaps leave meet the words."""
    a, b = x.columns[0], y.columns[0]
    near = _bounded(pairs, x, y, threshold).distinct()
    j = near.join(x.select(a, F.col("_w").alias("_a")), a).join(y.select(b, F.col("_w").alias("_b")), b)
    return j.withColumn("jaccard", T.jaccard(F.col("_a"), F.col("_b"))).where(F.col("jaccard") >= threshold).select(*pairs.columns, "jaccard")


def near_duplicates(a: DataFrame, threshold: float = 0.85, rare: int = 8, least_chars: int = 5) -> DataFrame:
    """Pairs within a group whose word sets reach the threshold and share a rare word (in at most `rare` texts of the
    group). Blocks have at most `rare` members, so a block gives at most rare * (rare - 1) / 2 pairs."""
    d = _word_sets(a, "grp", "id", least_chars=least_chars)
    tokens = _long_words(d, "grp", "id")
    blocks = tokens.groupBy("grp", "t").agg(F.count("*").alias("df")).where(F.col("df").between(2, rare)).select("grp", "t")
    small = tokens.join(blocks, ["grp", "t"])
    # A block's members are few, so they are put together and not joined with themselves.
    of = small.groupBy("grp", "t").agg(F.collect_list("id").alias("ids")).select("grp", "ids", F.explode("ids").alias("id"))
    pairs = of.select("grp", "id", F.explode("ids").alias("id2")).where("id < id2").distinct()
    return _alike(pairs, d.select("id", "_row", "_w"), d.select(F.col("id").alias("id2"), "_row", "_w"), threshold)


#: Words of the greatest frequency, a fixed number, whose order is held beside each text and needs no shuffle.
FREQUENT = 4096


def _prefixes(sets: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """(_node, n, t, after) of the texts in heads: words from the rare end of one order of all words, as many as leave fewer
    behind than a set alike to it must share, and how many words stand after each. Two sets that are alike have one of these
    in common. First in the order are words that one side alone has; they count, but have no rows."""
    counts = sets.select(F.explode("_w").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    often = [r[0] for r in counts.orderBy(F.desc("df"), F.desc("t")).limit(FREQUENT).collect()][::-1]

    def cut(batches):
        """The words of each set that are not frequent, and as many frequent ones in order as a prefix can have."""
        import numpy as np
        import pyarrow as pa

        order = np.argsort(np.array(often, np.int64))
        known = np.array(often, np.int64)[order]
        lists = lambda n, v: pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), v)
        for batch in batches:
            w = batch.column("_w")
            n, v = w.value_lengths().to_numpy().astype(np.int64), w.flatten().to_numpy()
            owner, at = np.repeat(np.arange(len(n)), n), np.minimum(np.searchsorted(known, v), len(known) - 1)
            hit = known[at] == v
            few = n - np.bincount(owner[hit], minlength=len(n))
            by = np.lexsort((order[at[hit]], owner[hit]))
            own, words = owner[hit][by], v[hit][by]
            keep = np.arange(len(own)) - np.searchsorted(own, own) < (n - np.ceil(n * (threshold - 1e-9)) + 1 - few)[own]
            columns = [batch.column("_node"), n.astype(np.int32), lists(few, v[~hit]), lists(np.bincount(own[keep], minlength=len(n)), words[keep])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_node", "n", "_few", "_often"])

    each = sets.select("_node", "_w").mapInArrow(cut, "_node long, n int, _few array<bigint>, _often array<bigint>")
    word, side = Window.partitionBy("t"), F.col("_node") % 2
    seen = each.select("_node", F.explode("_few").alias("t")).select("_node", "t", F.count("*").over(word).cast("int").alias("df"), F.min(side).over(word).alias("lo"), F.max(side).over(word).alias("hi"))
    shared = seen.where("lo <> hi").groupBy("_node").agg(F.sort_array(F.collect_list(F.struct("df", "t")))["t"].alias("_shared"))
    of_head = each.select("_node", "n", F.size("_few").alias("_light"), "_often").join(heads, "_node", "left_semi").join(shared, "_node", "left")
    of_head = of_head.withColumn("_shared", F.coalesce("_shared", F.array().cast("array<bigint>"))).withColumn("_alone", F.col("_light") - F.size("_shared"))
    room = F.greatest((F.col("n") - F.ceil(F.col("n") * (threshold - 1e-9)) + 1 - F.col("_alone")).cast("int"), F.lit(0))
    rows = of_head.select("_node", "n", "_alone", F.posexplode(F.slice(F.concat("_shared", "_often"), F.lit(1), room)).alias("k", "t"))
    return rows.select("_node", "n", "t", (F.col("n") - F.col("_alone") - F.col("k") - 1).alias("after"))


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(_a, _b, jaccard) of the pairs (_a, _b, t) that reach the threshold. Pairs are dealt by t, and each set of words goes once to
    each t that it has pairs under, ahead of them, not once to each pair."""
    nodes = pairs.select("t", F.explode(F.array("_a", "_b")).alias("_a")).distinct().join(sets.select(F.col("_node").alias("_a"), "_w"), "_a")
    rows = nodes.select("t", "_a", F.lit(None).cast("long").alias("_b"), "_w").union(pairs.select("t", "_a", "_b", F.lit(None).cast("array<bigint>")))

    def compare(batches):
        import pyarrow as pa

        now, have = None, {}
        for batch in batches:
            out = [], [], []
            words = batch.column("_w")
            for k, (t, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "_a", "_b")), strict=True)):
                if t != now:
                    now, have = t, {}
                if b is None:
                    have[a] = frozenset(words[k].values.to_numpy().tolist())
                    continue
                x, y = have[a], have[b]
                both = len(x & y)
                jaccard = both / (len(x) + len(y) - both)
                if jaccard >= threshold:
                    for c, v in zip(out, (a, b, jaccard), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["_a", "_b", "jaccard"])

    dealt = rows.repartition("t").sortWithinPartitions("t", F.col("_b").asc_nulls_first())
    return dealt.mapInArrow(compare, "_a long, _b long, jaccard double")


def _all_alike(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """(a_id, b_id, jaccard) of all texts of x that y lacks and all of y that reach the threshold, which is above 0. Exact: a pair
    meets in the prefixes of both, and where it first meets enough words stand behind on both sides. Equal texts are one
    node; pairs of nodes are compared once, and the ids put back at the end."""
    sets = x.select("_k", (F.col("_row") * 2).alias("_node"), "_w").union(y.select("_k", F.col("_row") * 2 + 1, "_w"))
    # The node of a text that both sides have is one of y, which leaves it out of x.
    of_y = F.min(F.when(F.col("_node") % 2 == 1, F.col("_node")))
    heads = written(sets.groupBy("_k").agg(F.coalesce(of_y, F.min("_node")).alias("_node")), "overlap-heads")
    posts = written(_prefixes(sets, heads.select("_node"), threshold), "overlap-prefixes")
    a, b = posts.where("_node % 2 = 0"), posts.where("_node % 2 = 1").select("t", *[F.col(c).alias(f"{c}2") for c in ("_node", "n", "after")])
    both = F.col("n") + F.col("n2")
    may = (a["t"] == b["t"]) & ((1 + F.least("after", "after2")) * (1 + threshold) >= both * (threshold - 1e-9)) & (F.least("n", "n2") >= F.greatest("n", "n2") * (threshold - 1e-9))
    # Of the words that a pair meets in any does; with the greatest, the pairs of a group of near copies come together.
    pairs = a.join(b, may).groupBy(F.col("_node").alias("_a"), F.col("_node2").alias("_b")).agg(F.max(a["t"]).alias("t"))
    of_side = lambda df, key, side: df.select((F.col("_row") * 2 + side).alias(key), "_row", "_w")
    near = _compared(written(_bounded(pairs, of_side(x, "_a", 0), of_side(y, "_b", 1), threshold), "overlap-pairs"), sets, threshold)
    ids = lambda df, name, node, side: df.select(name, "_k").join(heads.where(F.col("_node") % 2 == side), "_k").select(F.col("_node").alias(node), name)
    return near.join(ids(x, "a_id", "_a", 0), "_a").join(ids(y, "b_id", "_b", 1), "_b").select("a_id", "b_id", "jaccard")


def near_overlap(a: DataFrame, b: DataFrame, threshold: float = 0.85, rare: int | None = 8, least_chars: int = 5) -> DataFrame:
    """(a_id, b_id, jaccard) of texts of a and b whose word sets reach the threshold. Texts of a that b has too are exact matches
    and left out. rare=None finds all pairs, whatever words they share. With a number, only pairs that share a rare word (of
    least_chars, in at most `rare` texts of b) are found, and candidates grow with a's words."""
    sets = lambda df, name: _word_sets(df.select(F.col("id").alias(name), "text"), name, least_chars=least_chars)
    x, y = sets(a, "a_id"), sets(b, "b_id")
    if rare is None:
        return _all_alike(x, y, threshold)
    x = x.join(y.select("_k").distinct(), "_k", "left_anti")
    of_b = _long_words(y, "b_id")
    few = of_b.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") <= rare).select("t")
    pairs = _long_words(x, "a_id").join(of_b.join(few, "t"), "t").select("a_id", "b_id").distinct()
    return _alike(pairs, x.select("a_id", "_row", "_w"), y.select("b_id", "_row", "_w"), threshold)


def duplicate_profile(df: DataFrame, group: str, key) -> DataFrame:
    """Per group: rows, distinct texts, groups of equals, rows in them, and rows beyond the first."""
    k = df.select(F.col(group).alias("grp"), key(F.col("text")).alias("k")).groupBy("grp", "k").agg(F.count("*").alias("n"))
    return k.groupBy("grp").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("dup_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_dups"), F.sum(F.col("n") - 1).alias("extra_rows"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, blanks and distinct values; one aggregate over the table, unpivoted."""
    aggs = []
    for c in columns:
        s = F.col(c).cast("string")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(s.isNull()).alias("n_null"), F.count_if(F.trim(s) == "").alias("n_blank"), F.count_distinct(c).alias("n_unique")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("p")).select("p.*")


def group_diversity(pairs_of: DataFrame, limit: float = 0.8) -> DataFrame:
    """Per group of (grp, id, text): pairs, and mean, greatest and least Jaccard; flags groups above the limit. All
    pairs of a group are its definition; groups are small sets of prompts."""
    d = pairs_of.select("grp", "id", T.words(F.col("text")).alias("w"))
    o = d.select("grp", F.col("id").alias("id2"), F.col("w").alias("w2"))
    j = d.join(o, "grp").where("id < id2").select("grp", T.jaccard(F.col("w"), F.col("w2")).alias("j"))
    return j.groupBy("grp").agg(F.count("*").alias("n_pairs"), F.avg("j").alias("mean_j"), F.max("j").alias("max_j"), F.min("j").alias("min_j")).withColumn("flagged", F.col("mean_j") > limit)


def template_diversity(texts: DataFrame, limit: float = 0.8) -> DataFrame:
    """group_diversity with n_items and n_skeletons, the distinct texts once numbers, ages and sexes are marks. A group of
    one has no pairs, and 0 for their figures."""
    sizes = texts.groupBy("grp").agg(F.count("*").alias("n_items"), F.count_distinct(T.skeleton(F.col("text"))).alias("n_skeletons"))
    j = sizes.join(group_diversity(texts, limit).withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g")), "left").drop("_g")
    return j.na.fill(0, ["n_pairs", "mean_j", "max_j", "min_j"]).na.fill(False, ["flagged"])


#: Texts of a block; a cell compares two blocks.
BLOCK = 512


def cross_similarity(texts: DataFrame, limit: float = 0.9, block: int | None = None) -> DataFrame:
    """One row for (id, text): n_pairs, mean_j and max_j of the Jaccard similarities of all pairs of word sets, the first pair
    (in the order of ids) that has the greatest, and whether it keeps to the limit. The mean needs every pair, so the
    work is the square of the texts; but pairs are summed where they are made: texts are dealt to the upper triangle of blocks,
    a cell multiplies its two blocks' incidence matrices and returns one row. Null texts are empty sets; two of those are equal."""
    size = BLOCK if block is None else block
    d = running(texts.select("id", T.words(F.col("text")).alias("w")), [], ["id"]).select("id", "rn", "w", F.expr(f"(rn - 1) div {size}").alias("k"))
    n_blocks = -(-d.count() // size)
    others = F.sequence(F.lit(0).cast("long"), F.lit(max(n_blocks - 1, 0)).cast("long"))
    cells = d.select("*", F.explode(others).alias("o")).withColumn("cell", F.struct(F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j")))

    def compare(table):
        import numpy as np
        import pyarrow as pa

        cell = table["cell"][0].as_py()
        rows = sorted(zip(table["k"].to_pylist(), table["rn"].to_pylist(), table["id"].to_pylist(), table["w"].to_pylist(), strict=True), key=lambda r: r[1])
        a, b = ([r for r in rows if r[0] == cell[x]] for x in "ij")
        code: dict = {}
        for r in rows:
            for w in r[3]:
                code.setdefault(w, len(code))

        def matrix(side):
            m = np.zeros((len(side), max(len(code), 1)), np.float32)
            for n, r in enumerate(side):
                m[n, [code[w] for w in r[3]]] = 1
            return m

        x, y = matrix(a), matrix(b)
        both, sizes = x @ y.T, x.sum(1)[:, None] + y.sum(1)[None, :]
        union = sizes - both
        j = np.where(union == 0, 1.0, both.astype(float) / np.maximum(union, 1))
        right = np.array([r[1] for r in a])[:, None] < np.array([r[1] for r in b])[None, :]
        if not right.any():
            return pa.table({"n": pa.array([0], pa.int64()), "s": [0.0], "m": [-1.0], "p": pa.array([0], pa.int64()), "q": pa.array([0], pa.int64()), "a": pa.array([None], pa.string()), "b": pa.array([None], pa.string())})
        at = np.unravel_index(np.argmax(np.where(right, j, -1.0)), j.shape)
        return pa.table({"n": pa.array([int(right.sum())], pa.int64()), "s": [float(j[right].sum())], "m": [float(j[at])], "p": pa.array([a[at[0]][1]], pa.int64()), "q": pa.array([b[at[1]][1]], pa.int64()), "a": [str(a[at[0]][2])], "b": [str(b[at[1]][2])]})

    found = cells.groupBy("cell").applyInArrow(compare, "n long, s double, m double, p long, q long, a string, b string")
    best = F.max(F.when(F.col("n") > 0, F.struct("m", (-F.col("p")).alias("p"), (-F.col("q")).alias("q"), "a", "b")))
    one = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.sum("s").alias("s"), best.alias("best"))
    return one.select("n_pairs", F.coalesce(F.try_divide("s", "n_pairs"), F.lit(0.0)).alias("mean_j"), F.coalesce("best.m", F.lit(0.0)).alias("max_j"), F.col("best.a").alias("first_id"), F.col("best.b").alias("second_id"), (F.coalesce("best.m", F.lit(0.0)) <= limit).alias("passes"))


def manifest(rows: DataFrame, split: str, columns: list[str], slots: dict[str, list[str]] | None = None) -> DataFrame:
    """Per split and column, and over all splits (split null): n, n_null, n_blank, n_unique and n_repeated, the values that
    stand in several rows. `slots` are struct or map columns whose named parts count as columns of their own (options.A). All
    come from one scan: cells are rows of (split, column, digest), counted once, then in grouping sets."""
    text = lambda c: F.col(c).cast("string")
    cells = [F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns]
    cells += [F.struct(F.lit(f"{c}.{part}").alias("column"), F.col(c)[part].cast("string").alias("value")) for c, parts in (slots or {}).items() for part in parts]
    each = rows.select(F.coalesce(text(split), F.lit("")).alias("split"), F.explode(F.array(*cells)).alias("x")).select("split", "x.column", F.md5("x.value").alias("value"), F.col("x.value").isNull().alias("none"), (F.trim("x.value") == "").alias("blank"))
    once = each.groupBy("split", "column", "value", "none", "blank").agg(F.count("*").alias("n"))
    # Values of the two kinds of groups are counted apart, so that no distinct count runs over all cells again.
    sets = once.select(F.explode(F.array(F.struct(F.col("split").alias("s")), F.struct(F.lit(None).cast("string").alias("s")))).alias("g"), "column", "value", "none", "blank", "n")
    values = sets.groupBy(F.col("g.s").alias("split"), "column", "value", "none", "blank").agg(F.sum("n").alias("n"))
    return values.groupBy("split", "column").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("none"), F.col("n"))), F.lit(0)).alias("n_null"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("n_blank"), F.count("value").alias("n_unique"), F.count_if(F.col("value").isNotNull() & (F.col("n") > 1)).alias("n_repeated"))
