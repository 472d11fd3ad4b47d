"""Token counts that follow edits.

A document's state is a segment tree over its pre-tokens: leaves of some tens of units (see bytebpe), each with
its characters and its tokens, inner nodes with the sums of both. An edit finds its leaves by descending the
tree, takes the leaves on either side as context, encodes that region anew and writes new sums on the path to
the root. Nothing else of the document is encoded again.

A region is closed on both sides where its first and last characters are not touched, as units never join
across such a place; otherwise it grows by a leaf.

Cases: null text is empty, with no leaves and 0 tokens; an edit's place is cut to the text's length, negative
ones to 0, null parts count as 0 or ''; edits of documents that do not exist change nothing; edits of one
document apply in order of (seq, start, length, text), repeated rows are repeated edits; rows with null or repeated
doc_id: null matches no edit, each repeated row gets the edits. Extra columns are ignored.
One document's edits are a sequence and are applied by one task, in the order of a sorted array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Units of a leaf when a tree is built.
LEAF = 32


class CountTree:
    """Texts, characters and tokens of leaves, and the sums above them; node 1 is the root."""

    def __init__(self, bpe, leaves: list[str], counts: list[int]):
        self.bpe, self.leaves = bpe, leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves += [""] * (self.size - len(leaves))
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size :] = map(len, self.leaves)
        self.tokens[self.size : self.size + len(counts)] = counts
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded = 0

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place (the last one with text for the end), and where it starts."""
        node, base = 1, 0
        place = max(0, min(place, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if place - base >= self.chars[node]:
                base += self.chars[node]
                node += 1
        return node - self.size, base

    def put(self, leaf: int, text: str, count: int) -> None:
        node = self.size + leaf
        self.leaves[leaf] = text
        self.chars[node], self.tokens[node] = len(text), count
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, length: int, text: str) -> None:
        total = self.chars[1]
        start = max(0, min(start, total))
        stop = max(start, min(start + max(0, length), total))
        first, low = self.leaf_at(start)
        last, high = self.leaf_at(max(start, stop - 1))
        high += len(self.leaves[last])
        # The first and the last character of the region stay as they are, or the region reaches the text's end.
        while start <= low and low > 0:
            first -= 1
            low -= len(self.leaves[first])
        while stop >= high and high < total:
            last += 1
            high += len(self.leaves[last])
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - low] + text + region[stop - low :]
        (ids,) = self.bpe.encode([region])
        self.encoded += len(region)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self.put(leaf, "", 0)
        self.put(first, region, len(ids) // 4)
        if len(region) > 64 * LEAF and len(self.leaves[first]) > self.chars[1] // 2 > 64 * LEAF:
            self.split()

    def state(self) -> tuple[bytes, bytes]:
        """Characters and tokens of the leaves that hold text: all that a later batch needs beside the text."""
        held = np.array(self.chars[self.size :], "<u4")
        return held[held > 0].tobytes(), np.array(self.tokens[self.size :], "<u4")[held > 0].tobytes()

    def split(self) -> None:
        """Leaves anew, after edits that left most of the text in one."""
        done = self.encoded
        self.__init__(self.bpe, *leaves_of(self.bpe, "".join(self.leaves)))
        self.encoded = done + self.chars[1]


def leaves_of(bpe, text: str) -> tuple[list[str], list[int]]:
    units = bpe.units(text) if text else []
    bpe.learn([units])
    sizes = [len(bpe._ids(u)) // 4 for u in units]
    return ["".join(units[i : i + LEAF]) for i in range(0, len(units), LEAF)], [sum(sizes[i : i + LEAF]) for i in range(0, len(units), LEAF)]


_STATE = "doc_id long, text string, n_tokens long, leaf_chars binary, leaf_tokens binary"


def _build(batches, path: str):
    from . import bytebpe

    bpe = bytebpe.load(path, ordinary=True)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("leaf_chars", pa.binary()), ("leaf_tokens", pa.binary())])
    for part in C.steps(batches):
        texts = [x or "" for x in part.column("text").to_pylist()]
        split = [bpe.units(t) if t else [] for t in texts]
        bpe.learn(split)
        rows = []
        for units in split:
            if not units:
                rows.append((0, b"", b""))
                continue
            try:
                sizes = np.fromiter(map(len, map(bpe.memo.__getitem__, units)), np.int64, len(units)) // 4
            except KeyError:
                sizes = np.array([len(bpe._ids(u)) // 4 for u in units], np.int64)
            at = np.arange(0, len(units), LEAF)
            chars = np.add.reduceat(np.fromiter(map(len, units), np.int64, len(units)), at)
            tokens = np.add.reduceat(sizes, at)
            rows.append((int(sizes.sum()), chars.astype("<u4").tobytes(), tokens.astype("<u4").tobytes()))
        yield C.batch_of(schema, [part.column("doc_id"), pa.array(texts, pa.string()), *map(list, zip(*rows, strict=True))])


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The state of each document: doc_id, text, n_tokens and the leaves of its tree. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.arrow_map(rows, _build, _STATE, tokenizer)


def tree_of(bpe, text: str, chars: bytes, tokens: bytes) -> CountTree:
    ends = np.cumsum(np.frombuffer(chars, "<u4").astype(np.int64)).tolist()
    return CountTree(bpe, [text[a:b] for a, b in zip([0, *ends], ends, strict=False)], np.frombuffer(tokens, "<u4").tolist())


def _apply(batches, path: str):
    from . import bytebpe

    bpe = bytebpe.load(path, ordinary=True)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_after", pa.int64()), ("n_chars_after", pa.int64()), ("n_chars_encoded", pa.int64()), ("text_after", pa.string()), ("leaf_chars_after", pa.binary()), ("leaf_tokens_after", pa.binary())])
    for part in C.steps(batches):
        rows = []
        for text, n, chars, tokens, edits in zip(*(part.column(c).to_pylist() for c in ("text", "n_tokens", "leaf_chars", "leaf_tokens", "edits")), strict=True):
            tree = tree_of(bpe, text, chars, tokens)
            for e in edits or []:
                tree.edit(e["start"], e["length"], e["text"])
            rows.append((n, len(edits or []), tree.tokens[1], tree.chars[1], tree.encoded, "".join(tree.leaves), *tree.state()))
        yield C.batch_of(schema, [part.column("doc_id"), *map(list, zip(*rows, strict=True))])


def apply_edits(state: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """state after edits (doc_id, seq, start, length, text): doc_id, n_tokens before, n_edits, n_tokens_after,
    n_chars_after, n_chars_encoded (the work done), text_after and its leaves. One shuffle of the states to their edits."""
    part = F.struct(F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("text", F.lit("")).alias("text"))
    by_doc = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(part)).alias("edits"))
    return C.arrow_map(state.join(by_doc, "doc_id", "left"), _apply, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long, text_after string, leaf_chars_after binary, leaf_tokens_after binary", tokenizer)


def state_after(edited: DataFrame) -> DataFrame:
    """What apply_edits left, as the state for the next batch of edits; written, it is the store that batches go through."""
    return edited.select("doc_id", F.col("text_after").alias("text"), F.col("n_tokens_after").alias("n_tokens"), F.col("leaf_chars_after").alias("leaf_chars"), F.col("leaf_tokens_after").alias("leaf_tokens"))


def edit_log(docs: DataFrame) -> DataFrame:
    """Three edits of every document, made of its own columns: a heading, a replacement in the middle and a
    line at the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    one = lambda seq, start, length, text: F.struct(F.lit(seq).alias("seq"), start.cast("long").alias("start"), F.lit(length).alias("length"), text.alias("text"))
    log = F.array(
        one(1, F.floor(n / 2), 12, F.concat(F.lit(" ["), F.coalesce("lang", F.lit("")), F.lit("] "))),
        one(2, F.lit(0), 0, F.concat(F.coalesce("source", F.lit("")), F.lit(": "))),
        one(3, F.lit(1 << 40), 0, F.concat(F.lit("\n"), F.coalesce("source", F.lit("")))),
    )
    return docs.select("doc_id", F.explode(log).alias("e")).select("doc_id", "e.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = C.table(spark, sf_dir, "documents")
    return apply_edits(count_tokens(docs, path), edit_log(docs), path).drop("text_after", "leaf_chars_after", "leaf_tokens_after")
