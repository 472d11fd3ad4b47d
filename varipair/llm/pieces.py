"""SentencePiece BPE by a prefix table: encoding and decoding.

For every prefix of a text the last id of its encoding is unique. The table holds it: at each place the pieces
that end there come from an Aho-Corasick automaton, longest first, and the first one that may stand after the
last piece of the prefix before it is taken. Two pieces may stand side by side if merging their characters by
the model's rules gives just these two. The ids are then read off backwards. No text is merged as a whole, so
the time is linear in its length.

A text falls into units that no merge can join: no piece holds the space mark after another character, and a
line feed is no piece. Units are encoded once per worker and remembered in a bounded memo.

Models: BPE with byte fallback, identity normaliser, a dummy prefix and no user-defined pieces; others raise.

Cases: null text is empty (the end id only); repeated and null doc_ids stay row by row; an empty table gives no
rows; extra columns are ignored. Memory is that of one slice of texts or of the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
#: The longest unit that is remembered.
LONGEST = 64
#: Units that a worker remembers, some 200 bytes each.
MEMO = 800_000


class PieceTable:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        t, n = model.trainer_spec, model.normalizer_spec
        normal, unknown, control, byte = 1, 2, 3, 6
        kinds = {p.type for p in model.pieces}
        if t.model_type != 2 or not t.byte_fallback or n.name != "identity" or n.remove_extra_whitespaces or not n.add_dummy_prefix or t.treat_whitespace_as_suffix or kinds - {normal, unknown, control, byte}:
            raise ValueError("only BPE models with byte fallback, an identity normaliser and a dummy prefix are supported")
        if len(model.pieces) >= 1 << 16:
            raise ValueError("more than 65,535 pieces")
        # Inside, the mark is a plain space: the library reads both alike, and units stay one byte a character.
        self.pieces = [p.piece.replace(MARK, " ") for p in model.pieces]
        self.ids = {self.pieces[i]: i for i, p in enumerate(model.pieces) if p.type == normal}
        self.scores = {self.pieces[i]: p.score for i, p in enumerate(model.pieces) if p.type == normal}
        if any(" " in p.lstrip(" ") or "\n" in p or "\0" in p for p in self.ids):
            raise ValueError("a piece holds the space mark after another character, or a line feed")
        self.length = [len(p.piece) for p in model.pieces]
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == byte}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.surface = [b"" if p.type == control else t.unk_surface.encode() if p.type == unknown else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.spaced = {i for i, p in enumerate(model.pieces) if p.type == normal and p.piece.startswith(MARK)}
        self.decimals = Strings([b" %d" % i for i in range(len(model.pieces))])
        self.bytes = Strings([bytes([self.byte_of[i]]) if i in self.byte_of else x for i, x in enumerate(self.surface)])
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.side_by_side: dict[int, bool] = {}
        self.memo = UnitMemo(self)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the merge rules: the best score first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces may stand side by side; a negative id is a character without a piece."""
        if len(self.side_by_side) >= C.MEMO:
            self.side_by_side.clear()
        pair = [chr(-2 - left) if left < 0 else self.pieces[left], self.pieces[right]]
        got = self.side_by_side[(left << 16) + right] = self.merged(pair[0] + pair[1]) == pair
        return got

    def unit_ids(self, unit: str) -> list[int]:
        """last[i] is the last id of the encoding of unit[:i]; the ids are read off backwards."""
        n, known = len(unit), self.side_by_side
        last = [-1] * (n + 1)
        for end, (piece, length) in self.automaton.iter(unit):
            i = end + 1
            if last[i] != -1:
                continue
            j = i - length
            if j:
                before = last[j]
                if before == -1:  # all pieces that end at j were seen: its last character has none
                    before = last[j] = -2 - ord(unit[j - 1])
                fits = known.get((before << 16) + piece)
                if fits is None:
                    fits = self.fits(before, piece)
                if not fits:
                    continue
            last[i] = piece
        out: list[int] = []
        while n:
            piece = last[n]
            if piece < 0:
                out += [self.byte_ids[b] for b in reversed(unit[n - 1].encode())]
                n -= 1
            else:
                out.append(piece)
                n -= self.length[piece]
        out.reverse()
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or "\0" in text:
            units, run = [], " "
            for word in text.split(" "):
                if word:
                    first, *lines = word.split("\n")
                    units.append(run + first)
                    for line in lines:
                        units += ["\n", line] if line else ["\n"]
                    run = " "
                else:
                    run += " "
            if run != " ":
                units.append(run[1:])
            return units
        return (" " + text.replace(" ", "\0 ").replace("\n", "\0\n\0")).split("\0")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, unsigned 16-bit."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.units(text))), "<u2")

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of ids that encode() gave: bytes of characters without a piece are whole there."""
        data = self.bytes.gather(ids)
        return data[1:] if len(ids) and int(ids[0]) in self.spaced else data

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD one by one."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_as_text(bytes(run)))
                run.clear()
            if i is not None:
                out.append(self.surface[i].decode())
        first = next((i for i in ids if self.surface[i] or i in self.byte_of), None)
        text = "".join(out)
        return text[1:] if first in self.spaced else text


class UnitMemo(dict):
    """Units and the bytes of their ids. A last character that no piece holds after the one before it is
    looked up by itself, so a word costs its encoding once, with whatever sign after it."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > 1 and unit[-2:] not in self.table.neighbours and len(unit) <= LONGEST:
            got = self[unit[:-1]] + self[unit[-1]]
        else:
            got = np.array(self.table.unit_ids(unit), "<u2").tobytes()
        if len(unit) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[unit] = got
        return got


class Strings:
    """A list of byte strings that are gathered by index."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, at: np.ndarray) -> bytes:
        size = self.size[at]
        shift = self.start[at] - (np.cumsum(size) - size)
        return self.data[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()


def _as_text(run: bytes) -> str:
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_LOADED: dict[str, PieceTable] = {}


def load(path: str) -> PieceTable:
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(batches, path: str, end_id: int):
    table = load(path)
    for part in C.steps(batches):
        rows = []
        for text in part.column("text").to_pylist():
            ids = table.encode(text or "")
            decimals = table.decimals.gather(ids) + b" %d" % end_id
            rows.append((len(ids) + 1, hashlib.sha256(decimals[1:]).hexdigest(), hashlib.sha256(table.decoded(ids)).hexdigest()))
        yield C.batch_of(_DIGESTS, [part.column("doc_id"), *map(list, zip(*rows, strict=True))])


def digests(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Per document row: doc_id, n_tokens, ids_sha256 and decoded_sha256. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.arrow_map(rows, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, end_id)


def _encode_rows(batches, path: str, end_id: int):
    table = load(path)
    for part in C.steps(batches):
        ids = [np.append(table.encode(t or ""), end_id).astype(np.int32) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and the ids, the end id last."""
    return C.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _encode_rows, "doc_id long, ids array<int>", path, end_id)


def _decode_rows(batches, path: str):
    table = load(path)
    for batch in batches:
        texts = [None if ids is None else table.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give null."""
    return C.arrow_map(encoded.select("doc_id", "ids"), _decode_rows, "doc_id long, text string", path)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 2)
