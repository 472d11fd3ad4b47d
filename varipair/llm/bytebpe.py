"""Ids of a byte-level BPE tokenizer of the tokenizers library, through a memo of units.

A unit is a run of white space and the run of other characters after it. The tokenizer's own pattern never
joins a character with white space that follows it, so a text's ids are the ids of its units, one after the
other, and the library is asked once for each distinct unit a worker meets: many new units go to it as one text,
and the bytes of the ids that come back show where each unit ends. A text that holds the string of a special
token goes to the library whole.

A column of texts is parted at its spaces and dictionary-encoded by Arrow, so Python sees each distinct word of
a slice once; ids are then gathered by index. Texts in which a space stands beside other white space are cut by
the unit pattern instead. Signs that end a word are tokens of their own, so a word costs the library one look,
whatever sign follows it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space as Unicode has it (the pattern's \s), as inner parts of a character class.
SPACES = r"\t-\r \x85\xa0  -     　"
_OTHER = re.compile(r"[\0\t\x0b-\r\x85\xa0  -     　]")
_UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: One space or line feed and a word of other characters, none of them white space: what may be joined with others.
_PLAIN = re.compile(f"[ \n][^{SPACES}\0]{{1,63}}")
#: The longest unit that is remembered; longer ones are encoded each time.
LONGEST = 64
#: Signs that the pattern parts from a letter or digit before them, where white space or nothing follows.
SIGNS = ".,;:!?)]}\"'*#%&$|<>"
#: New units that go to the library as one text.
JOINED = 2000
#: Units that are remembered before the memo turns; those of the memo before stay until the next turn.
MEMO = 250_000


class ByteBPE:
    def __init__(self, path: str, ordinary: bool = False):
        """ordinary: the strings of special tokens in a text are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Units and the bytes of their ids: those met lately, and those met before the last change of memos.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # A token's characters stand for one byte each.
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, at in self.tokenizer.get_vocab().items():
            self.n_bytes[at] = len(token)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def units(self, text: str) -> list[str]:
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER.search(text):
            return _UNIT.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _parts(self, unit: str) -> tuple[str, ...]:
        """A unit as a word and the signs behind it, if it is so made."""
        core = unit.rstrip(SIGNS)
        # Letters and digits of the first blocks of Unicode, on which all its versions agree.
        if len(core) < len(unit) and core and core[-1] < "\u0250" and core[-1].isalnum():
            return core, unit[len(core) :]
        return (unit,)

    def _known(self, unit: str) -> bytes | None:
        got = self.memo.get(unit)
        if got is None and (got := self.old.get(unit)) is not None:
            self.memo[unit] = got
        return got

    def learn(self, texts: list[list[str]]) -> None:
        """Have the memo hold the units of these texts, but for the long ones."""
        met: set[str] = set()
        for units in texts:
            met.update(units)
        self._turn()
        new = [u for u in met if len(u) <= LONGEST and self._known(u) is None]
        self._learn_parts(new)
        for u in new:
            self.memo[u] = b"".join(map(self._ids, self._parts(u)))

    def _turn(self) -> None:
        if len(self.memo) > MEMO:
            self.memo, self.old = {}, self.memo

    def _learn_parts(self, units: list[str]) -> None:
        """Encode the parts of units that are not known yet."""
        new = [p for p in {p for u in units for p in self._parts(u)} if len(p) <= LONGEST and self._known(p) is None]
        # One behind the other, units are parted as in a text if each begins with white space and none ends with it.
        inner = [u for u in new if u and u[0] in " \n" and not u[-1].isspace()]
        for i in range(0, len(inner), JOINED):
            self._learn_joined(inner[i : i + JOINED])
        rest = [u for u in new if u not in self.memo]
        if rest:
            for unit, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.memo[unit] = np.array(got.ids, "<u4").tobytes()

    def _learn_joined(self, units: list[str]) -> list[bytes] | None:
        """Remember units from the ids of all in one text; none of them if the ids do not part where the units do."""
        text = "".join(units)
        if any(s in text for s in self.special):
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(np.fromiter(map(len, units if text.isascii() else map(str.encode, units)), np.int64, len(units)))
        token_ends = np.cumsum(self.n_bytes[ids])
        at = np.searchsorted(token_ends, ends)
        if not len(ids) or at[-1] != len(ids) - 1 or not np.array_equal(token_ends[at], ends):
            return None
        data, stops = ids.tobytes(), (4 * (at + 1)).tolist()
        got = list(map(data.__getitem__, map(slice, [0, *stops[:-1]], stops)))
        self.memo.update(zip(units, got, strict=True))
        return got

    def _ids(self, unit: str) -> bytes:
        got = self.memo.get(unit)
        return self.whole(unit) if got is None else got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if any(s in t for s in self.special) else self.units(t) for t in texts]
        self.learn([u for u in split if u])
        memo, out = self.memo, []
        for text, units in zip(texts, split, strict=True):
            if units is None:
                out.append(self.whole(text))
                continue
            try:
                out.append(b"".join(map(memo.__getitem__, units)))
            except KeyError:
                out.append(b"".join(map(self._ids, units)))
        return out

    def _joined(self, text: str) -> bytes:
        """The ids of units one behind the other, from those of their parts."""
        return b"".join(self._ids(p) for u in _UNIT.findall(text) for p in self._parts(u))

    def _looked_up(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units; new ones are learnt."""
        known = list(map(self.memo.get, units))
        plain, at, other = [], [], []
        for i in [i for i, got in enumerate(known) if got is None]:
            unit = units[i]
            if (got := self.old.get(unit)) is not None:
                known[i] = self.memo[unit] = got
            elif _PLAIN.fullmatch(unit):
                plain.append(unit)
                at.append(i)
            else:
                other.append(i)
        for lo in range(0, len(plain), JOINED):
            got = self._learn_joined(plain[lo : lo + JOINED])
            if got is None:
                other += at[lo : lo + JOINED]
            else:
                for i, ids in zip(at[lo : lo + JOINED], got, strict=True):
                    known[i] = ids
        self._learn_parts([u for i in other for u in _UNIT.findall(units[i])])
        for i in other:
            got = self.memo.get(units[i])
            known[i] = self._joined(units[i]) if got is None else got
        return known

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where those of each text end. Null is empty."""
        texts = texts.fill_null("")
        # A line feed is put as a space and a sign, so that it parts words too.
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \1"), " ")
        starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = starts - starts[0]
        words = lists.flatten()
        stems = pc.utf8_rtrim(words, SIGNS)
        coded = stems.dictionary_encode()
        at, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
        signed = np.flatnonzero(np.diff(C.offsets(words)) != np.diff(C.offsets(stems)))
        # A text whose white space is not one space between words, or that names a special token, is cut by itself.
        bare = pc.utf8_trim_whitespace(distinct)
        bad = np.diff(C.offsets(bare)) != np.diff(C.offsets(distinct))
        bad = (bad | pc.equal(distinct, "\1").to_numpy(zero_copy_only=False).astype(bool))[at]
        none = np.diff(C.offsets(words)) == 0
        slow = np.logical_or.reduceat(bad | none, starts[:-1]) if len(at) else np.zeros(0, bool)
        for s in ["\1", *self.special]:
            slow |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False).astype(bool)
        self._turn()
        cores = distinct.to_numpy(zero_copy_only=False).tolist()
        entries = self._looked_up(["\n" + x[1:] if x[:1] == "\1" else " " + x for x in cores])
        # Behind each word stands what its signs give, or nothing; words that do not end so are looked up whole.
        stem, of_stem = np.unique(at[signed], return_inverse=True)
        plain = np.fromiter((bool(x := cores[i]) and x[-1] < "\u0250" and x[-1].isalnum() for i in stem.tolist()), bool, len(stem))[of_stem]
        tails, of_tail, short = _tails(words, signed, np.diff(C.offsets(words))[signed] - np.diff(C.offsets(stems))[signed])
        plain &= short
        which = np.zeros(len(at), np.int32)
        which[signed[plain]] = 1 + of_tail[plain]
        whole = words.take(pa.array(signed[~plain])).dictionary_encode()
        at[signed[~plain]] = -1
        which[signed[~plain]] = 1 + len(tails) + whole.indices.to_numpy(zero_copy_only=False)
        more = tails + ["\n" + x[1:] if x[0] == "\1" else " " + x for x in whole.dictionary.to_pylist()]
        base = len(entries)
        entries.append(b"")
        entries += self._looked_up(more)
        at[at < 0] = base
        both = np.empty(2 * len(at), np.int32)
        both[0::2], both[1::2] = at, base + which
        # The first word of a text has no space before it; odd texts are one entry, as texts that are cut by themselves.
        rows = np.flatnonzero(slow).tolist()
        odd = dict(zip(rows, self.encode(texts.take(pa.array(rows, pa.int64())).to_pylist()) if rows else [], strict=True))
        for i in rows:
            both[2 * starts[i] : 2 * starts[i + 1]] = base
        firsts = words.take(pa.array(starts[:-1])).to_pylist()
        got = self._looked_up(firsts)
        both[2 * starts[:-1]], both[2 * starts[:-1] + 1] = len(entries) + np.arange(len(texts)), base
        entries += [odd.get(i, x) for i, x in enumerate(got)]
        size = np.fromiter(map(len, entries), np.int32, len(entries)) // 4
        pool, begin = np.frombuffer(b"".join(entries), "<u4"), (np.cumsum(size, dtype=np.int64) - size)
        n = size[both]
        total = np.cumsum(n, dtype=np.int64)
        kind = np.int32 if max(len(pool), int(total[-1]) if len(total) else 0) < 1 << 30 else np.int64
        shift = (begin[both] - (total - n)).astype(kind)
        ids = pool[np.repeat(shift, n) + np.arange(int(total[-1]) if len(total) else 0, dtype=kind)]
        return ids, np.r_[0, total][2 * starts[1:]]


def _tails(words: pa.Array, at: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct ends, of `size` bytes each, of the words at `at`; which each word has, and if it is of eight bytes at most."""
    ends, data = C.offsets(words)[1:][at].astype(np.int64), np.frombuffer(words.buffers()[2] or b"", np.uint8)
    back = np.arange(8)
    taken = np.where(back < size[:, None], data[np.maximum(ends[:, None] - 1 - back, 0)], 0).astype(np.uint8)
    kinds, which = np.unique(np.ascontiguousarray(taken).view("<u8").ravel(), return_inverse=True)
    return [k.tobytes().rstrip(b"\0")[::-1].decode() for k in kinds.astype("<u8")], which, size <= 8


_LOADED: dict[tuple, ByteBPE] = {}


def load(path: str, ordinary: bool = False) -> ByteBPE:
    if (path, ordinary) not in _LOADED:
        _LOADED[path, ordinary] = ByteBPE(path, ordinary)
    return _LOADED[path, ordinary]
