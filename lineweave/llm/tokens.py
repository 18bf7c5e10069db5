"""Token ids of whole texts, a column at a time, with a bounded table of words seen.

A byte-pair tokenizer never joins what its pre-tokenizer splits, and both vocabularies split between a character that is not
white space and an ASCII space that follows.  So texts are cut there; every distinct piece is encoded once by the tokenizers
library and its ids are kept in a table, and a text's ids are its pieces' ids in order.  Cutting, looking up and joining go over
whole columns in NumPy: pieces are found by 64-bit polynomial hashes with their lengths mixed in, and then compared byte by byte,
eight at a time; a slab in which two pieces share a hash goes through the library whole.

A piece that is one word of Latin letters, maybe with a space before and marks after it, goes to the library's model directly, as
normalizer and pre-tokenizer would hand it on; every other piece goes through the whole library.  Texts with white space beyond
ASCII are not cut for the vocabulary that encodes white space, and pieces of over ``LONGEST_KEPT`` bytes are not kept.  Texts with the
string of a special token go to the library whole: like the library's plain call, this gives the token's own id, unless
``special_as_text`` is set, which makes it ordinary text.

The table is per Python worker, holds at most ``CAPACITY`` pieces and starts anew when full; it changes speed only.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: End of a document (contract).
END_ID = 1
CAPACITY = 2_000_000
LONGEST_KEPT = 40
#: Bytes of text that are worked on at once.
SLAB = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xe1\xa0\x8e")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"( |\n|)([{_LETTERS}]+)([.,;:!?]*)")

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


#: Bytes that stand for a piece of a length below 8, among the 8 from its start.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary, printable ones themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each of the pieces ``b[s:e]``."""
    up, down = _powers(max(SLAB, 1 << 12))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    return ((sums[e] - sums[s]) * down[s]) ^ ((e - s).astype(np.uint64) * _MIX)


def piece_words(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of pieces of up to ``LONGEST_KEPT``: the first and the last eight of each, and the middle ones of those over 16."""
    padded = np.concatenate([b, np.zeros(LONGEST_KEPT + 8 - len(b) % 8, dtype=np.uint8)])
    eights = np.empty(len(padded) - 8, dtype=np.uint64)  # the eight bytes from each place
    for k in range(8):
        eights[k::8] = padded[k : k + len(eights)].view("<u8")
    load = eights.__getitem__
    n = e - s
    outer = np.stack([load(s) & _MASKS[np.minimum(n, 8)], np.where(n > 8, load(np.maximum(e - 8, 0)), 0)])
    long = np.flatnonzero(n > 16)
    inner = np.zeros((3, len(s)), dtype=np.uint64)
    for k in range(3):
        inner[k, long] = np.where(n[long] > 8 * k + 16, load(s[long] + 8 * k + 8), 0) & _MASKS[np.clip(n[long] - 8 * k - 16, 0, 8)]
    return outer, inner


def _room(columns: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """``columns`` with room for ``wanted`` entries; of the old ones ``used`` stay."""
    if wanted <= columns.shape[1]:
        return columns
    grown = np.zeros((len(columns), max(wanted, columns.shape[1] * 3 // 2)), dtype=columns.dtype)
    grown[:, :used] = columns[:, :used]
    return grown


class Encoder:
    """Ids of columns of texts, as the tokenizers library gives them without adding tokens of its own."""

    def __init__(self, path: str, keeps_space: bool, capacity: int = CAPACITY, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in any case, as a normalizer may lower it before the library looks for it
        self.special = None if special_as_text or not added else re.compile(b"|".join(map(re.escape, added)), re.I)
        self.mark = os.path.commonprefix([t.lower() for t in added] + [t.upper() for t in added])
        self.model = self.tokenizer.model
        self.keeps_space, self.capacity = keeps_space, capacity
        as_char = _byte_characters()
        self.mapped = {c: "".join(as_char[b] for b in chr(c).encode()) for c in [10, 32, *range(33, 127), *range(0xC0, 0x100)]}
        self.marks: dict[str, list[int]] = {"": []}
        self._clear()

    def _clear(self):
        """An empty table: sorted hashes with the row of each.

        Rows, in order of learning, have a piece's first and last bytes, and packed into one number how many ids it has (8 bits), where they
        stand in the pool (32) and the row of its middle bytes (24), which only pieces of over 16 bytes have.
        """
        self.keys, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.columns = np.zeros((3, 1 << 12), dtype=np.uint64)
        self.inner, self.n_inner = np.zeros((3, 1 << 8), dtype=np.uint64), 0
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _of_model(self, s: str) -> list[int]:
        return [t.id for t in self.model.tokenize(s.translate(self.mapped))]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece by itself."""
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            m = _SIMPLE.fullmatch(p)
            if not m:
                rest.append(i)
                continue
            space, word, marks = m.groups()
            if (tail := self.marks.get(marks)) is None:
                tail = self.marks[marks] = self._of_model(marks)
                if len(self.marks) > 10_000:
                    self.marks = {"": []}
            if not self.keeps_space:
                ids = self._of_model(word.lower())
            elif space == "\n":
                ids = self._of_model(space) + self._of_model(word)
            else:
                ids = self._of_model(space + word)
            out[i] = ids + tail if tail else ids
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, words: tuple[np.ndarray, np.ndarray], pieces: list[bytes]) -> None:
        ids = self.encode_pieces([p.decode("utf-8", "surrogatepass") for p in pieces])
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total = int(n.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool) // 2, total), dtype=np.uint32)])
        self.pool[self.used : self.used + total] = np.fromiter((x for i in ids for x in i), dtype=np.uint32, count=total)
        first, rows = len(self.keys), len(self.keys) + len(keys)
        outer, inner = words
        long = np.flatnonzero(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) > 16)
        self.columns, self.inner = _room(self.columns, first, rows), _room(self.inner, self.n_inner, self.n_inner + len(long))
        at_inner = np.zeros(len(keys), dtype=np.uint64)
        at_inner[long] = np.arange(self.n_inner, self.n_inner + len(long))
        self.inner[:, self.n_inner : self.n_inner + len(long)] = inner[:, long]
        self.n_inner += len(long)
        self.columns[:2, first:rows] = outer
        self.columns[2, first:rows] = n.astype(np.uint64) | (self.used + np.cumsum(n) - n).astype(np.uint64) << np.uint64(8) | at_inner << np.uint64(40)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, where, keys), np.insert(self.row, where, np.arange(first, rows, dtype=np.int32))
        self.used += total

    def _slab(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``raw`` that begin at ``starts``, and how many each has."""
        b = np.frombuffer(raw, dtype=np.uint8)
        none = np.zeros(len(starts), dtype=np.int64)
        if not len(b):
            return np.zeros(0, dtype=np.uint32), none
        first = np.zeros(len(b) + 1, dtype=bool)
        first[starts] = True
        first = first[:-1]
        space = _SPACE[b]
        before = np.concatenate([[True], space[:-1]])
        if self.keeps_space:
            s = np.flatnonzero(first | (space & ~before))
            e = np.concatenate([s[1:], [len(b)]])
        else:
            s = np.flatnonzero(~space & (before | first))
            after = np.concatenate([space[1:] | first[1:], [True]])
            e = np.flatnonzero(~space & after) + 1
        if not len(s):
            return np.zeros(0, dtype=np.uint32), none
        h, (outer, inner) = piece_hashes(b, s, e), piece_words(b, s, e)
        keys, seen, back = np.unique(h, return_index=True, return_inverse=True)
        long = np.flatnonzero(e - s > LONGEST_KEPT)
        at = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), dtype=bool)
        ok = at < len(self.keys)
        fresh[ok] = self.keys[at[ok]] != keys[ok]
        fresh &= e[seen] - s[seen] <= LONGEST_KEPT
        if fresh.any():
            if len(self.keys) + int(fresh.sum()) > self.capacity:
                self._clear()
                fresh = e[seen] - s[seen] <= LONGEST_KEPT
            new = np.flatnonzero(fresh)
            self._learn(keys[new], (outer[:, seen[new]], inner[:, seen[new]]), [raw[x:y] for x, y in zip(s[seen[new]].tolist(), e[seen[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        at = np.minimum(at, max(len(self.keys) - 1, 0))
        kept = e - s <= LONGEST_KEPT
        if len(self.keys):
            row, far = self.row[at][back], np.flatnonzero(kept & (e - s > 16))
            told = self.columns
            packed = told[2][row]
            if any(((told[k][row] != outer[k]) & kept).any() for k in (0, 1)) or (self.inner[:, (packed[far] >> np.uint64(40)).astype(np.int64)] != inner[:, far]).any():
                return self._each(raw, starts)
            lens, froms = (packed & np.uint64(255)).astype(np.int64), (packed >> np.uint64(8) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        else:
            lens, froms = np.zeros(len(s), dtype=np.int64), np.zeros(len(s), dtype=np.int64)
        pool = self.pool
        if len(long):  # encoded each time; their ids stand behind the table's for this slab only
            ids = self.encode_pieces([raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(s[long].tolist(), e[long].tolist())])
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            lens[long], froms[long] = n, self.used + np.cumsum(n) - n
            pool = np.concatenate([pool[: self.used], np.fromiter((x for i in ids for x in i), dtype=np.uint32, count=int(n.sum()))])
        ends = np.cumsum(lens)
        values = pool[np.repeat(froms - (ends - lens), lens) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])[np.searchsorted(s, np.concatenate([starts, [len(b)]]))]
        return values, np.diff(upto)

    def _each(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the library, text by text."""
        found = [self._whole(raw[x:y]) for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)])]
        return np.concatenate(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _whole(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(raw.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        cut: list[int] = []
        size = 0

        def flush():
            nonlocal cut, size
            if cut:
                lens = np.fromiter((len(texts[i]) for i in cut), dtype=np.int64, count=len(cut))
                raw = b"".join([texts[i] for i in cut])
                values, n = self._slab(raw, np.cumsum(lens) - lens)
                for i, part in zip(cut, np.split(values, np.cumsum(n)[:-1])):
                    out[i] = part
            cut, size = [], 0

        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, dtype=np.uint32)
            elif len(t) > SLAB or self.keeps_space and _OTHER_SPACE.search(t) or self.special and self.mark in t and self.special.search(t):
                out[i] = self._whole(t)
            else:
                if size + len(t) > SLAB:
                    flush()
                cut.append(i)
                size += len(t)
        flush()
        return out

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow string column; null is empty."""
        return self.encode([x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()])


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool, special_as_text: bool = False) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, keeps_space, special_as_text=special_as_text)


def of_vocabulary(name: str, special_as_text: bool = False) -> Encoder:
    """Encoder of a public vocabulary file; every executor finds the file for itself."""
    import public_tokenizers

    return encoder(public_tokenizers.path(name), name.startswith("byte"), special_as_text)
