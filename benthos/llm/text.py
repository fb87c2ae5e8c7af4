"""Vectorised word and shingle hashing over Arrow string batches (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD, _KEY = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x2545F4914F6CDD1D)
#: Words beyond this many bytes are hashed one by one with a cryptographic hash.
LONG_WORD = 64
#: The lowest i bytes of a lane of eight.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20


def release_memory() -> None:
    """Give memory that was freed back to the system, where the C library and Arrow's pool can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over batches, after which memory is given back.

    Workers live on for later tasks and stages and would else keep what their largest batch took.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; one row at least."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some rows: byte spans, row of each, 64-bit hash.

    The hash mixes eight bytes at a time through a permutation that is not linear, so no two
    words of up to eight bytes and one length share a hash, and no structure of longer words
    makes them collide; words beyond LONG_WORD bytes take a keyed blake2b. ``distinct`` tells
    words apart by their bytes, whatever their hashes are.
    """

    one_to_one = True  # whether the hash of a lane can be undone

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True):
        b = data[off[0] : off[-1]]
        off = off - off[0]
        b = _LOWER[b] if lower else b
        self.bytes, self.off, self.rows = b, off, len(off) - 1
        self.start, self.end = self._spans(self._breaks()[b], off)
        self.row = np.searchsorted(off, self.start, "right") - 1
        self._padded = np.concatenate([b, np.zeros(8, np.uint8)])
        self.hash = self._hashes()

    @staticmethod
    def _breaks() -> np.ndarray:
        """Which bytes lie in no word."""
        return _SPACE

    def _spans(self, space: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words, none of which lies in two rows."""
        n = len(space)
        first = np.zeros(n + 1, bool)
        first[off] = True
        before = np.empty(n, bool)
        before[1:] = space[:-1]
        before[:1] = True
        after = np.empty(n, bool)
        after[:-1] = space[1:]
        after[n - 1 :] = True
        return np.flatnonzero(~space & (before | first[:n])), np.flatnonzero(~space & (after | first[1:])) + 1

    def _lane(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Eight bytes from each position, those beyond ``left`` cleared."""
        eight = np.ndarray(len(self._padded) - 7, "<u8", self._padded, strides=(1,))
        return eight[at] & _MASK[np.minimum(left, 8)]

    def _hashes(self) -> np.ndarray:
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _ODD + _KEY)
        live, at, left = slice(None), self.start, size
        for _ in range(LONG_WORD // 8):
            h[live] = mix((h[live] ^ self._lane(at, left)) * _ODD + _KEY)
            more = left > 8
            if not more.any():
                return h
            live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
        for i in live.tolist():  # the few words beyond LONG_WORD bytes
            h[i] = int.from_bytes(blake2b(self.bytes[self.start[i] : self.end[i]].tobytes(), digest_size=8, key=b"words").digest(), "little")
        return h

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, back): an occurrence of each distinct word, and each occurrence's number among them.

        Words are grouped by hash and then compared with the group's first word byte by byte;
        words of one hash that differ are numbered apart.
        """
        _, first, back = np.unique(self.hash, return_index=True, return_inverse=True)
        own, other = np.arange(len(back)), first[back]
        size = self.end - self.start
        odd = size != size[other]
        # of one length up to eight bytes, equal hashes mean equal words
        live = np.flatnonzero(~odd & (own != other) & (size > (8 if self.one_to_one else 0)))
        at = 0
        while len(live):
            left = size[live] - at
            differs = self._lane(self.start[live] + at, left) != self._lane(self.start[other[live]] + at, left)
            odd[live[differs]] = True
            live = live[~differs & (left > 8)]
            at += 8
            if at >= LONG_WORD:
                for i in live.tolist():
                    odd[i] = self.text(i) != self.text(int(other[i]))
                break
        if odd.any():
            known: dict[bytes, int] = {}
            extra = []
            for i in np.flatnonzero(odd).tolist():
                if (w := self.text(i)) not in known:
                    known[w] = len(first) + len(extra)
                    extra.append(i)
                back[i] = known[w]
            first = np.concatenate([first, np.array(extra, first.dtype)])
        return first, back

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, and the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


_WIDE_SPACE = [chr(c).encode() for c in range(0x80, 0x3001) if chr(c).isspace()]


class SpacedWords(Words):
    """Words together with the white space before them; white space at a row's end is one more.

    Without a break where other white space than ASCII's comes before ASCII's, since the two
    may belong together. The units of a row are its whole bytes.
    """

    def _spans(self, space: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = super()._spans(space, off)[1]
        wide = np.zeros(len(end), bool)
        for c in _WIDE_SPACE:
            hit = end >= len(c)
            for k, byte in enumerate(reversed(c), 1):
                hit &= self.bytes[np.maximum(end - k, 0)] == byte
            wide |= hit
        cut = np.zeros(len(space) + 1, bool)
        cut[end[~wide]] = True
        cut[off[1:]] = True  # a row's end is a border, whatever it ends with
        cut[0] = False
        end = np.flatnonzero(cut)
        return np.concatenate(([0], end[:-1])) if len(end) else end, end


def combine(acc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix((acc ^ h) * _ODD + _KEY)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its k-word shingles.

    Fewer than k words: the whole sequence is one shingle; no word: an empty set.
    """
    seeds = [np.uint64(j + 1) for j in range(k + 1)]
    for lo, hi in chunks(off):
        w = Words(data, off[lo : hi + 1])
        at, h = w.bounds(), w.hash
        m = max(0, len(h) - k + 1)
        acc = np.full(m, seeds[k], np.uint64)
        for j in range(k):
            acc = combine(acc, h[j : j + m])
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            if z - a >= k:
                yield np.unique(acc[a : z - k + 1])
            elif z > a:
                one = np.full(1, seeds[z - a], np.uint64)
                for j in range(a, z):
                    one = combine(one, h[j : j + 1])
                yield one
            else:
                yield np.zeros(0, np.uint64)


def shared_shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the k-word shingle sets of all rows, and the overlaps of rows 0 and 1, 2 and 3, and so on.

    No hash decides here: words are told apart by their bytes, and a shingle is the exact
    sequence of its words' numbers. Rows of fewer words are one shingle, those without, none.
    """
    w = Words(data, off)
    _, ids = w.distinct()
    at = w.bounds()
    count = np.diff(at)
    known = int(ids.max()) + 1 if len(ids) else 1
    m = max(0, len(ids) - k + 1)
    seq = ids[:m].astype(np.int64)
    for j in range(1, k):  # numbers of the distinct prefixes of j + 1 words
        _, seq = np.unique(seq * known + ids[j : j + m], return_inverse=True)
    inside = np.flatnonzero(w.row[:m] == w.row[k - 1 : k - 1 + m])
    rows, seq, most = w.row[inside].astype(np.int64), seq[inside].astype(np.int64), len(ids) + 1
    short: dict[tuple, int] = {}
    less = np.flatnonzero((count > 0) & (count < k))
    few = [short.setdefault(tuple(ids[at[r] : at[r] + count[r]].tolist()), most + len(short)) for r in less.tolist()]
    rows, seq = np.concatenate([rows, less.astype(np.int64)]), np.concatenate([seq, np.array(few, np.int64)])
    span = most + len(short) + 1
    cells = np.unique(rows * span + seq)
    rows, seq = cells // span, cells % span
    sizes = np.bincount(rows, minlength=w.rows)
    both = np.sort((rows // 2) * span + seq)
    twice = both[1:][both[1:] == both[:-1]] // span
    return sizes, np.bincount(twice, minlength=w.rows // 2)
