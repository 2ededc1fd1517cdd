"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

The operators of this subpackage split texts at ASCII characters only, so a
split of the bytes is exact for UTF-8. Nothing here makes a Python string per
word: a batch of texts becomes arrays of word starts, ends and 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a slice by itself.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of bytes other than space and \t \n \v \f \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are runs of ASCII digits, ASCII letters and bytes of other characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_C4, _C5 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a run of texts.

    data   the bytes of all texts, end to end (lower-cased if asked for)
    start, end   byte positions of each word in data
    first  for text i, its words are first[i] to first[i + 1]
    hash   a 64-bit hash of each word's bytes
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool) -> None:
        if texts.null_count:
            texts = texts.fill_null("")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        _, at, raw = texts.buffers()
        offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        n = int(offsets[-1] - offsets[0])
        self.size = n
        self.offsets = offsets - offsets[0]
        padded = np.zeros(n + 16, dtype=np.uint8)
        if n:
            part = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
            padded[:n] = _LOWER[part] if lower else part
        self.data = padded[:n]
        self._padded = padded
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = kind[self.data]
        self._inside = inside[1:-1]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] |= inside[edges + 1]
        ends[edges - 1] |= inside[edges]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            at8 = np.ndarray(shape=(self.size + 8,), dtype="<u8", buffer=self._padded, strides=(1,))
            length = self.end - self.start
            h = length.astype(np.uint64) * _C3
            h ^= at8[self.start] & _MASK[np.minimum(length, 8)]
            mix(h)
            rest, done = np.flatnonzero(length > 8), 8
            while len(rest):
                h[rest] = mix((h[rest] * _C3) ^ (at8[self.start[rest] + done] & _MASK[np.minimum(length[rest] - done, 8)]))
                done += 8
                rest = rest[length[rest] > done]
            self._hash = h
        return self._hash

    def second(self) -> np.ndarray:
        """Another 64-bit hash of each word's bytes, worked out from the bytes and not from the first."""
        at8 = np.ndarray(shape=(self.size + 8,), dtype="<u8", buffer=self._padded, strides=(1,))
        length = self.end - self.start
        h = mix(length.astype(np.uint64) * _C4 + (at8[self.start] & _MASK[np.minimum(length, 8)]) * _C5)
        rest, done = np.flatnonzero(length > 8), 8
        while len(rest):
            h[rest] = mix((h[rest] ^ _C4) * _C5 + (at8[self.start[rest] + done] & _MASK[np.minimum(length[rest] - done, 8)]))
            done += 8
            rest = rest[length[rest] > done]
        return h

    def heads(self) -> np.ndarray:
        """The first eight bytes of each word as a number; zeros after a shorter one."""
        at8 = np.ndarray(shape=(self.size + 8,), dtype="<u8", buffer=self._padded, strides=(1,))
        return at8[self.start] & _MASK[np.minimum(self.end - self.start, 8)]

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than `size` bytes (at most 8), and a hash of the first `size` of each."""
        at = np.flatnonzero(self.end - self.start > size)
        at8 = np.ndarray(shape=(self.size + 8,), dtype="<u8", buffer=self._padded, strides=(1,))
        return at, mix((at8[self.start[at]] & _MASK[size]) ^ (np.uint64(size) * _C3))

    @property
    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, which text it is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each; where each starts and ends there."""
        length = self.end - self.start
        begin = np.concatenate(([0], np.cumsum(length + 1)[:-1])) if len(self) else np.zeros(0, np.int64)
        out = np.full(int(length.sum()) + len(self), 32, dtype=np.uint8)
        place = np.ones(len(out), dtype=bool)
        place[begin + length] = False
        out[place] = self.data[self._inside]
        return out.tobytes(), begin, begin + length

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def windows(h: np.ndarray, k: int, mixed: bool = True) -> np.ndarray:
    """Hash of each k consecutive entries of h; the last k - 1 have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, have, power, at, factor = None, 0, h, 1, BASE
    with np.errstate(over="ignore"):
        while True:  # binary doubling: power holds the hash of runs of `at`
            if k & at:
                if out is None:
                    out, have = power[: len(h) - at + 1].copy(), at
                else:
                    m = len(h) - have - at + 1
                    out = out[:m] * factor + power[have : have + m]
                    have += at
            if have == k:
                break
            m = len(power) - at
            power = power[:m] * factor + power[at : at + m]
            factor = factor * factor
            at *= 2
    out = out[:n].copy() if out.base is not None else out[:n]
    return mix(out) if mixed else out


def within(words: Words, k: int) -> np.ndarray:
    """Starts of the runs of k words that lie in one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    last = np.repeat(words.first[1:], words.counts)
    i = np.arange(n)
    return i[i + k <= last[:n]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size)
        begin = 0
        while begin < batch.num_rows:
            base = part[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(part, base + most, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
