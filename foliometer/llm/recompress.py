"""Recompression of word sequences: runs and pairs get consistent names.

A round replaces each run of an equal symbol by one symbol (block compression,
in every second round, as it widens what a name depends on), then each adjacent pair (a, b) with a on the left and b on the
right side of a seeded split of all symbols by one symbol (pair compression).
A name is two 64-bit hashes of what it stands for, worked out apart from the words'
bytes on, so the name of a run or a pair is the same in every task, document and
executor without any table of names.

Every symbol carries the words it covers and the words its name depends on
(its cover and the neighbours that kept it from joining others). Where a stretch
of words is repeated, each symbol whose dependence lies in the stretch is
repeated as well: these are the consistent interior symbols.

The consistent interior symbols of a stretch are side by side in each round, and
those of a round lie within those of the round before. So a stretch is, in one way
only, the symbols of the last round in its middle, on both sides of them those of
the round before that these leave over, and so on down to words: its decomposition.
Stretches are equal just where their decompositions are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .words import BASE, mix

_RUN, _PAIR, _SIDE = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_RUN2, _PAIR2 = np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)
_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


class Level(NamedTuple):
    """The symbols after a round. need_lo, need_hi: the words a name depends on, in ascending order; first: which symbol of the round before each begins with."""

    name: np.ndarray
    second: np.ndarray
    need_lo: np.ndarray
    need_hi: np.ndarray
    first: np.ndarray


class Parse:
    """Symbols over a run of texts. text: which text each is in; need_lo, need_hi: the words its name depends on, beyond the text's own words where it depends on the text's edge."""

    def __init__(self, names: np.ndarray, text: np.ndarray, second: np.ndarray | None = None) -> None:
        self.name, self.text = names.copy(), text
        self.second = names ^ _RUN2 if second is None else second
        self.need_lo, self.need_hi = np.arange(len(names)), np.arange(1, len(names) + 1)
        self.first = np.arange(len(names))
        self.levels: list[Level] = []
        self._level()

    def _level(self) -> None:
        # beside a text's edge needs may cross, but only outside of either text
        lo = np.maximum.accumulate(self.need_lo)
        hi = np.minimum.accumulate(self.need_hi[::-1])[::-1]
        self.levels.append(Level(self.name, self.second, lo, hi, self.first))
        self.first = np.arange(len(self.name))

    def round(self, number: int) -> None:
        if number % 2 == 0:
            self._runs()
        self._pairs(number)
        self._level()

    def _runs(self) -> None:
        name, text = self.name, self.text
        if len(name) < 2:
            return
        begins = np.ones(len(name), dtype=bool)
        begins[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(begins)
        end = np.append(at[1:], len(name)) - 1
        lo, hi = self.need_lo, self.need_hi
        new, new2 = name[at], self.second[at]
        many = np.flatnonzero(end > at)
        size = (end - at)[many].astype(np.uint64) * np.uint64(2) + np.uint64(1)
        new[many] = mix((new[many] ^ _RUN) * size)
        new2[many] = mix((new2[many] ^ _RUN2) * size)
        # how long a run is, a run of one as well, depends on the symbols beside it
        before, after = np.maximum(at - 1, 0), np.minimum(end + 1, len(name) - 1)
        edge = (at == 0) | (text[at] != text[before])
        new_lo = np.where(edge, lo[at] - 1, lo[before])
        edge = (end == len(name) - 1) | (text[end] != text[after])
        self.need_hi = np.where(edge, hi[end] + 1, hi[after])
        self.name, self.second, self.text, self.need_lo, self.first = new, new2, text[at], new_lo, self.first[at]

    def _pairs(self, number: int) -> None:
        name, text, lo, hi = self.name, self.text, self.need_lo, self.need_hi
        if len(name) < 2:
            return
        left = (mix((name ^ _SIDE) + np.uint64(number)) & np.uint64(1)).astype(bool)
        same = text[1:] == text[:-1]
        joins = left[:-1] & ~left[1:] & same
        new_lo, new_hi, new, new2 = lo.copy(), hi.copy(), name.copy(), self.second.copy()
        # one that joins none depends on the neighbour that it might have joined
        alone = np.ones(len(name), dtype=bool)
        at = np.flatnonzero(joins)
        alone[at] = alone[at + 1] = False
        x = np.flatnonzero(alone & left)
        inner = x < len(name) - 1
        inner[inner] = same[x[inner]]
        new_hi[x] = np.where(inner, np.maximum(hi[x], hi[np.minimum(x + 1, len(name) - 1)]), hi[x] + 1)
        x = np.flatnonzero(alone & ~left)
        inner = x > 0
        inner[inner] = same[x[inner] - 1]
        new_lo[x] = np.where(inner, np.minimum(lo[x], lo[np.maximum(x - 1, 0)]), lo[x] - 1)
        new[at] = mix((name[at] * _PAIR) ^ mix(name[at + 1] + np.uint64(number)))
        new2[at] = mix((new2[at] * _PAIR2) ^ mix(new2[at + 1] + np.uint64(number)))
        new_lo[at] = np.minimum(lo[at], lo[at + 1])
        new_hi[at] = np.maximum(hi[at], hi[at + 1])
        keep = np.ones(len(name), dtype=bool)
        keep[at + 1] = False
        self.name, self.second, self.text, self.need_lo, self.need_hi, self.first = new[keep], new2[keep], text[keep], new_lo[keep], new_hi[keep], self.first[keep]

    def decompositions(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For the stretches of `size` words at `starts` (each in one text), two hashes of their decompositions, of either name."""
        out, out2 = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(self.levels[0].name), BASE))))
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(self.levels[0].name), _BACK))))
        begin = np.searchsorted(self.levels[0].need_lo, starts)
        end = np.searchsorted(self.levels[0].need_hi, starts + size, side="right")
        for k, level in enumerate(self.levels):
            if k + 1 < len(self.levels):
                above = self.levels[k + 1]
                next_begin = np.searchsorted(above.need_lo, starts)
                next_end = np.maximum(np.searchsorted(above.need_hi, starts + size, side="right"), next_begin)
                first = np.append(above.first, len(level.name))
                none = next_begin == next_end
                # where the next round has none, all that is left belongs to this one
                stop, resume = np.where(none, end, first[next_begin]), np.where(none, end, first[next_end])
            else:
                stop = resume = end
            for names, into in ((level.name, out), (level.second, out2)):
                sums = np.concatenate(([np.uint64(0)], np.cumsum(names * power[: len(names)])))
                into += (sums[stop] - sums[begin]) * back[begin] * np.uint64(4 * k + 1)
                into += (sums[end] - sums[resume]) * back[resume] * np.uint64(4 * k + 3)
            if k + 1 < len(self.levels):
                begin, end = np.where(none, 0, next_begin), np.where(none, 0, next_end)
        return mix(out), mix(out2)


def parse(names: np.ndarray, text: np.ndarray, rounds: int, second: np.ndarray | None = None) -> Parse:
    out = Parse(names, text, second)
    for k in range(rounds):
        out.round(k)
    return out
