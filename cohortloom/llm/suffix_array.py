"""Blockwise suffix sorting with a difference cover: one bucket of suffixes at a time, long ties by cover-sample ranks.

A difference cover of period ``v`` is a set of residues in which every difference modulo ``v`` occurs. So for any two
suffixes there is a shift below ``v`` that brings both to sampled positions. The sampled suffixes are ranked once. A
bucket is then sorted by its first ``v`` bytes only, and suffixes that tie there are told apart by the ranks at their
common shift; a tie of three residues or more that has no common shift is read on to ``depth``. Memory beyond the text is
one bucket and the sample, however many suffixes tie.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Zero bytes that must follow the text.
PADDING = 128


@lru_cache(maxsize=8)
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues that cover every difference modulo ``v``, grown greedily."""
    cover = [0, 1]
    missing = set(range(v)) - {(a - b) % v for a in cover for b in cover}
    while missing:
        gain = {r: len(missing & ({(r - c) % v for c in cover} | {(c - r) % v for c in cover})) for r in range(v)}
        cover.append(max(gain, key=lambda r: (gain[r], -r)))
        missing -= {(a - b) % v for a in cover for b in cover}
    return tuple(sorted(cover))


def words_at(text: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """The eight bytes from ``at + offset`` on as a number that sorts like them."""
    view = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    return view[at + offset].byteswap()


def _sorted_by_words(text: np.ndarray, at: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first ``8 * n_words`` bytes, and the tie class of each in that order. Only suffixes
    that still tie are looked at again."""
    first = words_at(text, at, 0)
    order = np.argsort(first)
    first = first[order]
    tie = np.cumsum(np.r_[True, first[1:] != first[:-1]]) - 1 if len(at) else np.empty(0, np.int64)
    for k in range(1, n_words):
        size = np.bincount(tie)
        open_ = np.flatnonzero(size[tie] > 1)
        if not len(open_):
            break
        rows = order[open_]
        word = words_at(text, at[rows], 8 * k)
        by_word = np.argsort(word)
        place = np.empty(len(word), np.int64)
        place[by_word] = np.cumsum(np.r_[False, np.diff(word[by_word]) > 0])
        again = np.argsort(tie[open_] * (len(word) + 1) + place)
        order[open_], word = rows[again], word[again]
        new = np.zeros(len(tie), bool)
        new[np.r_[True, tie[1:] != tie[:-1]]] = True
        same = np.flatnonzero((word[1:] != word[:-1]) & (tie[open_][1:] == tie[open_][:-1])) + 1
        new[open_[same]] = True
        tie = np.cumsum(new) - 1
    return order, tie


class SuffixSorter:
    """Sorts suffixes of a text by their first ``depth`` bytes or more. ``text`` ends in ``PADDING`` zero bytes.

    ``within`` marks the places less than ``v`` after a suffix that will be sorted; only these are sampled.
    """

    def __init__(self, text: np.ndarray, depth: int = 50, v: int = 32, within: np.ndarray | None = None):
        self.text, self.depth, self.v = text, depth, v
        self.cover = np.zeros(v, bool)
        self.cover[list(difference_cover(v))] = True
        size = len(text) - PADDING
        sample = np.flatnonzero(self.cover[np.arange(v)])
        sample = (np.arange(0, size + v, v)[:, None] + sample).ravel()
        sample = sample[sample < size + v] if within is None else sample[sample < size][within[sample[sample < size]]]
        order, tie = _sorted_by_words(text, sample, -(-depth // 8))
        self.rank = np.zeros(size + 2 * v, np.uint32)
        self.rank[sample[order]] = tie
        # Bit d of shifts[r]: a position of residue r comes to a sampled one by the shift d.
        self.shifts = np.array([sum(1 << d for d in range(v) if self.cover[(r + d) % v]) for r in range(v)], np.uint64)

    def sort(self, at: np.ndarray) -> np.ndarray:
        """One bucket: suffixes by their first ``v`` bytes, ties by cover ranks."""
        order, tie = _sorted_by_words(self.text, at, self.v // 8)
        tied = np.flatnonzero(np.bincount(tie)[tie] > 1) if len(at) else np.empty(0, np.int64)
        if not len(tied):
            return at[order]
        rows, group = order[tied], tie[tied]
        opens = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        shared = np.bitwise_and.reduceat(self.shifts[at[rows] % self.v], opens)
        low = shared & (~shared + np.uint64(1))
        shift = np.where(shared > 0, np.bitwise_count(low - np.uint64(1)), 0).astype(np.int64)
        sizes = np.diff(np.r_[opens, len(group)])
        order[tied] = rows[np.lexsort([self.rank[at[rows] + np.repeat(shift, sizes)], group])]
        # Three residues or more may have no shift in common: their bytes are read on to the full depth.
        rest = np.repeat(shared == 0, sizes)
        if rest.any():
            rows = order[tied[rest]]
            words = [words_at(self.text, at[rows], k) for k in range(-(-self.depth // 8) * 8 - 8, self.v - 1, -8)]
            order[tied[rest]] = rows[np.lexsort([*words, group[rest]])]
        return at[order]

    def buckets(self, at: np.ndarray, most: int = 1 << 18):
        """Splits suffixes by their first eight bytes into buckets of about ``most``; equal heads share a bucket."""
        if len(at) <= most:
            yield at
            return
        head = words_at(self.text, at, 0)
        edges = np.unique(np.quantile(head, np.linspace(0, 1, -(-len(at) // most) + 1)[1:-1], method="nearest"))
        place = np.searchsorted(edges, head, side="right")
        for k in range(len(edges) + 1):
            part = at[place == k]
            if len(part):
                yield part

    def classes(self, at: np.ndarray):
        """For each bucket: its suffixes in order, and classes of those that agree in ``depth`` bytes."""
        for bucket in self.buckets(at):
            ordered = self.sort(bucket)
            apart = np.zeros(len(ordered), bool)
            apart[:1] = True
            for offset in [*range(0, self.depth - 8, 8), self.depth - 8]:
                word = words_at(self.text, ordered, offset)
                apart[1:] |= word[1:] != word[:-1]
            yield ordered, np.cumsum(apart) - 1
