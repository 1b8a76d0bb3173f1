"""A run-length index: the run-compressed Burrows-Wheeler transform of a set of strings with the suffix array sampled at run ends.

All patterns are streamed backwards side by side, one byte of each in a step, as numpy operations. Beside its row in the transform
a pattern carries the text position of that row and its matching statistic, the length of the longest match that begins at its
current byte. Where the run of its row holds another symbol, the row moves to the nearest run of the right one above or
below, whose sampled position says how much of the match survives.

Rows whose suffixes share `span` bytes are neighbours. Each such neighbourhood keeps the least value of its strings, so that a
pattern whose statistic reaches `span` reads off its row the least value of all strings that hold these bytes.
"""

from __future__ import annotations

import numpy as np

#: Symbols in the first sort, and bits of a symbol and of a string's number in its key.
FIRST, SYMBOL_BITS, NUMBER_BITS = 4, 9, 27
#: Texts up to this size triple the sorted length in a round, longer ones double it: three ranks fit in one key.
TRIPLE = 1 << 21


class RunIndex:
    def __init__(self, flat: np.ndarray, lengths: np.ndarray, values: np.ndarray, span: int):
        """flat: the bytes of all strings end to end; values: a number of each string."""
        self.span, count = span, len(lengths)
        size = int(lengths.sum()) + count
        number = np.repeat(np.arange(count), lengths + 1)
        self.symbol = np.zeros(size, np.int64)  # 0 ends a string
        inside = np.ones(size, bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        self.symbol[inside] = flat.astype(np.int64) + 1
        self._sort(number)
        above = self.symbol[self.order - 1]  # the transform
        starts = np.concatenate([[True], above[1:] != above[:-1]])
        self.first = np.flatnonzero(starts)
        self.run_of = (np.cumsum(starts) - 1).astype(np.int32)
        self.char = above[self.first]
        self.last = np.concatenate([self.first[1:], [size]]) - 1
        self.at_first, self.at_last = self.order[self.first], self.order[self.last]
        by_char = np.argsort(self.char, kind="stable")
        run_length = self.last - self.first + 1
        self.target = np.empty(len(self.first), np.int64)  # the row that a run's first row leads to
        self.target[by_char] = np.cumsum(run_length[by_char]) - run_length[by_char]
        self.n_runs = len(self.first)
        self.char_runs = self.char[by_char] * self.n_runs + by_char  # ascending: runs of a symbol in row order
        self.known = np.bincount(self.char, minlength=257) > 0
        self.origin = int(self.order[0])
        new = np.concatenate([[True], ~self._share_span(self.order[:-1], self.order[1:])])
        self.neighbourhood = (np.cumsum(new) - 1).astype(np.int32)
        self.least = np.minimum.reduceat(values[number[self.order]], np.flatnonzero(new))
        self.order = None  # only its samples at run ends are needed from here on

    def _sort(self, number: np.ndarray) -> None:
        """Suffix order. Ranks of each sorted length (first row of equal suffixes) are kept; they also answer how far two suffixes agree.

        Every end of a string differs, in the order of the strings, so no agreement crosses it.
        """
        size = len(self.symbol)
        key, part = np.zeros(size, np.int64), self.symbol
        for k in range(FIRST):
            key |= part << (SYMBOL_BITS * (FIRST - 1 - k) + NUMBER_BITS)
            if k < FIRST - 1:
                part = np.concatenate([self.symbol[k + 1 :], np.zeros(k + 1, np.int64)]) * (part > 0)
        key[part == 0] |= number[part == 0] + 1
        self.order = np.argsort(key)
        rows, rank, length = np.arange(size), np.empty(size, np.int64), FIRST
        ordered = key[self.order]
        self.ranks: list[tuple[int, np.ndarray]] = []
        fold = 3 if size <= TRIPLE else 2
        while True:
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            rank[self.order[rows]] = np.maximum.accumulate(np.where(new, rows, 0))
            if length <= self.span:
                self.ranks.append((length, rank.astype(np.int32)))
            several = ~(new & np.concatenate([new[1:], [True]]))
            rows = rows[several]
            if not len(rows):
                return
            at = self.order[rows]
            key = rank[at]
            for k in range(1, fold):
                key = key * size + rank[np.minimum(at + k * length, size - 1)]
            order = np.argsort(key)
            self.order[rows], ordered = at[order], key[order]
            length *= fold

    def _share_span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b agree on span symbols."""
        length, rank = self.ranks[-1]
        out = rank[a] == rank[b]
        for step in range(length, self.span, length):
            k = min(step, self.span - length)
            a_, b_ = a[out] + k, b[out] + k
            out[out] = rank[a_] == rank[b_]
        return out

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at two different positions share, exact up to span."""
        a, b, total, left = a.copy(), b.copy(), np.zeros(len(a), np.int64), self.span
        for length, rank in reversed(self.ranks):
            for _ in range(left // length):
                step = (rank[a] == rank[b]) * length
                a += step
                b += step
                total += step
            left = min(left, length - 1) if left >= length else left
        for _ in range(left):
            step = (self.symbol[a] == self.symbol[b]) & (self.symbol[a] > 0)
            a += step
            b += step
            total += step
        return total

    def stream(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the patterns (end to end): the matching statistic, exact up to span, and where it reaches span the least value."""
        out, least = np.zeros(len(flat), np.int64), np.full(len(flat), np.iinfo(np.int64).max)
        order = np.argsort(-lengths, kind="stable")
        ends, sizes = np.cumsum(lengths)[order], lengths[order]
        row, place, length = np.zeros(len(order), np.int64), np.full(len(order), self.origin), np.zeros(len(order), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # patterns longer than step
            row, place, length = row[:live], place[:live], length[:live]
            at = ends[:live] - 1 - step
            c = flat[at].astype(np.int64) + 1
            known, run = self.known[c], self.run_of[row].astype(np.int64)
            away = np.flatnonzero(known & (self.char[run] != c))
            if len(away):
                slot = np.searchsorted(self.char_runs, c[away] * self.n_runs + run[away])
                best, new_run, new_row, new_place = np.full(len(away), -1), run[away], row[away], place[away]
                for near, rows, places in ((slot - 1, self.last, self.at_last), (slot, self.first, self.at_first)):
                    there = (near >= 0) & (near < self.n_runs)
                    owner, r = np.divmod(self.char_runs[near.clip(0, self.n_runs - 1)], self.n_runs)
                    there &= owner == c[away]
                    agreed = np.full(len(away), -1)
                    agreed[there] = self.agree(place[away[there]], places[r[there]])
                    better = agreed > best
                    best, new_run = np.where(better, agreed, best), np.where(better, r, new_run)
                    new_row, new_place = np.where(better, rows[r], new_row), np.where(better, places[r], new_place)
                run[away], row[away], place[away] = new_run, new_row, new_place
                length[away] = np.minimum(length[away], best)
            row = np.where(known, self.target[run] + row - self.first[run], 0)
            place = np.where(known, place - 1, self.origin)
            length = np.where(known, np.minimum(length + 1, self.span), 0)
            out[at] = length
            full = np.flatnonzero(length >= self.span)
            least[at[full]] = self.least[self.neighbourhood[row[full]]]
        return out, least
