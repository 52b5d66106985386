"""Mergesort of suffixes whose comparisons look prefix hashes up.

Two suffixes have a common beginning of some length; binary search finds it by
the polynomial hashes of their beginnings, so a comparison takes a logarithm of
the length. A merge finds each suffix's place by binary search in the other
run, all groups and runs at once. The result is verified by bytes: where a hash
collision made a common beginning too long or an order wrong, the group is
sorted anew by its bytes.
"""

from __future__ import annotations

import numpy as np

from spanfusion.llm import bytestrings


class Suffixes:
    """Suffixes as rows of bytes, zeros behind a row's size, with the hashes of all their beginnings."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.rows, self.sizes = rows, sizes
        self.prefix = bytestrings.beginnings(rows)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes ``x`` and ``y``, by hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.prefix[x, mid] == self.prefix[y, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def common_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same by bytes."""
        unlike = self.rows[x] != self.rows[y]
        k = np.where(unlike.any(axis=1), unlike.argmax(axis=1), self.rows.shape[1])
        return np.minimum(k, np.minimum(self.sizes[x], self.sizes[y]))

    def sign(self, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Below, equal to or above zero as ``x`` comes before, with or after ``y``; ``k`` is their common length."""
        at = np.minimum(k, self.rows.shape[1] - 1)
        a, b = (np.where(k < self.sizes[z], self.rows[z, at].astype(np.int16) + 1, 0) for z in (x, y))
        return a - b


def _merge(text: Suffixes, group: np.ndarray) -> np.ndarray | None:
    """The rows in order within each group; None if comparisons contradicted each other."""
    n = len(group)
    start = np.searchsorted(group, group)
    size = np.bincount(group)[group]
    end, order, run = start + size, np.arange(n), 1
    at = np.arange(n) - start
    while run < size.max():
        mate = start + ((at // run) ^ 1) * run
        lo, hi = np.minimum(mate, end), np.minimum(mate + run, end)
        first, later = lo.copy(), (at // run) % 2 == 1
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            x, y = order[mid], order[live]
            sign = text.sign(x, y, text.common(x, y))
            before = (sign < 0) | ((sign == 0) & later[live])
            lo[live], hi[live] = np.where(before, mid + 1, lo[live]), np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        place = start + at // (2 * run) * (2 * run) + at % run + lo - first
        if np.bincount(place, minlength=n).max() > 1:
            return None
        merged = np.empty_like(order)
        merged[place] = order
        order, run = merged, 2 * run
    return order


def ordered(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows in order within each group, and each one's common length with the one before, -1 for a group's first.

    ``group`` counts up from 0 without gaps.
    """
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = Suffixes(rows, sizes.astype(np.int64))
    order = _merge(text, group)
    if order is None:
        order, wrong = np.arange(len(group)), np.arange(group[-1] + 1)
    else:
        x, y = order[:-1], order[1:]
        known = text.common_bytes(x, y)
        bad = (group[x] == group[y]) & ((known != text.common(x, y)) | (text.sign(x, y, known) > 0))
        wrong = np.unique(group[y][bad])
    for g in wrong.tolist():
        a, b = np.searchsorted(group, (g, g + 1))
        order[a:b] = sorted(range(a, b), key=lambda i: rows[i, : sizes[i]].tobytes())
    common = np.full(len(group), -1)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    common[inner] = text.common_bytes(order[inner - 1], order[inner])
    return order, common
