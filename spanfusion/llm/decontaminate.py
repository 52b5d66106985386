"""Benchmark decontamination with spaced seeds.

A seed hashes the words under a fixed mask and ignores the others, so it
survives a changed word at an ignored place. Seeds of all documents meet those
of the benchmark; around each hit the words of document and item are compared
place by place, which counts as an overlap if enough of the item is there.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfusion.llm.common import codes, filter_slices, map_slices, word_hash
from spanfusion.llm.language import lower_in_place

# The masks, as places in a run of words.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 5), (0, 2, 3, 6), (0, 1, 4, 6), (0, 3, 4, 5), (0, 1, 5, 7))
SPAN = 1 + max(m[-1] for m in MASKS)
MIN_SHARE = 0.8
MIN_RUN = 13
DRIFT = 4
BLOCK_BYTES = 16 << 20
BITS = 22  # of the bitmap of a mask's seeds, at most
HELD = 1 << 21  # hits that are held at a time

_ALNUM: list[np.ndarray] = []


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased run of letters and digits, and the number of words of each text."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000))
    lower = [lower_in_place(t or "") for t in texts]
    c = codes("\n".join([*lower, ""]))
    edge = np.flatnonzero(np.diff(_ALNUM[0][c].view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lower])))
    count = np.diff(np.searchsorted(begin, base))
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), count
    size = end - begin
    at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return word_hash(c[at], size), count


def seeds(w: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each place's words under ``mask``."""
    n = len(w) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for o in mask:
            out = out * np.uint64(0xD6E8FEB86659FD93) + w[o : o + n]
            out ^= out >> np.uint64(29)
    return out


def short_masks(n: int, share: float) -> list[tuple[int, ...]]:
    """The places of an item of ``n`` words that are left by each choice of as many changed words as ``share`` allows."""
    return list(combinations(range(n), max(1, math.ceil(share * n - 1e-9)))) if n else []


def index(items: list[tuple[int, str | None]], share: float = MIN_SHARE) -> dict:
    """Seeds of the items, by mask; an item shorter than SPAN words has a seed for each choice of changed words."""
    w, count = word_hashes([t for _, t in items])
    at = np.cumsum(count) - count
    words = [w[a : a + n] for a, n in zip(at, count, strict=True)]
    masks = {}
    for i, own in enumerate(words):
        for mask in MASKS if len(own) >= SPAN else short_masks(len(own), share):
            first = mask[0]
            mask = tuple(m - first for m in mask)
            h = seeds(own[first:], mask)[: None if len(own) >= SPAN else 1]
            masks.setdefault(mask, []).append(np.stack([h, np.full(len(h), i, np.uint64), np.arange(first, first + len(h), dtype=np.uint64)]))
    tables = {}
    for mask, parts in masks.items():
        h, i, k = np.concatenate(parts, axis=1)
        order = np.argsort(h, kind="stable")
        wide = min(BITS, max(12, int(16 * len(h)).bit_length()))
        bits = np.zeros(1 << wide, dtype=bool)
        bits[h >> np.uint64(64 - wide)] = True
        tables[mask] = (h[order], i[order].astype(np.int64), k[order].astype(np.int64), np.packbits(bits))
    return {"ids": [i for i, _ in items], "words": words, "tables": tables}


def overlap(doc: np.ndarray, item: np.ndarray, diagonals: list[int], share: float, run: int, starts: list[int] | None = None) -> tuple[int, int, int] | None:
    """Item words found on diagonals near each other, first and last+1 word in the document; None if too few. With ``starts`` only stretches that begin on one of these are looked at."""
    best = None
    diagonals = sorted(diagonals)
    for d in diagonals if starts is None else starts:
        found = np.zeros(len(item), dtype=bool)
        longest, lo, hi = 0, len(doc), 0
        for near in diagonals[bisect_left(diagonals, d) : bisect_right(diagonals, d + DRIFT)]:
            a, b = max(0, -near), min(len(item), len(doc) - near)
            same = item[a:b] == doc[near + a : near + b]
            if near == d:
                longest = _dense(same, share)
            found[a:b] |= same
            if same.any():
                places = np.flatnonzero(same) + near + a
                lo, hi = min(lo, int(places[0])), max(hi, int(places[-1]) + 1)
        n = int(found.sum())
        if (n >= share * len(item) or longest >= run) and (best is None or n > best[0]):
            best = (n, lo, hi)
    return best


def _stretches(n: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ``n`` whose numbers add up to about HELD."""
    cuts = [0, *(np.searchsorted(np.cumsum(n), np.arange(HELD, int(n.sum()), HELD), "left") + 1).tolist(), len(n)]
    return [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]


def _dense(same: np.ndarray, share: float) -> int:
    """Length of the longest stretch of which at least ``share`` is true."""
    total = np.concatenate(([0.0], np.cumsum(same - share)))
    low = np.minimum.accumulate(total)
    best = 0
    for end in range(len(same), 0, -1):
        if end <= best:
            break
        best = max(best, end - int(np.searchsorted(-low, -(total[end] + 1e-9))))
    return best


def overlaps(documents: DataFrame, benchmark: DataFrame, share: float = MIN_SHARE, run: int = MIN_RUN) -> DataFrame:
    """doc_id, item_id, n_match, n_item, share, first_word and last_word of each overlap.

    A document holds an item if at least ``share`` of the item's words stand
    in it at their places, an inserted or missing word or two apart, or if a
    stretch of ``run`` words does; words are runs of letters and digits in
    lower case. Only such pairs give rows, one for each document row and item
    row, with the best place (the first of equals). Missing or empty texts
    overlap with nothing. The benchmark is the stated query set: it is taken
    in blocks of BLOCK_BYTES of text, each of which is one broadcast.
    """
    out = None
    for shared in _blocks(documents, benchmark, share):
        found = _against(documents, shared, share, run)
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, share: float = MIN_SHARE, run: int = MIN_RUN, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that overlap no item of the benchmark, with all columns."""
    for shared in _blocks(documents, benchmark, share):

        def build(shared=shared):
            scan = Scanner(shared.value, share, run)

            def keep(texts):
                held = {d for d, *_ in scan(texts)}
                return [i not in held for i in range(len(texts))]

            return keep

        documents = filter_slices(documents, build, text)
    return documents


def _blocks(documents: DataFrame, benchmark: DataFrame, share: float) -> list:
    """Broadcasts of the benchmark's seeds, BLOCK_BYTES of text in each."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    out = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        out.append(documents.sparkSession.sparkContext.broadcast(index([(r[0], r[1]) for r in own], share)))
    return out


class Scanner:
    """Finds the overlaps of texts with the items of one block."""

    def __init__(self, ix: dict, share: float, run: int) -> None:
        self.ids, self.words, self.share, self.run = ix["ids"], ix["words"], share, run
        self.tables = {m: (h, i, k, np.unpackbits(b).view(bool)) for m, (h, i, k, b) in ix["tables"].items()}
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """(text, item, item's words found, first, last+1 word), by text and item."""
        w, count = word_hashes(texts)
        at = np.cumsum(count) - count
        hits = [self._hits(w, at, count, mask) for mask in self.tables]
        parts = max(1, -(-sum(int(n.sum()) for _, _, n, _ in hits) // HELD))
        out = []
        for part in range(parts):
            out += self._weighed(w, at, count, self._diagonals(hits, at, part, parts))
        return sorted(out)

    def _hits(self, w: np.ndarray, at: np.ndarray, count: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, ...]]:
        """Places whose seed is one of the benchmark's: place, first entry and number of entries in the mask's table."""
        h, _, _, bits = self.tables[mask]
        s = seeds(w, mask)
        near = np.flatnonzero(bits[s >> np.uint64(65 - len(bits).bit_length())])
        left, right = np.searchsorted(h, s[near], "left"), np.searchsorted(h, s[near], "right")
        d = np.searchsorted(at, near, side="right") - 1
        hit = (left < right) & (near + mask[-1] < at[d] + count[d])
        return near[hit], left[hit], (right - left)[hit], mask

    def _diagonals(self, hits: list[tuple], at: np.ndarray, part: int, parts: int) -> np.ndarray:
        """(text, item, diagonal) of the hits of one part of the items, distinct and in order."""
        longest = int(self.size.max()) if len(self.size) else 0
        wide = longest + (int(max(p.max() for p, *_ in hits if len(p))) if any(len(p) for p, *_ in hits) else 0) + 1
        found = [np.zeros(0, np.int64)]
        for p, a, n, mask in hits:
            _, item, place, _ = self.tables[mask]
            for x, y in _stretches(n):
                each = n[x:y]
                k = np.arange(int(each.sum())) + np.repeat(a[x:y] - (np.cumsum(each) - each), each)
                spot = np.repeat(p[x:y], each)
                own = item[k] % parts == part
                k, spot = k[own], spot[own]
                d = np.searchsorted(at, spot, side="right") - 1
                found.append(np.unique((d * len(self.words) + item[k]) * wide + (spot - at[d] - place[k] + longest)))
        pair, diagonal = np.divmod(np.unique(np.concatenate(found)), wide)
        return np.stack([pair // len(self.words), pair % len(self.words), diagonal - longest]) if len(pair) else np.zeros((3, 0), np.int64)

    def _weighed(self, w: np.ndarray, at: np.ndarray, count: np.ndarray, keys: np.ndarray) -> list[tuple]:
        """The overlaps among (text, item, diagonal); those whose words on near diagonals are too few are not looked at closer."""
        d, i, diagonal = keys
        if not len(d):
            return []
        lo, hi = np.maximum(0, -diagonal), np.minimum(self.size[i], count[d] - diagonal)
        same = np.zeros(len(d), np.int64)
        for x, y in _stretches(hi - lo):
            n = (hi - lo)[x:y]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo[x:y], n)
            hit = w[np.repeat((at[d] + diagonal)[x:y], n) + k] == self.flat[np.repeat(self.start[i[x:y]], n) + k]
            sums = np.concatenate(([0], np.cumsum(hit)))
            same[x:y] = sums[np.cumsum(n)] - sums[np.cumsum(n) - n]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
        group = np.cumsum(new) - 1
        line = group * (int(diagonal.max() - diagonal.min()) + DRIFT + 2) + diagonal - diagonal.min()
        upto = np.searchsorted(line, line + DRIFT, "right")
        sums = np.concatenate(([0], np.cumsum(same)))
        good = (sums[upto] - sums[:-1] >= self.share * self.size[i] - 1e-9) | (same >= self.share * self.run - 1e-9)
        out = []
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(d)], strict=True):
            if good[a:b].any():
                own, item = int(d[a]), int(i[a])
                if best := overlap(w[at[own] : at[own] + count[own]], self.words[item], diagonal[a:b].tolist(), self.share, self.run, diagonal[a:b][good[a:b]].tolist()):
                    out.append((own, item, *best))
        return out


def _against(documents: DataFrame, shared, share: float, run: int) -> DataFrame:
    def build():
        scan = Scanner(shared.value, share, run)

        def rows(ids, texts):
            found = [(ids[d], scan.ids[i], n, len(scan.words[i]), n / len(scan.words[i]), a, b) for d, i, n, a, b in scan(texts)]
            return list(zip(*found, strict=True)) if found else [[]] * 7

        return rows

    kind = "doc_id long, item_id long, n_match long, n_item long, share double, first_word long, last_word long"
    return map_slices(documents.select("doc_id", "text"), build, kind, 1)
