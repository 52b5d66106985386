"""Prefix hashes of byte strings and anchors that equal strings share."""

from __future__ import annotations

import numpy as np

from spanfusion.llm.common import mix, utf8

_RANDOM = np.random.default_rng(5).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 1_103_515_245)
_PRIME = (1 << 31) - 1
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, ``n`` at least: modulo 2**64 for seed 0, modulo _PRIME for seed 1."""
    got = _TABLES.get(seed)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 20)
        base, modulus = _BASES[seed], (1 << 64, _PRIME)[seed]
        got = _TABLES[seed] = (_run(base, size, modulus), _run(pow(base, -1, modulus), size, modulus))
    return got


def _run(base: int, n: int, modulus: int) -> np.ndarray:
    """1, base, base squared and so on; by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) <= n:
        with np.errstate(over="ignore"):
            more = out * np.uint64(pow(base, len(out), modulus))
        out = np.concatenate((out, more if modulus >> 64 else more % np.uint64(modulus)))
    return out


def beginnings(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes the hash of seed 0, unmixed, of its first 0, 1, 2 and so on bytes."""
    width = rows.shape[1]
    out = np.zeros((len(rows), width + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_RANDOM[0][rows] * _powers(0, width)[0][:width], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


class Joined:
    """Texts as one run of bytes, with prefix polynomial hashes.

    The hash of any stretch comes from two prefixes. Seed 0 gives 64 bits of a
    polynomial modulo 2**64, for which unlike strings of one hash can be made
    up; seed 1 gives 31 bits of one modulo a prime, which tells these apart.
    """

    def __init__(self, texts: list[str | None]) -> None:
        parts = [utf8(t) for t in texts]
        self.raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        self.prefix: dict[int, np.ndarray] = {}

    def hashes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        power, inverse = _powers(0, len(self.raw) + 1)
        if 0 not in self.prefix:
            with np.errstate(over="ignore"):
                self.prefix[0] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_RANDOM[0][self.raw] * power[: len(self.raw)], dtype=np.uint64)))
        p = self.prefix[0]
        with np.errstate(over="ignore"):
            return mix((p[right] - p[left]) * inverse[left])

    def checks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The hash of seed 1."""
        power, inverse = _powers(1, len(self.raw) + 1)
        prime = np.uint64(_PRIME)
        if 1 not in self.prefix:
            terms = (_RANDOM[1] % prime)[self.raw] * power[: len(self.raw)] % prime
            self.prefix[1] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % prime))
        p = self.prefix[1]
        return ((p[right] + prime - p[left]) % prime * inverse[left] % prime).astype(np.uint32)

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first and last start of the strings of ``width`` bytes that it stands for; of all strings inside the texts.

        A string's anchor is the place in it of the half-length string with
        the least hash, the first of equals: equal strings have it at the same
        place.
        """
        n, half = len(self.raw), width // 2
        span = width - half + 1
        none = (np.zeros(0, np.int64),) * 3
        if n < width:
            return none
        end = np.repeat(self.at[1:], np.diff(self.at))
        place = np.arange(n - half + 1, dtype=np.int64)
        key = (self.hashes(place, place + half) >> np.uint64(32)) << np.uint64(32) | place.astype(np.uint64)
        key[place + half > end[: len(place)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        pad = -len(key) % span
        block = np.concatenate((key, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64))).reshape(-1, span)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.flatnonzero(place[: n - width + 1] + width <= end[: n - width + 1])
        if not len(starts):
            return none
        owner = (np.minimum(back[starts], ahead[starts + span - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        return owner[first], starts[first], starts[last]
