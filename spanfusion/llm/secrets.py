"""Secrets: an Aho-Corasick pass over keywords, patterns anchored at the hits, checksums where a format carries one."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from spanfusion.llm.common import map_slices

# Kinds in their order, keywords and patterns.
KINDS = ("assign", "access", "hex", "token", "jwt")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
# Formats with a checksum of their own: six base-62 digits of the crc32 of the body.
SUMMED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
SUMMED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)(?:\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+)?")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def keywords() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, kind in ((ASSIGN_WORDS, 0), (("akia",), 1), (SUMMED_WORDS, 3), (("eyj",), 4)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0")


def _object(part: str) -> bool:
    """If ``part`` is the base-64 of a JSON object; what nests too deeply to be read is none."""
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def spans(text: str, automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base patterns, and of all."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)
    base, more, last = [], [], [0] * len(KINDS)
    for stop, (kind, size) in automaton.iter(low):
        at = stop + 1 - size
        if at < last[kind]:
            continue
        if kind == 0:
            if m := ASSIGN.match(text, at):
                last[0] = m.end()
                if len(m[1]) >= 6:
                    base.append((at, 0, m.end()))
        elif kind == 1:
            if m := ACCESS.match(text, at):
                last[1] = m.end()
                if len(m[0]) >= 20:
                    base.append((at, 1, m.end()))
        elif kind == 3:
            if (m := SUMMED.match(text, at)) and checksum(m[1]) == m[2]:
                last[3] = m.end()
                more.append((at, 3, m.end()))
        elif m := JWT.match(text, at):
            last[4] = m.end()  # a run of such characters is read from its first keyword only, so each is read once
            if m[2] and _object(m[1]) and _object(m[2]):
                more.append((at, 4, m.end()))
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    return base, sorted(base + more) if more else base


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans of every whole text.

    A missing or empty text has no spans. Spans of one start are in the order
    of KINDS. Repeated rows each give a row; other columns are ignored.
    """

    def build():
        automaton = keywords()

        def scan(ids, texts):
            counts, digests, every = ([], [], []), [], []
            for text in texts:
                base, full = spans(text or "", automaton)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                every.append(written(full))
            return ids, *counts, digests, every

        return scan

    kind = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_slices(documents.select("doc_id", "text"), build, kind, 1)
