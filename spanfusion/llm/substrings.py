"""Removal of runs of words that an earlier document holds.

Windows of ``width`` words are hashed. A count-min sketch, merged from the
partitions, overestimates how often each window occurs; a second pass sends on
only windows estimated repeated and groups these by 96 bits of hash, 64 and 32
from word hashes that do not depend on each other,
for the smallest document of each. A window that occurs twice is never
estimated at one, so none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanfusion.llm.common import dealt_out, groups, mix, returned, slices, utf8, word_hash
from spanfusion.llm.sketches import GATHER, dealt, gathered, maybe_repeated, pack_places, repeated_cells, rows_table, unpack, unpack_places, width_bits

WIDTH = 13
SEND = 2_000_000


def words(texts: list[str | None], lower: bool = False, hashes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, first and last+1 byte of each word, each word's hash, and where each text's words start.

    Words are runs of characters other than space and U+0009 to U+000D;
    ``lower`` takes A to Z as a to z. Of two ``hashes`` each word has two that
    do not depend on each other; of none it has none.
    """
    parts = [utf8(t) for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    if lower:
        raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    at = np.searchsorted(begin, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))))
    own, size = raw[inside], end - begin
    h = [word_hash(own, size, k) for k in range(hashes)]
    return raw, begin, end, h[0] if hashes == 1 else np.stack(h) if h else None, at


def windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    c = np.uint64(0xD1342543DE82EF95 + 2 * seed)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            factor = factor * c
            out += h[k : k + n] * factor
    return mix(out ^ np.uint64(seed))


def inner(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """If each of ``n`` windows lies in one text."""
    ok = np.ones(n, dtype=bool)
    for edge in at[1:-1]:
        ok[max(0, edge - width + 1) : edge] = False
    return ok


def remove(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every whole text.

    A word goes if a window over it also starts in a document with a smaller
    id, judged on the input. A missing text has no words; texts under ``width``
    words have no window. A row without an id has no smaller ids and is smaller
    than none, so it keeps all. Repeated rows each give a row, and as their ids
    are equal take nothing from each other. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").withColumn("mark", F.xxhash64("text"))
    sized = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = width_bits(sized // 6)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, 0):
            _, _, _, h, at = words(part.column(0).to_pylist())
            w = windows(h, width, 0)
            yield w[inner(at, len(w), width)]

    sketch = repeated_cells(spark, known.select("text"), hashes, bits)
    n = groups(spark, sized)  # a repeated window takes some 16 bytes, a word of text 6
    kind = T.StructType.fromDDL("part int, ids binary, marks binary, counts binary, places binary, h binary, g binary")

    def group(h: np.ndarray, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by hash and id, and where groups of equal hashes start in it."""
        order = np.lexsort((d, g, h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        return order, new

    def send(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A group's smallest id goes on to the other tasks; what is larger here already is decided (without hashes)."""
        d, m, p, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
        order, new = group(h, g, d)
        first = order[new]
        smallest = np.empty(len(d), dtype=np.int64)
        smallest[order] = d[first][np.cumsum(new) - 1]
        decided = d > smallest
        part = (h % np.uint64(n)).astype(np.int64)
        out = to_arrow_schema(kind)
        for over in (False, True):
            for k, own in dealt_out(part, decided == over):
                yield row(k, d[own], m[own], p[own], None if over else h[own], None if over else g[own], out)

    def row(k, d, m, p, h, g, out) -> pa.RecordBatch:
        values = [k, *pack_places(d, m, p), None if h is None else h.tobytes(), None if g is None else g.astype(np.uint32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, out, strict=True)], schema=out)

    def estimate(batches):
        found, size = [], 0
        for batch in returned(batches):
            for piece in slices(batch, 2):
                ids = np.array(piece.column(0).to_pylist(), dtype=np.int64)
                marks = np.array(piece.column(1).to_pylist(), dtype=np.int64)
                _, _, _, (h, other), at = words(piece.column(2).to_pylist(), hashes=2)
                w = windows(h, width, 0)
                keep = np.flatnonzero(inner(at, len(w), width) & maybe_repeated(sketch.value, w, bits))
                doc = np.searchsorted(at, keep, side="right") - 1
                found.append((ids[doc], marks[doc], keep - at[doc], w[keep], windows(other, width, 1)[keep] >> np.uint64(32)))
                size += len(keep)
                if size >= SEND:
                    yield from send(found)
                    found, size = [], 0
        if size:
            yield from send(found)

    verdict = T.StructType.fromDDL(GATHER)

    def decide(table: pa.Table) -> pa.Table:
        """Places of windows of one part of the hashes that a smaller id holds too."""
        done, rest = [], []
        for r in table.to_pylist():
            x = unpack_places(r["ids"], r["marks"], r["counts"], r["places"])
            (done if r["h"] is None else rest).append(x if r["h"] is None else (*x, np.frombuffer(r["h"], np.uint64), np.frombuffer(r["g"], np.uint32)))
        if rest:
            d, m, p, h, g = (np.concatenate(x) for x in zip(*rest, strict=True))
            order, new = group(h, g, d)
            smallest = np.empty(len(d), dtype=np.int64)
            smallest[order] = d[order[new]][np.cumsum(new) - 1]
            own = d > smallest
            done.append((d[own], m[own], p[own]))
        d, m, p = (np.concatenate(x) for x in zip(*done, strict=True))
        return rows_table(list(dealt(d, m, p, 0, n)), verdict)

    sent = known.select("doc_id", "mark", "text").mapInArrow(estimate, kind)
    found = gathered(sent.groupBy("part").applyInArrow(decide, verdict))
    joined = docs.join(found, (docs["doc_id"] == found["id"]) & (docs["mark"] == found["m"]), "left").select("doc_id", "text", "places")
    result = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")

    def finish(batches):
        out = to_arrow_schema(result)
        for batch in returned(batches):
            for piece in slices(batch, 1):
                raw, begin, end, _, at = words(piece.column(1).to_pylist(), hashes=0)
                gone = np.zeros(len(begin) + 1, dtype=np.int64)
                for i, body in enumerate(piece.column(2).to_pylist()):
                    if body:
                        p = unpack(body) + at[i]
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + width, -1)
                removed = np.cumsum(gone)[:-1] > 0
                body, digests = raw.tobytes(), []
                for a, b in zip(at, at[1:], strict=False):
                    kept = np.flatnonzero(~removed[a:b]) + a
                    digests.append(hashlib.sha256(b" ".join([body[x:y] for x, y in zip(begin[kept].tolist(), end[kept].tolist(), strict=True)])).hexdigest())
                lost = np.concatenate(([0], np.cumsum(removed)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array((lost[at[1:]] - lost[at[:-1]]).astype(np.int64)), pa.array(digests)], schema=out)

    return joined.mapInArrow(finish, result)
