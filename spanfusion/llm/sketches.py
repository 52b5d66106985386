"""Count-min sketches merged from partitions, and the packing of sorted numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanfusion.llm.common import mix

DEPTH = 2
BLOCK_BITS = 21
MIN_BITS, MAX_BITS = BLOCK_BITS, 30
FLUSH = 4_000_000
SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as gaps of a byte; 255 goes on without a number. Repeated numbers stay repeated."""
    gaps = np.diff(numbers.astype(np.int64), prepend=0)
    out = np.full(int((gaps // 255).sum()) + len(gaps), 255, dtype=np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def pack_places(d: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Places ``p`` in documents (id ``d``, mark ``m``), in runs of a document and of rising places."""
    start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (p[1:] < p[:-1])))) if len(d) else np.zeros(0, np.int64)
    counts = np.diff(np.append(start, len(d))).astype(np.uint32)
    # Each run begins anew on top of the one before.
    base = np.concatenate(([0], np.cumsum(p[np.append(start[1:], len(d)) - 1] + 1)[:-1])) if len(d) else np.zeros(0, np.int64)
    return d[start].tobytes(), m[start].tobytes(), counts.tobytes(), pack(p + np.repeat(base, counts))


def unpack_places(ids: bytes, marks: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, m, c, p = np.frombuffer(ids, np.int64), np.frombuffer(marks, np.int64), np.frombuffer(counts, np.uint32), unpack(places)
    last = np.cumsum(c.astype(np.int64)) - 1
    base = np.concatenate(([0], p[last][:-1] + 1)) if len(c) else np.zeros(0, np.int64)
    return np.repeat(d, c), np.repeat(m, c), p - np.repeat(base, c)


def by_document(d: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A row for each document: id, mark and packed places."""
    order = np.lexsort((p, m, d))
    d, m, p = d[order], m[order], p[order]
    start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])))) if len(d) else np.zeros(0, np.int64)
    return d[start], m[start], [pack(p[a:b]) for a, b in zip(start, np.append(start[1:], len(d)), strict=True)] if len(d) else []


GATHER = "deal int, kind int, ids binary, marks binary, counts binary, places binary"


def dealt(d: np.ndarray, m: np.ndarray, p: np.ndarray, kind: int, n: int) -> Iterator[list]:
    """Rows of GATHER: the places of one kind, packed for each of ``n`` shares of the documents."""
    share = (mix(d.view(np.uint64) ^ mix(m.view(np.uint64))) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((p, m, d, share))
    edges = np.searchsorted(share[order], np.arange(n + 1))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            own = order[a:b]
            yield [k, kind, *pack_places(d[own], m[own], p[own])]


def gathered(rows: DataFrame) -> DataFrame:
    """(id, m, kind, places) with a row for each document and kind, from rows of GATHER."""
    out_kind = T.StructType.fromDDL("id long, m long, kind int, places binary")

    def merge(table: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        kinds = table.column("kind").to_numpy()
        for kind in np.unique(kinds):
            own = table.filter(pa.array(kinds == kind))
            parts = [unpack_places(*(r[c] for c in ("ids", "marks", "counts", "places"))) for r in own.to_pylist()]
            ids, marks, bodies = by_document(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for column, values in zip(columns, (ids, marks, [int(kind)] * len(bodies), bodies), strict=True):
                column.extend(values)
        return pa.Table.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, to_arrow_schema(out_kind), strict=True)], schema=to_arrow_schema(out_kind))

    return rows.groupBy("deal").applyInArrow(merge, out_kind)


def rows_table(rows: list[list], ddl: T.StructType) -> pa.Table:
    out = to_arrow_schema(ddl)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(out)], schema=out)


def width_bits(items: int) -> int:
    """Cells of a row, as a power of two: about twice the items, within fixed bounds."""
    return int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(2, 2 * items))))))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes ^ SALTS[row]) >> np.uint64(64 - bits)


def repeated_cells(spark: SparkSession, rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    """A broadcast of the cells that count two or more, one bit array for each of DEPTH rows.

    ``hashes`` yields arrays of 64-bit hashes for a batch. Each task counts its
    own hashes and sends the sorted cells on in packed blocks; a block's counts
    are added up where the block is dealt to, batch by batch, in an array of
    fixed size. The merged sketch has DEPTH * 2**bits / 8 bytes, 256 MB at most
    whatever the input, which bounds what passes the driver.
    """
    kind = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("body", T.BinaryType())])
    per_row = 1 << (bits - BLOCK_BITS)

    def send(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, out = np.concatenate(found), to_arrow_schema(kind)
        for row in range(DEPTH):
            at = np.sort(cells(own, row, bits)).astype(np.int64)
            edges = np.searchsorted(at, np.arange(per_row + 1) << BLOCK_BITS)
            blocks = [(row * per_row + b, pack(at[x:y] - (b << BLOCK_BITS))) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y]
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*blocks, strict=True), out, strict=True)], schema=out)

    def count(batches):
        found, n = [], 0
        for batch in batches:
            for h in hashes(batch):
                found.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield from send(found)
                    found, n = [], 0
        if n:
            yield from send(found)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = sums.setdefault(block, np.zeros(1 << BLOCK_BITS, dtype=np.uint8))
                at = unpack(body)
                new = np.ones(len(at), dtype=bool)
                new[1:] = at[1:] != at[:-1]
                again = at[~new]
                once = at[new]
                seen[once] = np.minimum(seen[once] + 1, 2)
                seen[again] = 2
        out = to_arrow_schema(kind)
        for block, seen in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], type=out.field(0).type), pa.array([np.packbits(seen >= 2).tobytes()], type=out.field(1).type)], schema=out)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = rows.mapInArrow(count, kind).repartition(min(DEPTH * per_row, n), "block").mapInArrow(merge, kind)
    sketch = np.zeros((DEPTH, per_row, (1 << BLOCK_BITS) // 8), dtype=np.uint8)
    for r in merged.toLocalIterator():
        sketch[r["block"] // per_row, r["block"] % per_row] = np.frombuffer(r["body"], dtype=np.uint8)
    return spark.sparkContext.broadcast(sketch.reshape(DEPTH, -1))


def maybe_repeated(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """If the sketch estimates two or more of each hash; never false for one that is repeated."""
    out = np.ones(len(hashes), dtype=bool)
    for row in range(DEPTH):
        at = cells(hashes, row, bits)
        out &= (sketch[row][(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return out
