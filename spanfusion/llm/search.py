"""Ranked lexical search: windowed bucket scoring over postings.

One pass over the texts makes postings of the terms that are asked for, packed by
windows: up to WINDOW documents in doc_id order, with their lengths, and for each
term the places and counts of the documents that hold it. The second pass
traverses the windows: the postings of an item's terms are added into an array of
a window's size, which stays in the cache, a bitset marks the places that were
touched, and these are harvested into a heap for each item. A task hands on its
heaps only, so nothing but the best of each task is shuffled, and every document
is scored by one task, whatever ids or texts many documents share.

A missing text has no terms. Rows of one item_id are one item with the terms of
all of them, a missing item_id included; rows of one doc_id are documents of their own. A
document without id is scored like others and stands behind its equals. Tables
without terms give no rows.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanfusion.llm.common import kept, returned, slices, stored, utf8, words

TOP = 50
WINDOW = 4096
#: Postings of one window; it closes early beyond them.
POSTINGS = 1 << 20
#: Bytes of items that are scored in one pass.
BLOCK = 16 << 20

_TERMS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_PACKED = "n_docs long, n_terms long, ids binary, nulls binary, sizes binary, terms array<int>, df array<int>, docs binary, tf binary"
_SCHEMA = pa.schema([
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()),
    ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("docs", pa.binary()), ("tf", pa.binary()),
])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in returned(batches):
            for part in slices(batch, 1):
                rows = [(i, t) for i, text in zip(*(c.to_pylist() for c in part.columns), strict=True) for own in words(utf8(text).translate(_TERMS)) for t in set(own)]
                ids = pa.array([i for i, _ in rows], part.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array([t for _, t in rows], pa.binary()).cast(pa.string())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string").distinct()


class Postings:
    """The open window of a task."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.docs: list[int] = []
        self.terms: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, size: int, found: Counter) -> None:
        self.n_docs += size > 0
        self.n_terms += size
        if found:
            self.docs += [len(self.ids)] * len(found)
            self.terms += found.keys()
            self.counts += found.values()
            self.ids.append(doc_id)
            self.sizes.append(size)

    def packed(self) -> pa.RecordBatch:
        """The window as one row: documents by id, postings by term and document."""
        nulls = np.array([i is None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, nulls))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        docs, terms = place[np.array(self.docs, np.int64)], np.array(self.terms, np.int32)
        by = np.lexsort((docs, terms))
        known, df = np.unique(terms, return_counts=True)
        row = [
            self.n_docs, self.n_terms, ids[order].tobytes(), nulls[order].tobytes(), np.array(self.sizes, np.int64)[order].tobytes(),
            known.tolist(), df.tolist(), docs[by].astype(np.uint16).tobytes(), np.array(self.counts, np.int32)[by].tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)


def windows(documents: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """Packed postings of the terms in ``numbers``, WINDOW documents a row; documents without any are only counted."""
    given, name = documents.sparkSession.sparkContext.broadcast(numbers), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = Postings()
        for batch in returned(batches, "search"):
            number = kept(("search", name), lambda: {t.encode(): k for t, k in given.value.items()}).get
            for part in slices(batch, 1):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    size, found = 0, Counter()
                    for own in words(utf8(text).translate(_TERMS)):
                        size += len(own)
                        found.update(map(number, own))
                    found.pop(None, None)
                    open_.add(doc_id, size, found)
                    if len(open_.ids) == WINDOW or len(open_.docs) > POSTINGS:
                        yield open_.packed()
                        open_ = Postings()
        yield open_.packed()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PACKED)


def _scored(packed: DataFrame, items: list[tuple[object, list[int]]], weights: np.ndarray, n: int, total: int, top: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score): the best of each task."""
    given, name = packed.sparkSession.sparkContext.broadcast((items, weights)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = []
        for batch in returned(batches, "search"):
            asked, weigh = kept(("search", name), lambda: given.value)
            heaps = heaps or [[] for _ in asked]
            bucket, touched = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
            for ids, nulls, sizes, terms, df, docs, tf in zip(*(batch.column(c).to_pylist() for c in ("ids", "nulls", "sizes", "terms", "df", "docs", "tf")), strict=True):
                ids, nulls, sizes = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), np.frombuffer(sizes, np.int64)
                docs, tf = np.frombuffer(docs, np.uint16), np.frombuffer(tf, np.int32).astype(np.int64)
                if not len(ids):
                    continue
                m = 100 - 50 + 50 * sizes * n // total
                gain = np.repeat(weigh[terms], df) * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
                ends = np.cumsum(df)
                place = dict(zip(terms, zip((ends - df).tolist(), ends.tolist(), strict=True), strict=True))
                for heap, (_, own) in zip(heaps, asked, strict=True):
                    for span in filter(None, map(place.get, own)):
                        some = docs[slice(*span)]
                        bucket[some] += gain[slice(*span)]
                        touched[some] = True
                    hit = np.flatnonzero(touched)
                    score = bucket[hit]
                    bucket[hit], touched[hit] = 0, False
                    least = heap[0][0] if len(heap) == top else 1
                    best = np.flatnonzero(score >= least)
                    if len(best) > top:
                        best = best[np.lexsort((hit[best], -score[best]))[:top]]  # places are in the order of ids
                    for s, k in zip(score[best].tolist(), hit[best].tolist(), strict=True):
                        entry = (s, 0, 0) if nulls[k] else (s, 1, -int(ids[k]))
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        else:
                            heapq.heappushpop(heap, entry)
        rows = [(item, -i if known else None, s) for (item, _), heap in zip(given.value[0] if heaps else [], heaps, strict=True) for s, known, i in heap]
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string() if kind == "string" else pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], names=["item_id", "doc_id", "score"])

    return packed.select("ids", "nulls", "sizes", "terms", "df", "docs", "tf").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with scores above 0, equal ones by doc_id.

    Items (item_id, text) are taken in blocks of BLOCK bytes by hash; the terms
    of a block, their weights and its heaps are all that is broadcast.
    """
    kind = "string" if items.schema["item_id"].dataType.simpleString() == "string" else "bigint"
    asked = stored(item_terms(items.withColumn("item_id", F.col("item_id").cast(kind))))
    blocks = -(-(asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) // BLOCK)
    found = None
    for k in range(blocks):
        own: dict[object, list[str]] = {}
        for item, term in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():
            own.setdefault(item, []).append(term)
        numbers = {t: i for i, t in enumerate(sorted({t for x in own.values() for t in x}))}
        packed = stored(windows(documents, numbers))
        n, total = (x or 0 for x in packed.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        weights = np.zeros(len(numbers), np.int64)
        each = packed.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
        for term, df in each.collect():
            weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        best = _scored(packed, [(item, sorted(numbers[t] for t in x)) for item, x in own.items()], weights, n, total, top, kind)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = documents.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score").where(F.col("rank") <= top)
