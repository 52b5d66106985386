"""Document fingerprints by a randomised edit embedding.

A walk reads a text from its start: at each step it notes the character it
stands on and goes on to the next one or stays, as a random function of step
and character says, the same function for all texts. Walks over texts a few
edits apart meet again after each edit, so edits become differing steps. The
fingerprint samples SLOTS steps, at places that all texts of about one length
share, and keeps four bits of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanfusion.llm.common import codes, mix, returned, slices, stored, utf8
from spanfusion.llm.components import components

SLOTS = 128
BLOCK = 512
FEW = 24
PIECE = 1 << 21
SIMILARITY = 0.8
CROWD = 2048
NEXT = 8
CHUNK = 1 << 18
PART_CLASSES = 20_000
MAX_STEPS = 1 << 40


def _places() -> list[np.ndarray]:
    """For each slot the steps at which its sample is renewed: a text of n steps is sampled at the last of them below n."""
    random, out = np.random.default_rng(23), []
    for _ in range(SLOTS):
        at, own = 0, [0]
        while at < MAX_STEPS:
            at = max(at + 1, int((at + 1) / (1.0 - random.random())))
            own.append(at)
        out.append(np.array(own, dtype=np.int64))
    return out


_PLACES = _places()
_SHIFT = 0x9E37


def _alone(here: list[int], factors: list[int]) -> tuple[list[int], int]:
    """The characters that one walk notes from the start of ``here`` on, and how far it gets."""
    at, last, notes = 0, len(here) - 1, []
    for factor in factors:
        c = here[at]
        notes.append(c)
        if (c + _SHIFT) * factor & 0x80000000 and at < last:
            at += 1
    return notes, at


def fingerprints(texts: list[np.ndarray]) -> np.ndarray:
    """Symbols from 0 to 15 [texts, SLOTS] of texts given as code points.

    All texts walk in step, longest first, so that those under way are a
    leading part; a text of n characters takes 2 n steps and a few more, which
    leads past its end. The last FEW, as very long texts, walk one by one.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    steps = 2 * size + 8 * np.ceil(np.sqrt(size)).astype(np.int64) + 16
    flat = np.concatenate([np.append(texts[i], np.uint32(0)) for i in order]).astype(np.uint32)
    end = np.cumsum(size + 1) - 1
    at = end - size
    sample = np.stack([p[np.searchsorted(p, steps) - 1] for p in _PLACES], axis=1)
    by_step = np.argsort(sample, axis=None, kind="stable")
    sorted_steps = sample.ravel()[by_step]
    out = np.zeros((len(texts), SLOTS), dtype=np.uint32)
    live = len(texts)
    for start in range(0, int(steps[0]), BLOCK):
        stop = min(start + BLOCK, int(steps[0]))
        factors = mix(np.arange(start, stop, dtype=np.uint64) + np.uint64(0x5DEECE66D)).astype(np.uint32) | np.uint32(1)
        while steps[live - 1] <= start:
            live -= 1
        notes = np.empty((stop - start, live), dtype=np.uint32)
        own, last = at[:live], end[:live]
        if live > FEW:
            for j in range(stop - start):
                c = flat[own]
                notes[j] = c
                own += ((c + np.uint32(_SHIFT)) * factors[j] >> np.uint32(31)).astype(np.int64)
                np.minimum(own, last, out=own)
        else:
            for k in range(live):
                notes[:, k], ahead = _alone(flat[own[k] : min(own[k] + BLOCK, last[k]) + 1].tolist(), factors.tolist())
                own[k] += ahead
        a, b = np.searchsorted(sorted_steps, (start, stop))
        which = by_step[a:b]
        out[which // SLOTS, which % SLOTS] = notes[sorted_steps[a:b] - start, which // SLOTS]
    symbols = (mix(out.astype(np.uint64) | (np.arange(SLOTS, dtype=np.uint64) << np.uint64(32))) & np.uint64(15)).astype(np.uint8)
    back = np.empty_like(symbols)
    back[order] = symbols
    return back


def written(symbols: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in (symbols[:, ::2] << 4 | symbols[:, 1::2])]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal symbols."""
    return (a == b).mean(axis=1)


def with_next(documents: DataFrame, files: int) -> DataFrame:
    """Documents dealt out in stretches of falling ids, each followed by the first document after it.

    Columns: stretch, follows, key, doc_id, text, in this order of rows within
    a partition; ``follows`` marks the borrowed rows. Ids are taken in falling
    order, missing ones last, and texts in rising order among equal ids.
    """
    docs = documents.select("doc_id", "text").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    edges = sorted(set(docs.approxQuantile("key", [i / files for i in range(1, files)], 0.2 / files))) if files > 1 else []
    marks = np.array(edges, dtype=np.float64)

    @F.pandas_udf("int")
    def stretch(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, key.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    dealt = docs.withColumn("stretch", stretch("key")).withColumn("follows", F.lit(False))
    heads = dict(sorted((r["stretch"], r["key"]) for r in dealt.groupBy("stretch").agg(F.max("key").alias("key")).collect()))
    order = sorted(heads, reverse=True)
    after = [(heads[b], a) for a, b in zip(order, [*order[1:], *order[:1]], strict=True)]
    spark = documents.sparkSession
    wanted = spark.createDataFrame(after or [(0, 0)], "head long, target int")
    borrowed = docs.join(F.broadcast(wanted), F.col("key") == F.col("head")).groupBy("target", "key", "doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("t"))
    extra = borrowed.select("doc_id", F.col("t.text").alias("text"), "key", F.col("target").alias("stretch"), F.lit(True).alias("follows"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = dealt.unionByName(extra).repartition(n, "stretch")
    return both.sortWithinPartitions("stretch", "follows", F.desc("key"), F.asc_nulls_first("text")).select("stretch", "follows", "key", "doc_id", "text")


def fingerprint(documents: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likenesses.

    The edited text ends in the first characters of the next document, in
    falling order of ids, in place of its last third. A missing text counts as
    empty. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Equal texts have equal
    fingerprints. Repeated rows each give a row; other columns are ignored.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = T.StructType.fromDDL("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def run(batches):
        out = to_arrow_schema(kind)
        pending: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            """Of all rows but the last, which is the next of the one before."""
            points = [codes(r[3]) for r in rows]
            own = [i for i in range(len(rows) - 1) if not rows[i][1]]
            edited = [rows[i][3][: len(rows[i][3]) - len(rows[i][3]) // 3] + rows[i + 1][3][: len(rows[i][3]) // 3] for i in own]
            marks = fingerprints(points + [codes(t) for t in edited])
            mine = marks[own]
            changed = marks[len(rows) :]
            following = marks[[i + 1 for i in own]]
            digests = [hashlib.sha256(utf8(t)).hexdigest() for t in edited]
            columns = ([rows[i][2] for i in own], [len(rows[i][3]) for i in own], digests, written(mine), written(changed), likeness(mine, changed), likeness(mine, following))
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, out, strict=True)], schema=out)

        for batch in returned(batches):
            for piece in slices(batch, 4, rows=2048, size=PIECE):
                s, f, _, i, t = (c.to_pylist() for c in piece.columns)
                pending += zip(s, f, i, (x or "" for x in t), strict=True)
                if len(pending) > 1:
                    if any(not r[1] for r in pending[:-1]):
                        yield done(pending)
                    pending = pending[-1:]

    return with_next(documents, 4 * n).mapInArrow(run, kind)


def read(marks: list[str]) -> np.ndarray:
    """The symbols of written fingerprints."""
    rows = np.frombuffer(bytes.fromhex("".join(marks)), dtype=np.uint8).reshape(len(marks), SLOTS // 2)
    return np.stack((rows >> 4, rows & 15), axis=2).reshape(len(marks), SLOTS)


def planes(symbols: np.ndarray) -> np.ndarray:
    """Symbols as four planes of SLOTS bits, uint64 [marks, 4 * SLOTS / 64]: a symbol's bits lie in one place of each."""
    bits = np.unpackbits(symbols[:, :, None], axis=2)[:, :, 4:]
    return np.packbits(bits.transpose(0, 2, 1).reshape(len(symbols), -1), axis=1).view(np.uint64)


def near(marks: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """If rows ``a`` and ``b`` of ``marks`` differ in ``most`` symbols at most; the first half of the symbols rules most pairs out."""
    width = SLOTS // 64

    def unlike(a, b, word):
        return np.bitwise_count(np.bitwise_or.reduce([marks[a, p] ^ marks[b, p] for p in range(word, 4 * width, width)]))

    out = np.ones(len(a), dtype=bool)
    differ, left = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for word in range(width):
        differ[left] += unlike(a[left], b[left], word)
        out[left] = differ[left] <= most
        left = left[out[left]]
    return out


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest index of each component) after links between ``a`` and ``b``."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def band_keys(symbols: np.ndarray, most: int) -> np.ndarray:
    """A hash for each of ``most + 1`` bands that share out all symbols: of two fingerprints that differ in ``most`` symbols, one band is equal."""
    spots = np.array_split(np.random.default_rng(100).permutation(SLOTS), most + 1)
    keys = np.empty((len(symbols), len(spots)), dtype=np.uint64)
    for b, own in enumerate(spots):
        key = np.full(len(symbols), b + 1, dtype=np.uint64)
        for s in own:
            key = mix(key << np.uint64(4) ^ symbols[:, s].astype(np.uint64))
        keys[:, b] = key
    return (keys >> np.uint64(32)).astype(np.uint32)


def link(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``prints`` with near_id: the smallest id that near fingerprints lead to.

    The symbols are shared out among one band more than two near fingerprints
    may differ in, so that these have an equal band. All members of a band that
    no link has joined yet are compared by their share of equal symbols, those
    of a large band in hashed blocks: no link is missed. Equal fingerprints are
    one class; a class without any id has no near_id.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = stored(prints)
    own = prints.select("doc_id", "fingerprint").where(F.col("doc_id").isNotNull())
    classes = stored(own.groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    most = SLOTS - int(np.ceil(SLOTS * similarity - 1e-9))
    met = stored(_met(classes, most, max(n, classes.count() // PART_CLASSES)))
    links = met.where(F.col("band").isNull()).select("a", "b")
    roots = components(links)
    crowded = met.where(F.col("band").isNotNull()).select("band", F.col("a").alias("id"))
    if crowded.limit(1).count():
        links = links.unionByName(_open_links(crowded, classes, roots, most, n))
        roots = components(links)
    named = classes.join(roots, F.col("id") == F.col("node"), "left").select(F.col("fingerprint").alias("f"), F.coalesce("root", "id").alias("near_id"))
    return prints.join(named, F.col("fingerprint") == F.col("f"), "left").drop("f")


def _met(classes: DataFrame, most: int, parts: int) -> DataFrame:
    """Links (a, b) between members of a band, and a row (band, a) for each member of a band of over CROWD.

    A share of the bands gets a fingerprint once, with its bands there. Links
    are given as those that join the components which a share found. The
    members of a crowded band are compared with its first and a few next ones.
    """
    sent_kind = T.StructType.fromDDL("part int, ids binary, marks binary, counts binary, keys binary")
    kind = T.StructType.fromDDL("a long, b long, band long")

    def send(batches):
        out = to_arrow_schema(sent_kind)
        for batch in returned(batches):
            for piece in slices(batch, rows=4096):
                ids = np.array(piece.column(0).to_pylist(), dtype=np.int64)
                symbols = read(piece.column(1).to_pylist())
                marks, keys = planes(symbols), band_keys(symbols, most)
                bands = keys.shape[1]
                keys = keys.ravel()
                part = (mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                start = np.flatnonzero(np.diff(part[order], prepend=-1))
                columns = [[], [], [], [], []]
                for x, y in zip(start, np.append(start[1:], len(order)), strict=True):
                    at = order[x:y]
                    who, count = np.unique(at // bands, return_counts=True)
                    for column, v in zip(columns, (int(part[at[0]]), ids[who].tobytes(), marks[who].tobytes(), count.astype(np.uint16).tobytes(), keys[at].tobytes()), strict=True):
                        column.append(v)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    def meet(table: pa.Table) -> pa.Table:
        ids, marks, counts, keys = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("ids", np.int64), ("marks", np.uint64), ("counts", np.uint16), ("keys", np.uint32)))
        marks = marks.reshape(len(ids), -1)
        who = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((ids[who], keys))
        who, keys = who[order], keys[order]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        first, size = np.repeat(start, size), np.repeat(size, size)
        end, crowded = first + size, size > CROWD
        label = np.arange(len(ids))

        def compare(label, i, j):
            for x in range(0, len(i), CHUNK):
                a, b = who[i[x : x + CHUNK]], who[j[x : x + CHUNK]]
                open_ = label[a] != label[b]
                a, b = a[open_], b[open_]
                found = near(marks, a, b, most)
                label = join_labels(label, a[found], b[found])
            return label

        i = np.flatnonzero(crowded)
        label = compare(label, first[i], i)
        i, step = np.arange(len(keys)), 1
        while len(i := i[(i + step < end[i]) & ((step <= NEXT) | ~crowded[i])]):
            label = compare(label, i, i + step)
            step += 1
        moved = np.flatnonzero(label != np.arange(len(ids)))
        held = np.flatnonzero(crowded)
        a = np.concatenate((ids[moved], ids[who[held]]))
        b = pa.array(np.concatenate((ids[label[moved]], np.zeros(len(held), np.int64))))
        band = pa.array(np.concatenate((np.zeros(len(moved), np.int64), keys[held].astype(np.int64))), mask=np.arange(len(a)) < len(moved))
        return pa.Table.from_arrays([pa.array(a), b, band], schema=to_arrow_schema(kind))

    return classes.select("id", "fingerprint").mapInArrow(send, sent_kind).groupBy("part").applyInArrow(meet, kind)


def _open_links(crowded: DataFrame, classes: DataFrame, roots: DataFrame, most: int, n: int) -> DataFrame:
    """Links between members (band, id) of one band in different components, from blocks of CROWD members."""
    rooted = crowded.join(roots, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y").select("band", "size")
    left = rooted.join(mixed, "band").join(classes, "id")
    blocks = F.ceil(F.col("size") / CROWD).cast("int")
    dealt = left.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "fingerprint")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("band", "i", "j"), F.lit(4 * n)))
    kind = T.StructType.fromDDL("a long, b long")

    def weigh(table: pa.Table) -> pa.Table:
        band, i, j, own, ids, root = (table.column(c).to_numpy() for c in ("band", "i", "j", "own", "id", "root"))
        marks = planes(read(table.column("fingerprint").to_pylist()))
        label = np.unique(root, return_index=True, return_inverse=True)
        label = label[1][label[2]]
        order = np.lexsort((j, i, band))
        key = np.stack((band, i, j))[:, order]
        start = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        label = join_labels(np.arange(len(ids)), np.arange(len(ids)), label)
        for a, b in zip(start, np.append(start[1:], len(order)), strict=True):
            rows = order[a:b]
            left, right = rows[own[rows] == i[rows[0]]], rows[own[rows] == j[rows[0]]]
            for x in range(0, len(left), 128):
                some = left[x : x + 128]
                p, q = np.nonzero(label[some][:, None] != label[right][None])
                p, q = some[p], right[q]
                found = near(marks, p, q, most)
                label = join_labels(label, p[found], q[found])
        far = np.flatnonzero(root != root[label])
        return pa.Table.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], schema=to_arrow_schema(kind))

    return dealt.groupBy("part").applyInArrow(weigh, kind).distinct()
