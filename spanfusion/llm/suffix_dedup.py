"""Removal of byte strings of a given length that occur more than once.

Equal strings share an anchor: the place in them of the half-length string
with the least prefix-polynomial hash. So only anchors whose half-length string
(the gram) is repeated need a look, about one in three of a hundredth of all
places. Common extensions are found by hash from the outside in: anchors whose
whole surroundings, in which every string of theirs lies, are repeated are
settled at once. The rest go with their surroundings to where their gram is
dealt to: there the suffixes from the anchors on, and the reversed beginnings
before them, are sorted by a mergesort that compares by prefix hashes and
binary search and is verified by bytes. The common extensions of neighbours
then tell, for each string, if another anchor has the same to both sides. Only
where more than TOGETHER anchors share a gram are their strings dealt one by
one and grouped by hash. Hashes that decide are 64 bits of a polynomial modulo
2**64, verified by 31 bits of another modulo a prime.
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

from spanfusion.llm import suffix_order
from spanfusion.llm.bytestrings import Joined
from spanfusion.llm.common import dealt_out, groups, returned, slices, stored, thinned
from spanfusion.llm.sketches import GATHER, dealt, gathered, maybe_repeated, pack_places, repeated_cells, rows_table, unpack, unpack_places, width_bits

WIDTH = 400
PIECE = 1 << 20
SEND = 1_500_000
TOGETHER = 4096  # anchors of one gram that are sorted in one task
SORTED = 8192  # anchors that are sorted at a time, or one gram's
PART_BYTES = 32 << 20


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _row(values: list, out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, out, strict=True)], schema=out)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    d, m = (np.array(batch.column(i).to_pylist(), dtype=np.int64) for i in (0, 1))
    return d, m, batch.column(2).to_pylist()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group of equal keys, and the groups' sizes."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new)
    return group, np.bincount(group)


def windows(text: Joined, anchors: np.ndarray, doc: np.ndarray, back: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``back`` bytes before each anchor and ``width`` from it on, zeros outside its text, and how many of both are in it."""
    place = anchors[:, None] + np.arange(-back, width)
    out = text.raw[np.clip(place, 0, len(text.raw) - 1)]
    lo, hi = text.at[doc], text.at[doc + 1]
    out[(place < lo[:, None]) | (place >= hi[:, None])] = 0
    return out, np.minimum(back, anchors - lo), np.minimum(width, hi - anchors)


def repeated_strings(gram: np.ndarray, window: np.ndarray, before: np.ndarray, after: np.ndarray, least: np.ndarray, most: np.ndarray, twice: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, int]]:
    """(anchors, bytes before them) where strings of ``width`` bytes start that another anchor of the gram also has.

    An anchor stands for strings that start ``least`` to ``most`` bytes before
    it. Two of its gram have the same string from d bytes before if what comes
    before them is common for d bytes, and what comes from them on for the rest.
    """
    back = window.shape[1] - width
    by_gram = np.argsort(gram, kind="stable")
    new = np.concatenate(([True], gram[by_gram][1:] != gram[by_gram][:-1])) if len(gram) else np.zeros(0, bool)
    first = np.append(np.flatnonzero(new), len(gram))
    at = 0
    while at < len(gram):
        # Whole grams, as many as fit.
        stop = max(first[np.searchsorted(first, at + SORTED, side="right") - 1], first[np.searchsorted(first, at, side="right")])
        own = by_gram[at:stop]
        group = np.cumsum(new[at:stop]) - 1
        after_order, after_common = suffix_order.ordered(window[own, back:], after[own], group)
        before_order, before_common = suffix_order.ordered(window[own, :back][:, ::-1], before[own], group)
        rank_after, rank_before = np.argsort(after_order), np.argsort(before_order)
        for d in range(back + 1):
            on = np.flatnonzero((least[own] <= d) & (d <= most[own]))
            if not len(on):
                continue
            same_after = np.cumsum(after_common < width - d)[rank_after[on]]
            same_before = np.cumsum(before_common < d)[rank_before[on]]
            _, kind = np.unique(same_after * (len(own) + 1) + same_before, return_inverse=True)
            hit = np.bincount(kind, weights=1 + twice[own[on]])[kind] > 1
            if hit.any():
                yield own[on[hit]], d
        at = stop


def remove(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every whole text.

    A byte goes if a string of ``width`` bytes over it also starts anywhere
    else, judged on the input; strings lie in one text. A missing text is
    empty; shorter texts keep all. Repeated rows each count and each give a
    row, as do rows without an id. Other columns are ignored.
    """
    spark = documents.sparkSession
    half = width // 2
    back, together = width - half, TOGETHER
    none = -(1 << 63)
    docs = documents.select("doc_id", F.coalesce("doc_id", F.lit(none)).alias("key"), F.xxhash64("text").alias("mark"), "text")
    known = docs.where(F.octet_length("text") >= width).select("key", "mark", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = width_bits(total * 2 // half)
    n = groups(spark, total)  # an anchor takes some 30 bytes, and two of half a string's bytes are anchors

    def grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, 0, size=PIECE):
            text = Joined(part.column(0).to_pylist())
            a, _, _ = text.anchors(width)
            yield text.hashes(a, a + half)

    sketch = repeated_cells(spark, known.select("text"), grams, bits)
    sent_kind = _schema("part int, ids binary, marks binary, counts binary, places binary, gram binary, whole binary, other binary, twice binary")

    def survey(batches):
        out, found, size = to_arrow_schema(sent_kind), [], 0

        def send():
            d, m, a, g, u, v, has = (np.concatenate(x) for x in zip(*found, strict=True))
            # What is repeated within this task is settled; one of each kind goes on for all.
            group, count = _groups(u, v, g, has)
            first = np.zeros(len(count), dtype=np.int64)
            first[group[::-1]] = np.arange(len(group))[::-1]
            settled = (count[group] > 1) & has
            sole = ~settled | (first[group] == np.arange(len(group)))
            part = (g % np.uint64(n)).astype(np.int64)
            for k, own in dealt_out(part, sole):
                twice = settled[own].astype(np.uint8) + 2 * has[own].astype(np.uint8)
                yield _row([k, *pack_places(d[own], m[own], a[own]), g[own].tobytes(), u[own].tobytes(), v[own].tobytes(), twice.tobytes()], out)
            for k, rest in dealt_out(part, ~sole):
                yield _row([k, *pack_places(d[rest], m[rest], a[rest]), None, None, None, None], out)

        for batch in returned(batches):
            for piece in slices(batch, 2, size=PIECE):
                keys, marks, texts = _arrays(piece)
                text = Joined(texts)
                a, _, _ = text.anchors(width)
                g = text.hashes(a, a + half)
                keep = maybe_repeated(sketch.value, g, bits)
                a, g = a[keep], g[keep]
                doc = np.searchsorted(text.at, a, side="right") - 1
                has = (a - (width - half) >= text.at[doc]) & (a + width <= text.at[doc + 1])
                lo, hi = np.where(has, a - (width - half), a), np.where(has, a + width, a + half)
                found.append((keys[doc], marks[doc], a - text.at[doc], g, text.hashes(lo, hi), text.checks(lo, hi), has))
                size += len(a)
                if size >= SEND:
                    yield from send()
                    found, size = [], 0
        if size:
            yield from send()

    verdict_kind = _schema(GATHER)

    def judge(table: pa.Table) -> pa.Table:
        """Kind 0: all strings of the anchor are repeated. Kind 1: it is to be sorted with its gram's. Kind 3: its gram has too many, its strings are dealt."""
        whole, rest = [], []
        for r in table.to_pylist():
            x = unpack_places(r["ids"], r["marks"], r["counts"], r["places"])
            if r["gram"] is None:
                whole.append(x)
            else:
                rest.append((*x, *(np.frombuffer(r[c], t) for c, t in (("gram", np.uint64), ("whole", np.uint64), ("other", np.uint32), ("twice", np.uint8)))))
        open_ = many = [np.zeros(0, np.int64)] * 3
        if rest:
            d, m, a, g, u, v, twice = (np.concatenate(x) for x in zip(*rest, strict=True))
            has, n_here = twice >= 2, 1 + (twice & 1).astype(np.int64)
            # Anchors at a text's border have no whole surroundings; each is a kind of its own.
            alone = np.where(has, 0, np.arange(1, len(d) + 1))
            kind, _ = _groups(u, v, g, alone)
            weight = np.bincount(kind, weights=n_here)
            gram, _ = _groups(g)
            per_gram = np.bincount(gram, weights=n_here)
            first = np.zeros(len(weight), dtype=np.int64)
            first[kind[::-1]] = np.arange(len(kind))[::-1]
            kinds = np.bincount(gram[first], minlength=len(per_gram))
            same = has & (weight[kind] > 1)
            whole.append((d[same], m[same], a[same]))
            compare = (~same & (per_gram[gram] > 1)) | (same & (kinds[gram] > 1) & (first[kind] == np.arange(len(kind))))
            hot = np.bincount(gram, weights=compare)[gram] > together
            open_, many = ([x[compare & (hot == k)] for x in (d, m, a)] for k in (False, True))
        done = [np.concatenate(x) for x in zip(*whole, strict=True)] if whole else [np.zeros(0, np.int64)] * 3
        return rows_table([*dealt(*done, 0, n), *dealt(*open_, 1, n), *dealt(*many, 3, n)], verdict_kind)

    verdicts = stored(gathered(known.mapInArrow(survey, sent_kind).groupBy("part").applyInArrow(judge, verdict_kind)))
    compared = verdicts.where("kind <> 0").select("id", "m", "kind", "places")
    near = thinned(known, "mark", compared.select("m"))
    pairs = near.join(compared, (near["key"] == compared["id"]) & (near["mark"] == compared["m"])).select("key", "mark", "text", "kind", "places")
    # A packed place has a byte or more, so parts of windows hold PART_BYTES or less, but for what one gram brings.
    room = compared.where("kind = 1").agg(F.sum(F.octet_length("places"))).first()[0] or 0
    parts = max(n, -(-room * (back + width + 16) // PART_BYTES))
    strings_kind = _schema("part int, ids binary, marks binary, counts binary, places binary, h binary, v binary, twice binary, windows binary, sides binary")

    def compare(batches):
        out, found, size, anchored, held = to_arrow_schema(strings_kind), [], 0, [], 0

        def send():
            d, m, s, h, v = (np.concatenate(x) for x in zip(*found, strict=True))
            group, count = _groups(h, v)
            first = np.zeros(len(count), dtype=np.int64)
            first[group[::-1]] = np.arange(len(group))[::-1]
            settled, sole = count[group] > 1, first[group] == np.arange(len(group))
            part = (h % np.uint64(parts)).astype(np.int64)
            for k, own in dealt_out(part, sole):
                yield _row([k, *pack_places(d[own], m[own], s[own]), h[own].tobytes(), v[own].tobytes(), np.packbits(settled[own]).tobytes(), None, None], out)
            for k, rest in dealt_out(part, ~sole):
                yield _row([k, *pack_places(d[rest], m[rest], s[rest]), None, None, None, None, None], out)

        def send_windows():
            d, m, a, g, w, sides = (np.concatenate(x) for x in zip(*anchored, strict=True))
            # Repeated rows of one id and text: one goes on for all.
            order = np.lexsort((a, m, d))
            new = np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (d, m, a, sides[:, 2])], axis=0)))
            twice = np.bincount(np.cumsum(new) - 1) > 1
            order = order[new]
            part = (g[order] % np.uint64(parts)).astype(np.int64)
            for k, at in dealt_out(part, np.ones(len(part), bool)):
                own = order[at]
                yield _row([k, *pack_places(d[own], m[own], a[own]), g[own].tobytes(), None, np.packbits(twice[at]).tobytes(), w[own].tobytes(), sides[own].tobytes()], out)

        for batch in returned(batches):
            for piece in slices(batch, 2, size=PIECE):
                keys, marks, texts = _arrays(piece)
                text = Joined(texts)
                a, lo, hi = text.anchors(width)
                doc = np.searchsorted(text.at, a, side="right") - 1
                kinds = np.array(piece.column(3).to_pylist())
                wanted = [unpack(x) + text.at[i] for i, x in enumerate(piece.column(4).to_pylist())]
                keep = np.isin(a, np.concatenate(wanted))
                few = np.flatnonzero(keep & (kinds[doc] == 1))
                for at in range(0, len(few), SORTED):
                    x = few[at : at + SORTED]
                    w, before, after = windows(text, a[x], doc[x], back, width)
                    sides = np.stack((before, after, a[x] - hi[x], a[x] - lo[x]), axis=1).astype(np.int32)
                    anchored.append((keys[doc[x]], marks[doc[x]], a[x] - text.at[doc[x]], text.hashes(a[x], a[x] + half), w, sides))
                    held += len(x)
                    if held >= SORTED:
                        yield from send_windows()
                        anchored, held = [], 0
                keep &= kinds[doc] == 3
                doc, lo, count = doc[keep], lo[keep], (hi - lo + 1)[keep]
                run = np.cumsum(count) - count
                s = np.repeat(lo - run, count) + np.arange(count.sum())
                doc = np.repeat(doc, count)
                found.append((keys[doc], marks[doc], s - text.at[doc], text.hashes(s, s + width), text.checks(s, s + width)))
                size += len(s)
                if size >= SEND:
                    yield from send()
                    found, size = [], 0
        if held:
            yield from send_windows()
        if size:
            yield from send()

    def match(table: pa.Table) -> pa.Table:
        """Kind 2: a repeated string starts here."""
        done, rest, sorted_ = [], [], []
        for r in table.to_pylist():
            x = unpack_places(r["ids"], r["marks"], r["counts"], r["places"])
            if r["h"] is None:
                done.append(x)
                continue
            twice = np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: len(x[0])]
            h = np.frombuffer(r["h"], np.uint64)
            if r["windows"] is None:
                rest.append((*x, h, np.frombuffer(r["v"], np.uint32), twice))
            else:
                sides = np.frombuffer(r["sides"], np.int32).reshape(-1, 4).astype(np.int64)
                sorted_.append((*x, h, np.frombuffer(r["windows"], np.uint8).reshape(len(h), -1), sides, twice))
        if rest:
            d, m, s, h, v, twice = (np.concatenate(x) for x in zip(*rest, strict=True))
            group, count = _groups(h, v)
            again = np.bincount(group, weights=twice, minlength=len(count)) + count > 1
            done.append(tuple(x[again[group]] for x in (d, m, s)))
        if sorted_:
            d, m, a, g, w, sides, twice = (np.concatenate(x) for x in zip(*sorted_, strict=True))
            done += [(d[own], m[own], a[own] - ahead) for own, ahead in repeated_strings(g, w, *sides.T, twice, width)]
        every = [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 3
        return rows_table(list(dealt(*every, 2, n)), verdict_kind)

    singles = gathered(pairs.mapInArrow(compare, strings_kind).groupBy("part").applyInArrow(match, verdict_kind))
    every = verdicts.where("kind = 0").unionByName(singles).groupBy("id", "m").agg(F.collect_list(F.struct("kind", "places")).alias("found"))
    joined = docs.join(every, (docs["key"] == every["id"]) & (docs["mark"] == every["m"]), "left").select("doc_id", "text", "found")
    result = _schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def finish(batches):
        out = to_arrow_schema(result)
        for batch in returned(batches):
            for piece in slices(batch, 1):
                text = Joined(piece.column(1).to_pylist())
                edge = np.zeros(len(text.raw) + 1, dtype=np.int32)
                for i, lists in enumerate(piece.column(2).to_pylist()):
                    for x in lists or ():
                        p = unpack(x["places"]) + text.at[i]
                        first = p if x["kind"] == 2 else p - (width - half)
                        np.add.at(edge, first, 1)
                        np.add.at(edge, p + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                rows = ([], [], [], [])
                for a, b in zip(text.at.tolist(), text.at[1:].tolist(), strict=False):
                    own = gone[a:b]
                    rows[0].append(b - a)
                    rows[1].append(int(own.sum()))
                    rows[2].append(int(np.count_nonzero(own[1:] & ~own[:-1]) + (own[:1].sum())))
                    rows[3].append(hashlib.sha256(text.raw[a:b][~own].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, type=out.field(i + 1).type) for i, x in enumerate(rows))], schema=out)

    return joined.mapInArrow(finish, result)
