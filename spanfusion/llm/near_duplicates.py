"""Near duplicates by MinHash bands, with odd sketches to weigh candidates.

A document's set holds its distinct word shingles. Documents of equal sets make
a class. The MinHash samples of a set are hashed in BANDS bands of ROWS, and
are folded into a parity bitmap, the odd sketch: the share of bits in which two
sketches differ tells how many samples differ. A second bitmap holds the parity
of the whole set: each shingle that only one of two sets has flips one bit, so
the unequal bits are never more than such shingles, and a pair that they rule
out is never a link. A pair of classes that shares a band and whose sketches
allow the similarity is confirmed on the full sets.

A band's members are first compared to its earliest one, then for some turns to
one of the band's largest component. Members of one component need no more
comparison; only bands whose members are still in several components have the
pairs between these weighed, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanfusion.llm.common import dealt_out, groups, mix, returned, slices, stored, thinned
from spanfusion.llm.components import components
from spanfusion.llm.substrings import windows, words

SHINGLE = 3
SIMILARITY = 85  # in hundredths
BANDS, ROWS = 40, 4  # a pair at the similarity shares no band with a chance of 1.5e-13
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
PARITY_BITS = 2048
MISS = 1e-9  # bound of the chance that odd sketches rule out a pair at the similarity
TURNS = 2
BLOCK = 2048
_FACTORS = (np.random.default_rng(17).integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    _, _, _, h, at = words(texts, lower=True)
    w = windows(h, shingle, 0)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= shingle:
            own = np.sort(w[a : b - shingle + 1])
            new = np.ones(len(own), dtype=bool)
            new[1:] = own[1:] != own[:-1]
            out.append(own[new])
        else:
            out.append(windows(h[a:b], b - a, b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def signature(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class hash, MinHash samples [sets, SAMPLES], and odd sketch with the parity of the set [sets, 40] of non-empty sets."""
    flat = np.concatenate(found)
    start = np.cumsum([0, *map(len, found)])[:-1]
    low = (flat >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((len(found), SAMPLES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            samples[:, k] = np.minimum.reduceat(low * _FACTORS[k], start)
    # A sample flips the bit that its number and value hash to.
    bit = (mix(samples.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    sketch = parities(bit.ravel(), np.full(len(found), SAMPLES), SKETCH_BITS)
    whole = parities((mix(flat) % np.uint64(PARITY_BITS)).astype(np.int64), np.array([len(x) for x in found]), PARITY_BITS)
    return signature_class(found), samples, np.concatenate((sketch, whole), axis=1)


def parities(bit: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps [sets, bits / 64] of the parity of each bit, from the bits of all sets one after the other."""
    flips = np.bincount(bit + np.repeat(np.arange(len(counts)) * bits, counts), minlength=len(counts) * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(counts), -1), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A hash for each band [sets, BANDS]."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(samples), axis=0)
    for r in range(ROWS):
        key = mix(key ^ samples[:, r::ROWS].astype(np.uint64))
    return key


def most_bits(similarity: float) -> int:
    """Unequal bits that two sketches of ``similarity`` pass with a chance below MISS.

    Of SAMPLES samples each differs with chance ``1 - similarity``, and one
    that differs flips a bit of either sketch: the chances of so many odd bits
    after so many flips are carried from flip to flip.
    """
    odd = np.arange(SKETCH_BITS + 1)
    state = (odd == 0).astype(np.float64)
    total = np.zeros(SKETCH_BITS + 1)
    for differ in range(SAMPLES + 1):
        total += math.comb(SAMPLES, differ) * (1 - similarity) ** differ * similarity ** (SAMPLES - differ) * state
        for _ in range(2):
            up, down = state * (1 - odd / SKETCH_BITS), state * odd / SKETCH_BITS
            state = np.append(0, up[:-1]) + np.append(down[1:], 0)
    above = np.append(np.cumsum(total[::-1])[::-1][1:], 0)
    return int(np.flatnonzero(above < MISS)[0])


def keep_first(documents: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``documents``, all columns, that come first of their group of near duplicates.

    First is the smallest id, and the smallest hash of the text where several
    texts have it; rows without an id come last. Rows are told apart by id and
    text: of rows equal in both, one stays. A text without words, or a missing
    one, is a group of its own with the equal rows of its id. Columns
    whose names begin with ``_nd_`` would clash. Only rows that may go
    are shuffled.
    """
    meta, named = _classes(documents, shingle, similarity)
    id_, mark = F.coalesce("doc_id", F.lit(0)), F.xxhash64("text", F.col("doc_id").isNull())
    own = meta.join(named, F.col("cls") == F.col("c"), "left").select(
        F.coalesce("root", "cls").alias("group"), F.when(F.col("cls").isNull(), F.struct("doc_id", "mark")).alias("alone"), "doc_id", "mark"
    )
    first = own.groupBy("group", "alone").agg(F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("mark").alias("m"))).alias("x"))
    first = first.select(F.col("x.i").alias("i"), F.col("x.m").alias("m"))
    each = meta.groupBy(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("mark").alias("m")).agg(F.count("*").alias("n"))
    # Rows to look at: those that are not first, and those that are there more than once.
    some = stored(each.join(first.withColumn("_nd_first", F.lit(True)), ["i", "m"], "left").where("_nd_first is null or n > 1").select(F.xxhash64("i", "m").alias("_nd_w"), F.col("m").alias("_nd_m"), "_nd_first"))
    marked = documents.withColumns({"_nd_mark": mark, "_nd_key": F.xxhash64(id_, mark)})
    sure = thinned(marked, "_nd_key", some.select("_nd_w"), rest=True)
    open_ = thinned(marked, "_nd_key", some.select("_nd_w")).join(some, (F.col("_nd_key") == F.col("_nd_w")) & (F.col("_nd_mark") == F.col("_nd_m")), "left")
    open_ = open_.where("_nd_w is null or _nd_first").dropDuplicates(["_nd_key", "_nd_mark"])
    return sure.select(*documents.columns).unionByName(open_.select(*documents.columns))


def cluster(documents: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id of every document.

    Links join documents whose sets meet ``100 * shared >= similarity * all``;
    ``component_id`` is the smallest id that links lead to, and ``class_id``
    the smallest id with an equal set. A document without words or text has an empty set and is linked with nothing. Rows
    without an id take part, but the component goes by the smallest id there
    is; where there is none it is missing, and a row without an id is kept only
    in a component without ids. Repeated rows each give a row of one class.
    Other columns are ignored.
    """
    meta, named = _classes(documents, shingle, similarity)
    joined = meta.select("doc_id", "n_shingles", "cls").join(named, F.col("cls") == F.col("c"), "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("low").alias("class_id"))


def _classes(documents: DataFrame, shingle: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, mark, n_shingles, cls; ``mark`` hashes the text), and one for each class (c, low, found, root)."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meta_kind = T.StructType.fromDDL("doc_id long, mark long, n_shingles long, cls long, sketch array<long>, bands binary")

    def describe(batches):
        out = to_arrow_schema(meta_kind)
        for batch in returned(batches):
            for part in slices(batch, 2):
                found = shingle_sets(part.column(2).to_pylist(), shingle)
                full = [i for i, x in enumerate(found) if len(x)]
                cls, sketch, bands = [None] * len(found), [None] * len(found), [None] * len(found)
                if full:
                    c, samples, s = signature([found[i] for i in full])
                    for i, a, b, k in zip(full, c.tolist(), s.tolist(), band_keys(samples), strict=True):
                        cls[i], sketch[i], bands[i] = a, b, k.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, type=out.field(k + 2).type) for k, v in enumerate(([len(x) for x in found], cls, sketch, bands)))], schema=out)

    meta = stored(docs.select("doc_id", F.xxhash64("text", F.col("doc_id").isNull()), "text").mapInArrow(describe, meta_kind))
    sets = meta.where(F.col("cls").isNotNull())
    classes = stored(sets.groupBy("cls").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    members = stored(_bands(sets, groups(spark, sets.count() * BANDS * 24)))

    full = stored(_full_sets(docs, classes, members.select("cls").distinct(), shingle))
    stars = members.where("cls <> leader").select(F.least("leader", "cls").alias("a"), F.greatest("leader", "cls").alias("b")).distinct()
    tried = stored(_weighed(stars, classes, similarity))
    links = stored(_confirmed(full, tried, similarity))
    roots = components(links)
    for turn in range(TURNS):
        stars = stored(_weighed(_turn(members, roots, turn), classes, similarity).join(tried, ["a", "b"], "left_anti"))
        if not stars.limit(1).count():
            break
        tried = tried.unionByName(stars)
        links = stored(links.unionByName(_confirmed(full, stars, similarity)))
        roots = components(links)
    open_ = stored(_open_pairs(members, classes, roots, similarity, n).join(tried, ["a", "b"], "left_anti"))
    if open_.limit(1).count():
        links = links.unionByName(_confirmed(full, open_, similarity))
        roots = components(links)

    rooted = sets.select("cls", "doc_id").join(roots, F.col("cls") == F.col("node"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("far"))
    of_class = roots.join(lowest, "root").select(F.col("node").alias("cls"), "far", "root")
    named = classes.select("cls", "low").join(of_class, "cls", "left").select(F.col("cls").alias("c"), "low", F.coalesce("far", "low").alias("found"), "root")
    return meta.select("doc_id", "mark", "n_shingles", "cls"), named


def _bands(sets: DataFrame, n: int) -> DataFrame:
    """(band, cls, leader) of all bands with two classes or more; the leader has the smallest id."""
    sent_kind = T.StructType.fromDDL("part int, keys binary, cls binary, ids binary")
    kind = T.StructType.fromDDL("band long, cls long, leader long")

    def send(batches):
        out = to_arrow_schema(sent_kind)
        for batch in returned(batches):
            cls = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            ids = np.array([(1 << 62) if x is None else x for x in batch.column(1).to_pylist()], dtype=np.int64)
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64)
            cls, ids = np.repeat(cls, BANDS), np.repeat(ids, BANDS)
            part = (keys % np.uint64(n)).astype(np.int64)
            for k, own in dealt_out(part, np.ones(len(part), bool)):
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((k, keys[own].tobytes(), cls[own].tobytes(), ids[own].tobytes()), out, strict=True)], schema=out)

    def meet(table: pa.Table) -> pa.Table:
        keys, cls, ids = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("cls", np.int64), ("ids", np.int64)))
        order = np.lexsort((ids, cls, keys))
        keys, cls, ids = keys[order], cls[order], ids[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
        keys, cls, ids = keys[new], cls[new], ids[new]
        order = np.lexsort((cls, ids, keys))
        keys, cls = keys[order], cls[order]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        leader, many = np.repeat(cls[start], size), np.repeat(size, size) > 1
        return pa.Table.from_arrays([pa.array(keys[many].astype(np.int64)), pa.array(cls[many]), pa.array(leader[many])], schema=to_arrow_schema(kind))

    return sets.select("cls", "doc_id", "bands").mapInArrow(send, sent_kind).groupBy("part").applyInArrow(meet, kind)


def _weighed(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sizes and odd sketches allow the similarity."""
    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    flips = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64, (SKETCH_BITS + PARITY_BITS) // 64)), F.lit(0))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity) & (differ <= most_bits(similarity / 100))
    near &= flips * (100 + similarity) <= (F.col("na") + F.col("nb")) * (100 - similarity)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def _turn(members: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs of a band's members with one of the band's largest component, for members of others."""
    rooted = members.join(roots, F.col("cls") == F.col("node"), "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    parts = rooted.groupBy("band", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("band", F.lit(turn), "cls"), "cls")).alias("one"))
    heads = parts.groupBy("band").agg(F.max(F.struct("n", "root", "one")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    pairs = rooted.join(heads.select("band", F.col("top.root").alias("head"), F.col("top.one.cls").alias("other")), "band").where("root <> head")
    return pairs.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(cls, n, shingles) of the given classes, each from its document with the smallest id."""
    wanted = stored(nodes.join(classes, "cls").select("cls", "low"))
    kind = T.StructType.fromDDL("cls long, n long, shingles array<long>")

    def rebuild(batches):
        out = to_arrow_schema(kind)
        for batch in returned(batches):
            for part in slices(batch, 0):
                found = [x for x in shingle_sets(part.column(0).to_pylist(), shingle) if len(x)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((signature_class(found), [len(x) for x in found], [x.view(np.int64) for x in found]), out, strict=True)], schema=out)

    texts = thinned(docs, "doc_id", wanted.select("low")).join(wanted.select("low").distinct(), F.col("doc_id").eqNullSafe(F.col("low")))
    return texts.select("text").mapInArrow(rebuild, kind).join(wanted.select("cls"), "cls").dropDuplicates(["cls"])


def _confirmed(sets: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    a = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).alias("shared"))
    return both.where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * similarity).select("a", "b")


def signature_class(found: list[np.ndarray]) -> np.ndarray:
    """A hash of each whole set."""
    size = np.array([len(x) for x in found])
    flat, start = np.concatenate(found), np.cumsum(size) - size
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(flat), start) + np.uint64(3) * np.bitwise_xor.reduceat(flat, start) + size.astype(np.uint64)).astype(np.int64)


def _open_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame, similarity: int, n: int) -> DataFrame:
    """Pairs of one band in different components that sizes and sketches allow, from blocks of BLOCK members."""
    rooted = members.join(roots, F.col("cls") == F.col("node"), "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y").select("band", "size")
    left = rooted.join(mixed, "band").join(classes.select("cls", F.col("n").alias("items"), "sketch"), "cls")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    dealt = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "root", "items", "sketch")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("band", "i", "j"), F.lit(4 * n)))
    kind = T.StructType.fromDDL("a long, b long")
    most = most_bits(similarity / 100)

    def weigh(table: pa.Table) -> pa.Table:
        band, i, j, own, cls, root, items = (table.column(c).to_numpy() for c in ("band", "i", "j", "own", "cls", "root", "items"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(cls), -1).view(np.uint64)
        odd, whole = np.split(sketch, [SKETCH_BITS // 64], axis=1)
        order = np.lexsort((cls, j, i, band))
        key = np.stack((band, i, j))[:, order]
        start = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        seen = []
        for a, b in zip(start, np.append(start[1:], len(order)), strict=True):
            rows = order[a:b]
            left = rows[own[rows] == i[rows[0]]]
            right = rows[own[rows] == j[rows[0]]]
            for x in range(0, len(left), 256):
                some = left[x : x + 256]
                ok = root[some][:, None] != root[right][None]
                ok &= np.minimum(items[some][:, None], items[right]) * 100 >= np.maximum(items[some][:, None], items[right]) * similarity
                p, q = np.nonzero(ok)
                differ = np.bitwise_count(odd[some[p]] ^ odd[right[q]]).sum(1, dtype=np.int64)
                p, q = p[differ <= most], q[differ <= most]
                flips = np.bitwise_count(whole[some[p]] ^ whole[right[q]]).sum(1, dtype=np.int64)
                near = flips * (100 + similarity) <= (items[some[p]] + items[right[q]]) * (100 - similarity)
                p, q = p[near], q[near]
                if len(p):
                    u, v = cls[some[p]], cls[right[q]]
                    seen.append(np.stack((np.minimum(u, v), np.maximum(u, v))))
        found = np.unique(np.concatenate(seen, axis=1), axis=1) if seen else np.zeros((2, 0), dtype=np.int64)
        return pa.Table.from_arrays([pa.array(found[0]), pa.array(found[1])], schema=to_arrow_schema(kind))

    return dealt.groupBy("part").applyInArrow(weigh, kind).distinct()
