"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS = 512
SLICE_BYTES = 1 << 20
GROUP_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a folder of our own is set on one machine, as
    in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        found = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="spark-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def groups(spark: SparkSession, size: int) -> int:
    """How many groups ``size`` bytes are dealt out to by hash: of GROUP_BYTES each, ``spark.sql.shuffle.partitions`` at least. A task takes one at a time."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))


def dealt_out(part: np.ndarray, some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part's number and, in order, the rows of it that are in ``some``."""
    own = np.flatnonzero(some)
    own = own[np.argsort(part[own], kind="stable")]
    edges = np.append(np.flatnonzero(np.diff(part[own], prepend=-1)), len(own))
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(part[own[a]]), own[a:b]


def slices(batch: pa.RecordBatch, weight: int | None = None, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` of ``rows`` rows and about ``size`` bytes of column ``weight`` at most; a longer text is a piece of its own."""
    if weight is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    sizes = pc.binary_length(batch.column(weight)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        ahead = np.cumsum(sizes[at : at + rows])
        n = max(1, int(np.searchsorted(ahead, size)))
        yield batch.slice(at, n)
        at += n


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable):
    """What ``make`` gives, held by the worker process until it turns to another operator."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def returned(batches: Iterator[pa.RecordBatch], operator: str = "") -> Iterator[pa.RecordBatch]:
    """``batches``, with what other operators keep let go before, and unused memory given back after them: the worker process lives on."""
    for key in [k for k in _KEPT if k[0] != operator]:
        del _KEPT[key]
    yield from batches
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_slices(df: DataFrame, build: Callable[[], Callable], schema: str | T.StructType, weight: int | None = None, size: int = SLICE_BYTES) -> DataFrame:
    """Applies ``build()(*columns)`` to slices; columns come and go as Python lists or arrays."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        work = build()
        for batch in returned(batches):
            for part in slices(batch, weight, size=size):
                got = work(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(got, out, strict=True)], schema=out
                )

    return df.mapInArrow(run, kind)


def filter_slices(df: DataFrame, build: Callable[[], Callable], text: str, size: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``df`` for which ``build()(texts)`` is true, with all columns as they are."""
    kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = build()
        for batch in returned(batches):
            for part in slices(batch, place, size=size):
                yield part.filter(pa.array(keep(part.column(place).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, kind)


def codes(text: str) -> np.ndarray:
    """Code points of ``text``; a lone surrogate keeps its own number."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def bucket(id_column: Column, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, by the hash of ``key``: the same ones at each run."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(rows)
    return df.join(F.broadcast(ids), key, "left_semi")


def thinned(df: DataFrame, key: str, wanted: DataFrame, rest: bool = False) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in the one column of ``wanted``, or with ``rest`` those rows.

    A bitmap of 16 bits a wanted key is broadcast, of 2**22 to 2**26 bits; a
    join on the key must follow, as other keys can share a bit.
    """
    name = wanted.columns[0]
    bits = min(26, max(22, math.ceil(math.log2(16 * wanted.count() + 1))))
    spot = F.pmod(F.xxhash64(F.col(name)), F.lit(1 << bits))
    maps = wanted.select(spot.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    own = df.withColumn("_p", F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))).withColumn("_at", F.bitmap_bit_position("_p"))
    byte = "cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast(_at % 8 as int)) & 1, 0) = {int(not rest)}")
    found = own.join(F.broadcast(maps), F.bitmap_bucket_number("_p") == F.col("_slot"), "left" if rest else "inner").where(hit)
    return found.select(*(F.col(c) for c in df.columns))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(bare: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of ``bare`` between ASCII blanks, list by list, each of about ``size`` bytes, so that no long text is held as one list."""
    at = 0
    while at < len(bare):
        end = bare.find(b" ", at + size) if at + size < len(bare) else -1
        end = len(bare) if end < 0 else end
        yield bare[at:end].split()
        at = end


# The largest primes below 2**31, and a base for each, chosen at random once.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103527591, 1748302987, 812346211, 1390116479)
_POWERS: dict[int, np.ndarray] = {}  # 32 bits are enough for each


def powers(k: int, n: int) -> np.ndarray:
    """The first ``n`` powers of the ``k``-th base modulo its prime; 2**16 of them are kept."""
    known = _POWERS.get(k, np.ones(1, np.uint32))
    p = np.uint64(PRIMES[k])
    while len(known) < max(n, 1 << 16):
        step = np.uint64(pow(BASES[k], len(known), PRIMES[k]))
        known = np.concatenate((known, (known * step % p).astype(np.uint32)))
    _POWERS[k] = known[: 1 << 16]
    return known


def word_hash(values: np.ndarray, size: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from the values of all words one after the other; ``which`` (0 or 1) gives two that do not depend on each other.

    Each is a polynomial modulo two primes, over the whole word.
    """
    if not len(size):
        return np.zeros(0, np.uint64)
    run = np.cumsum(size) - size
    longest, out = int(size.max()), np.zeros(len(size), np.uint64)
    place = np.arange(len(values), dtype=np.uint32)
    place -= np.repeat(run.astype(np.uint32), size)
    small = (int(values.max()) + 1) * longest < 1 << 33  # sums of products stay below 2**64
    for k in (2 * which, 2 * which + 1):
        p = np.uint64(PRIMES[k])
        power = powers(k, longest)[place]
        each = power.astype(np.uint64)
        each *= values
        each += power  # that is, by the value and one
        if not small:
            each %= p
        out = out << np.uint64(31) | np.add.reduceat(each, run) % p
    return mix(out)
