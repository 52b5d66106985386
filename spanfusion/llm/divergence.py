"""Source divergence audit: how the words of each source stand out from those of others of its language.

Two passes over the texts. The first counts exactly in how many documents of a
language each term occurs; the second runs an Aho-Corasick automaton of the kept
terms, each between two delimiters, over the texts and counts every occurrence.
What comes of it are sparse postings (language, source, term, occurrences), from
which smoothed shares, distances of sources and each source's outstanding terms
follow by exact integers.

Missing texts, languages and sources count as empty ones, which are a language
and a source like others. Each row is a document, also where ids repeat. A
source without terms has even shares; a language that keeps no term has
distances of 0 and no terms. Empty tables give empty tables.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfusion.llm.common import kept, returned, slices, stored, utf8, words

LEAST = 30
TOP = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: Entries of counts that a task holds before it hands them on.
HELD = 500_000
#: Bytes of kept terms in one automaton; more take further passes.
BLOCK = 4 << 20
#: Longer terms are looked up as they are, so that no automaton grows by one of them.
LONG = 200
#: Shares that a block of terms holds for all sources of its language, and sources compared at a time.
CELLS = 4 << 20
TILE = 128

_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG + 1))
_ROWS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])
_POSTINGS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])


def _known(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def _text(column: list[bytes]) -> pa.Array:
    return pa.array(column, pa.binary()).cast(pa.string())


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(lang, term, n): the number of documents of each language that hold a term."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), _text(list(found)), pa.array(found.values(), pa.int64())], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in returned(batches):
            for part in slices(batch, 0):
                for text, lang in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    counts.setdefault(lang, Counter()).update({t for own in words(utf8(text).translate(_LETTERS)) for t in own})
                if sum(map(len, counts.values())) > HELD:
                    yield from rows(counts)
                    counts = {}
        yield from rows(counts)

    found = _known(documents).select("text", "lang").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


class Matcher:
    """The kept terms of one language: short ones in an automaton, between blanks, long ones in a table."""

    def __init__(self, terms: list[str]) -> None:
        self.long = {t.encode() for t in terms if len(t.encode()) > LONG}
        self.automaton = ahocorasick.Automaton()
        for t in terms:
            if t.encode() not in self.long:
                self.automaton.add_word(f" {t} ", t)
        self.automaton.make_automaton()

    def occurrences(self, texts: list[str]) -> Iterator[str]:
        """Each occurrence of a kept term in ``texts``; neighbours share the blank between them."""
        bare = b" ".join([b"", *map(utf8, texts), b""]).translate(_LETTERS)
        if len(self.automaton):
            yield from (t for _, t in self.automaton.iter(bare.decode("utf-8", "surrogatepass")))
        if self.long:
            yield from (t.decode() for t in _LONG.findall(bare) if t in self.long)


def count_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, term, n): the occurrences of (lang, term) in each source of its language, none of 0.

    ``terms`` is taken in blocks of BLOCK bytes by hash; each is one pass.
    """
    spark = documents.sparkSession
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    n = -(-size // BLOCK)
    out = None
    for k in range(n):
        block: dict[str, list[str]] = {}
        for lang, term in terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).select("lang", "term").collect():
            block.setdefault(lang, []).append(term)
        given, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def rows(counts: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([source] * len(found)), pa.array(list(found)), pa.array(found.values(), pa.int64())], schema=_POSTINGS)

        def run(batches: Iterator[pa.RecordBatch], given=given, name=name) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple, Counter] = {}
            for batch in returned(batches, "divergence"):
                matchers = kept(("divergence", name), lambda: {lang: Matcher(own) for lang, own in given.value.items()})
                for part in slices(batch, 0):
                    texts: dict[tuple, list[str]] = {}
                    for text, lang, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if lang in matchers:
                            texts.setdefault((lang, source), []).append(text)
                    for key, own in texts.items():
                        counts.setdefault(key, Counter()).update(matchers[key[0]].occurrences(own))
                    if sum(map(len, counts.values())) > HELD:
                        yield from rows(counts)
                        counts = {}
            yield from rows(counts)

        found = _known(documents).select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long")
        part = stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "lang string, source string, term string, n long")


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kinds)), in whole numbers of 38 digits."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + SMOOTHING * kinds).cast("decimal(20,0)"))


def _distances(posts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of unlike shares of one block of terms, of each two sources of a language, in tiles of sources."""
    names, base = groups["source"].to_numpy(), groups["p0"].to_numpy()
    term = pd.factorize(posts["term"])[0]
    width = int(term.max()) + 1 if len(term) else 0
    own = pd.Index(names).get_indexer(posts["source"])
    order = np.argsort(own, kind="stable")
    own, term, share = own[order], term[order], posts["p"].to_numpy()[order]
    tiles = range(0, len(names), TILE)

    def dense(at: int) -> np.ndarray:
        some = slice(*np.searchsorted(own, [at, at + TILE]))
        table = np.repeat(base[at : at + TILE, None], width, axis=1)
        table[own[some] - at, term[some]] = share[some]
        return table

    out = []
    for x in tiles:
        left = dense(x)
        for y in tiles:
            if y >= x:
                right = left if y == x else dense(y)
                f = np.stack([np.abs(right - row).sum(axis=1) for row in left])
                i, j = (k.ravel() for k in np.indices(f.shape))
                some = (i + x) != (j + y) if y == x else np.ones(len(i), bool)
                one = pd.DataFrame({"source": names[i[some] + x], "item": names[j[some] + y], "value": f.ravel()[some]})
                out += [one] if y == x else [one, one.rename(columns={"source": "item", "item": "source"})]
    done = pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "value": []})
    done.insert(0, "lang", groups["lang"].iloc[0] if len(groups) else "")
    return done[["lang", "source", "item", "value"]]


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of each source of a language.

    ``pair``: the distance to each other source of the language. ``term``: the
    ``top`` kept terms whose share in the source exceeds that in the language
    most. Equal values are ranked by the item's bytes.
    """
    vocabulary = stored(document_frequencies(documents).where(F.col("n") >= least).select("lang", "term"))
    posts = stored(count_terms(documents, vocabulary))
    kinds = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _known(documents).select("lang", "source").distinct().join(kinds, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    width = Window.partitionBy("lang")
    groups = stored(groups.withColumn("lang_total", F.sum("total").over(width)).withColumn("s", F.count("*").over(width)))
    cells = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("s")))
    blocks = F.ceil(F.col("v") / F.least(F.lit(4096), cells)).cast("int")
    each = posts.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
    each = stored(each.select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block")))

    ahead = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Every kept term occurs in a source, so the blocks of postings hold all terms of a language between them.
    some = groups.where("v > 0 and s > 1").withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    spread = some.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    shared = each.join(groups.where("s > 1").select("lang").distinct(), "lang", "left_semi").select("lang", "source", "term", "p", "block")
    sums = shared.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInPandas(_distances, "lang string, source string, item string, value long")
    none = groups.where("v = 0").select("lang", "source")
    flat = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    apart = sums.unionByName(flat).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
