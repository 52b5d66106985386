"""Providers: what makes Markdown and anchors of chunks, called at a bound, checked, and with failures as rows.

Chunks are rows with ``doc_id`` and ``chunk_idx``. A provider of Markdown gives
a text for a chunk; a provider of anchors a list of anchors; a two-phase
provider first gives the character boxes of a chunk, which are kept as a table,
and then anchors of a document's boxes and its assembled Markdown.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "struct<top:int,left:int,bottom:int,right:int>"
ANCHOR = f"struct<text:string,page:int,boxes:array<{BOX}>>"
CHAR_BOX = "struct<page:int,text:string,top:int,left:int,bottom:int,right:int>"
CONCURRENT = 8
RETRIES = 2
PIECE = 64  # rows of which answers are held at a time


@dataclass(frozen=True)
class TwoPhase:
    """A provider with state: ``process_chunk`` gives the character boxes of a chunk, ``finalize`` anchors of a document's boxes, in order, and its Markdown."""

    process_chunk: Callable[[dict], list[dict]]
    finalize: Callable[[list[dict], str], list[dict]]


def _attempt(call: Callable[[dict], object], row: dict, retries: int) -> tuple[object, str | None, int]:
    for k in range(retries + 1):
        try:
            return call(row), None, k + 1
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is an answer
            failed = f"{type(e).__name__}: {e}"
    return None, failed, retries + 1


def called(chunks: DataFrame, call: Callable[[dict], object], answer: str, concurrent: int = CONCURRENT, retries: int = RETRIES, partitions: int | None = None) -> DataFrame:
    """(doc_id, chunk_idx, answer, error, attempts): ``call`` of each row of ``chunks``.

    Each task has at most ``concurrent`` calls under way and as many answers
    waiting, in the order of its rows, and hands answers on PIECE at a time, as
    a chunk may have thousands of boxes; ``partitions`` spreads the rows first. A
    call that fails is tried again ``retries`` times; the last failure is a row
    with an ``error`` and no answer, and stops no other call.
    """
    rows = chunks if partitions is None else chunks.repartition(partitions, "doc_id", "chunk_idx")
    kind = f"doc_id long, chunk_idx int, answer {answer}, error string, attempts int"
    names = T.StructType.fromDDL(kind).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrent) as pool:
            out, under_way = [], deque[tuple[dict, Future]]()

            def take() -> None:
                row, done = under_way.popleft()
                out.append((row["doc_id"], row["chunk_idx"], *done.result()))

            for pdf in batches:
                for at in range(0, len(pdf), PIECE):
                    for row in pdf.iloc[at : at + PIECE].to_dict("records"):
                        if len(under_way) >= 2 * concurrent:
                            take()
                        under_way.append((row, pool.submit(_attempt, call, row, retries)))
                    if len(out) >= PIECE:
                        yield pd.DataFrame(out, columns=names)
                        out.clear()
            while under_way:
                take()
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, kind)


def problems(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, problem, error) of chunks with no answer, with several, with a failed one, and of answers that nobody asked for."""
    asked = chunks.groupBy("doc_id", "chunk_idx").agg(F.count("*").alias("asked"))
    given = answers.groupBy("doc_id", "chunk_idx").agg(F.count("*").alias("given"), F.max("error").alias("error"))
    a, g = asked.alias("a"), given.alias("g")
    both = a.join(g, F.col("a.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("a.chunk_idx").eqNullSafe(F.col("g.chunk_idx")), "full_outer")
    problem = (
        F.when(F.col("given").isNull(), "missing").when(F.col("asked").isNull(), "not asked for").when(F.col("asked") > 1, "asked for twice")
        .when(F.col("given") > 1, "doubled").when(F.col("error").isNotNull(), "failed")
    )
    there = F.col("asked").isNotNull()
    pick = lambda c: F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"g.{c}")).alias(c)
    return both.select(pick("doc_id"), pick("chunk_idx"), problem.alias("problem"), "error").where("problem is not null")


def sound(chunks: DataFrame, answers: DataFrame, strict: bool = True) -> DataFrame:
    """The answers of documents without problems; with ``strict`` a problem is an error that names the first of them."""
    wrong = problems(chunks, answers)
    if strict:
        first = wrong.orderBy("doc_id", "chunk_idx").limit(1).collect()
        if first:
            raise ValueError(f"document {first[0].doc_id}, chunk {first[0].chunk_idx}: {first[0].problem}" + (f" ({first[0].error})" if first[0].error else ""))
        return answers
    bad = wrong.select(F.col("doc_id").alias("bad")).distinct()
    return answers.join(bad, F.col("doc_id").eqNullSafe(F.col("bad")), "left_anti")


def anchors_of(answers: DataFrame) -> DataFrame:
    """(doc_id, anchor_id, text, page, boxes) of answers that are lists of anchors; ids follow the chunks and the order in them."""
    each = answers.select("doc_id", "chunk_idx", F.posexplode("answer").alias("k", "x"))
    return each.select("doc_id", (F.col("chunk_idx").cast("long") * (1 << 32) + F.col("k")).alias("anchor_id"), "x.text", "x.page", "x.boxes")


def finalized(boxes: DataFrame, documents: DataFrame, provider: TwoPhase) -> DataFrame:
    """Anchors that ``provider`` makes of the character boxes (answers of its first phase) and the Markdown of each document.

    A document without boxes or without Markdown has no anchors.
    """
    kind = f"doc_id long, chunk_idx int, answer array<{ANCHOR}>"

    def run(own: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(texts):
            ordered = own.sort_values("chunk_idx", kind="stable")
            state = [dict(b) for answer in ordered["answer"] if answer is not None for b in answer]
            out.append((own["doc_id"].iloc[0], 0, provider.finalize(state, texts["markdown"].iloc[0] or "")))
        return pd.DataFrame(out, columns=["doc_id", "chunk_idx", "answer"])

    return anchors_of(boxes.groupBy("doc_id").cogroup(documents.groupBy("doc_id")).applyInPandas(run, kind))
