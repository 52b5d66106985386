"""Quotes to page boxes, by repeated local alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanfusion.functions import kernels
from spanfusion.functions.text import SPANS, normal_places
from spanfusion.operators.intervals import overlaps
from spanfusion.operators.spans import plain_text, validation_map
from spanfusion.tables import stored

# Least score, least share of the quote, the share below which a find is doubtful, and rounds.
MIN_SCORE = 15
MIN_SHARE = 0.3
SURE_SHARE = 0.5
TURNS = 10
MASKED = ord("#")
LOT = 64  # quotes that are looked for in one copy of a text
FOUND = T.ArrayType(T.StructType([T.StructField("quote", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("spans", SPANS)]))


def matches(text: str, quote: str) -> list[tuple[int, int]]:
    """Stretches of ``text`` that the quote's parts align to; none if too little of the quote does."""
    return aligned(*normal_places(text, trim=False), quote)[1]


def aligned(base: str, places: np.ndarray, quote: str) -> tuple[float, list[tuple[int, int]]]:
    """The share of the quote that aligns to a normal text, and the stretches of its source; none below MIN_SHARE."""
    norm, _ = normal_places(quote.strip(), trim=False)
    if not norm:
        return 0.0, []
    a, b = kernels.encoded(base), kernels.encoded(norm).copy()
    out, used = [], 0
    for _ in range(TURNS):
        if (b == MASKED).all():
            break
        score, columns = kernels.local(a, b, MASKED, least=MIN_SCORE)
        if score < MIN_SCORE:
            break
        run: list[int] | None = None
        for kind, i, j in columns:
            if kind != "only a":
                used += 1
                b[j] = MASKED
            if kind == "match" and run and run[1] == i:
                run[1] = i + 1
            elif kind == "match":
                run = [i, i + 1]
                out.append(run)
            else:
                run = None
    share = used / len(norm)
    return share, [(int(places[s]), int(places[e])) for s, e in out] if used >= MIN_SHARE * len(norm) else []


@F.pandas_udf(FOUND)
def _matches(text: pd.Series, quotes: pd.Series) -> pd.Series:
    """What is found of each of the quotes; a text is normalised once."""
    out = []
    for t, own in zip(text, quotes, strict=True):
        base, places = normal_places(t or "", trim=False)
        found = [(q, *aligned(base, places, q or "")) for q in own]
        out.append([{"quote": q, "share": share, "spans": [{"s": s, "e": e} for s, e in spans]} for q, share, spans in found])
    return pd.Series(out)


def resolve(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, quote, locations, share, status): the boxes that (doc_id, quote) lies on in (doc_id, annotated).

    ``locations`` holds (page, box), sorted and distinct; it is empty for a
    quote that is not found. ``share`` of the quote was found; ``status`` is
    ``found``, ``doubtful`` below half, and ``none`` where too little is found
    to count. A quote given twice is answered once, a missing one is not found;
    quotes of unknown documents give no row. ``doc_id`` is taken to be unique.
    """
    asked = quotes.select("doc_id", "quote").distinct()
    lots = asked.withColumn("lot", F.pmod(F.xxhash64("quote"), F.ceil(F.count("*").over(Window.partitionBy("doc_id")) / LOT))).groupBy("doc_id", "lot").agg(F.collect_list("quote").alias("own"))
    texts = plain_text(documents).join(lots, "doc_id").select("doc_id", F.explode(_matches("plain_text", "own")).alias("m"))
    found = stored(texts.select("doc_id", "m.*"))
    boxes = validation_map(documents).withColumnRenamed("doc_id", "own")
    each = found.select("doc_id", "quote", F.explode("spans").alias("m"))
    hit = each.join(boxes, (F.col("doc_id") == F.col("own")) & overlaps(F.col("start"), F.col("end"), F.col("m.s"), F.col("m.e")))
    listed = hit.select("doc_id", "quote", "page", F.explode("boxes").alias("box")).groupBy("doc_id", "quote").agg(F.array_sort(F.collect_set(F.struct("page", "box"))).alias("locations"))
    none = F.from_json(F.lit("[]"), "array<struct<page:int,box:struct<top:int,left:int,bottom:int,right:int>>>")
    status = F.when(F.size("spans") == 0, "none").when(F.col("share") < SURE_SHARE, "doubtful").otherwise("found")
    missing = asked.where("quote is null").join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "quote", none.alias("locations"), F.lit(0.0).alias("share"), F.lit("none").alias("status"))
    told = found.join(listed, ["doc_id", "quote"], "left").select("doc_id", "quote", F.coalesce("locations", none).alias("locations"), "share", status.alias("status"))
    return told.unionByName(missing)
