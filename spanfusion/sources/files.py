"""Documents as files: reading, kinds, chunks."""

from __future__ import annotations

import mimetypes
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds by extension, which win over those by content.
BY_EXTENSION = {ext[1:].lower(): kind for ext, kind in mimetypes.MimeTypes().types_map[True].items()}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files at any path or address that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def from_bytes(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    """(path, content) of contents at hand, or of open files; anything else raises an error."""
    for name, x in items:
        if not isinstance(x, bytes | bytearray) and not hasattr(x, "read"):
            raise ValueError(f"Unsupported content of {name}: {type(x).__name__}")
    rows = [(name, bytearray(x.read() if hasattr(x, "read") else x)) for name, x in items]
    return spark.createDataFrame(rows, "path string, content binary")


def mime_of_path(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def mime_of_content(content: Column) -> Column:
    def starts(at: int, value: str) -> Column:
        return F.hex(F.substring(content, at, len(value) // 2)) == value

    return (
        F.when(starts(1, "25504446"), "application/pdf")
        .when(starts(1, "89504E470D0A1A0A"), "image/png")
        .when(starts(1, "FFD8"), "image/jpeg")
        .when(starts(1, "52494646") & starts(9, "57454250"), "image/webp")
    )


def chunks(files: DataFrame, pages_per_chunk: int | None = None, count: Callable[[bytes], int] | None = None, cut: Callable[[bytes, int, int], bytes] | None = None, mime_type: str | None = None) -> DataFrame:
    """(path, document_sha256, chunk_idx, start_page, end_page, data, mime_type) of (path, content).

    An image is one chunk of one page. A PDF is one chunk of its own bytes, or
    with ``pages_per_chunk`` one for each run of pages; ``count`` tells a
    file's pages and ``cut`` writes some of them as a file, with whatever PDF
    library there is. Without ``count`` the pages of a PDF are not known and
    its ``end_page`` is missing. The kind is ``mime_type`` if that is given,
    else that of the path's extension, else that of the content. Anything but
    a PDF or an image raises an error, as does a missing content.
    """
    mime = F.lit(mime_type) if mime_type else F.coalesce(mime_of_path(F.col("path")), mime_of_content(F.col("content")))
    known = files.withColumn("mime", mime).withColumn("sha", F.sha2("content", 256))
    image = F.col("mime").startswith("image/")
    bad = F.raise_error(F.concat(F.lit("Unsupported kind of document: "), F.coalesce("mime", F.lit("unknown")), F.lit(" in "), F.col("path"))).cast("string")
    checked = known.withColumn("mime", F.when((image | (F.col("mime") == "application/pdf")) & F.col("content").isNotNull(), F.col("mime")).otherwise(bad))
    if count is None:
        if pages_per_chunk is not None:
            raise ValueError("cutting PDF files needs count and cut")
        pages = F.when(image, 1)
    else:
        pages = F.when(image, 1).otherwise(F.pandas_udf(lambda c: pd.Series([count(bytes(x)) for x in c]), "int")("content"))
    sized = checked.withColumn("n", pages)
    step = F.col("n") if pages_per_chunk is None else F.lit(pages_per_chunk)
    spread = sized.withColumn("start_page", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0)), F.greatest(step, F.lit(1)))))
    spread = spread.withColumn("end_page", F.when(F.col("n").isNotNull(), F.least(F.col("start_page") + step, F.col("n"))).cast("int"))
    data = F.col("content")
    if pages_per_chunk is not None:
        part = F.pandas_udf(lambda c, s, e: pd.Series([cut(bytes(x), int(a), int(b)) for x, a, b in zip(c, s, e, strict=True)]), "binary")
        data = F.when(F.col("mime").startswith("image/"), data).otherwise(part("content", "start_page", "end_page"))
    idx = (F.col("start_page") / F.greatest(step, F.lit(1))).cast("int")
    return spread.select("path", F.col("sha").alias("document_sha256"), idx.alias("chunk_idx"), "start_page", "end_page", data.alias("data"), F.col("mime").alias("mime_type"))
