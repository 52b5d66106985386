"""Nested JSON: files that hold a list of chunks, or a list of anchors for each chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<top:int,left:int,bottom:int,right:int>"
CHUNKS = "array<string>"
ANCHORS = f"array<array<struct<text:string,page:int,box:{BOX},boxes:array<{BOX}>>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of whole files at any path that Spark reads."""
    return spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _parsed(files: DataFrame, kind: str) -> DataFrame:
    return files.withColumn("found", F.from_json("body", kind, {"mode": "PERMISSIVE"}))


def chunk_lists(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (path, chunk_idx, markdown) of JSON lists of texts, and a quarantine (path, chunk_idx, problem).

    A file that is no list is one row of the quarantine, without a number; a
    missing text is one with its number, and the others of the file stay.
    """
    known = _parsed(files, CHUNKS)
    each = known.select("path", F.posexplode("found").alias("chunk_idx", "markdown"))
    bad = known.where("found is null").select("path", F.lit(None).cast("int").alias("chunk_idx"), F.lit("no list of texts").alias("problem"))
    return each.where("markdown is not null"), bad.unionByName(each.where("markdown is null").select("path", "chunk_idx", F.lit("no text").alias("problem")))


def _complete(box: Column) -> Column:
    return box.isNotNull() & box["top"].isNotNull() & box["left"].isNotNull() & box["bottom"].isNotNull() & box["right"].isNotNull()


def anchor_lists(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (path, chunk_idx, k, text, page, boxes) of JSON lists, one for each chunk, of anchors with a ``box`` or ``boxes``, and a quarantine (path, chunk_idx, k, problem)."""
    known = _parsed(files, ANCHORS)
    lists = known.select("path", F.posexplode("found").alias("chunk_idx", "own"))
    each = lists.select("path", "chunk_idx", F.posexplode("own").alias("k", "x")).select("path", "chunk_idx", "k", F.col("x.text").alias("text"), F.col("x.page").alias("page"), F.coalesce(F.col("x.boxes"), F.array("x.box")).alias("boxes"))
    boxed = (F.size("boxes") > 0) & F.forall("boxes", _complete)
    problem = F.when(F.col("text").isNull(), "no text").when(F.col("page").isNull(), "no page").when(~F.coalesce(boxed, F.lit(False)), "no box")
    told = each.withColumn("problem", problem)
    none = F.lit(None).cast("int")
    bad = known.where("found is null").select("path", none.alias("chunk_idx"), none.alias("k"), F.lit("no list of lists").alias("problem"))
    empty = lists.where("own is null").select("path", "chunk_idx", none.alias("k"), F.lit("no list").alias("problem"))
    quarantine = bad.unionByName(empty).unionByName(told.where("problem is not null").select("path", "chunk_idx", "k", "problem"))
    return told.where("problem is null").drop("problem"), quarantine
