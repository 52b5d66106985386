"""The queries of the alignment operators: name -> function of a session and a folder of tables, and their SQL."""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanfusion import tables
from spanfusion.functions.text import normal_text
from spanfusion.operators import align as alignment
from spanfusion.operators import intervals, markdown, resolve, spans
from spanfusion.plans import providers
from spanfusion.plans.process import process
from spanfusion.sources import nested
from spanfusion.sources.files import chunks, mime_of_content


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as Markdown: a page and a chunk for each ten, with markers before some."""
    return _as_chunks(_lines(spark, sf_dir))


def _as_chunks(lines: DataFrame) -> DataFrame:
    mark = F.when(F.col("i") % 7 == 3, "<!--table-->\n").otherwise(F.when(F.col("i") % 11 == 5, "<!--figure-->\n").otherwise(""))
    lines = lines.select("doc_id", F.expr("i div 10").cast("int").alias("chunk_idx"), F.struct("i", F.concat(mark, "line").alias("t")).alias("x"))
    parts = F.array_sort(F.collect_list("x"))
    return lines.groupBy("doc_id", "chunk_idx").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a scan would show them, broken every 80 characters."""
    rows = _lines(spark, sf_dir).select("doc_id", "i", F.posexplode(F.regexp_extract_all("line", F.lit(".{1,80}"), F.lit(0))).alias("k", "text")).where(F.trim("text") != "")
    box = F.struct((F.col("i") % 10 * 100 + F.col("k")).cast("int").alias("top"), F.lit(50).alias("left"), (F.col("i") % 10 * 100 + F.col("k") + 1).cast("int").alias("bottom"), F.lit(950).alias("right"))
    return rows.select("doc_id", (F.col("doc_id") * 1_000_000_000 + F.col("i") * 10_000 + F.col("k")).alias("anchor_id"), "text", F.expr("i div 10").cast("int").alias("page"), F.array(box).alias("boxes"))


def _line_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole texts, a span around each full line, some with two boxes, and one around the first half of each third line."""
    texts = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"))
    lines = texts.select("doc_id", F.posexplode(F.split("markdown", "\n", -1)).alias("i", "line"))
    upto = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("end", (F.sum(F.length("line") + 1).over(upto) - 1).cast("int")).withColumn("start", F.col("end") - F.length("line"))
    half = F.expr("cast(start + length(line) div 2 as int)")
    kinds = F.array(F.struct((2 * F.col("i")).alias("ord"), F.col("end").alias("end")), F.struct((2 * F.col("i") + 1).alias("ord"), F.when(F.col("i") % 3 == 0, half).otherwise(F.col("start")).alias("end")))
    each = placed.withColumn("k", F.explode(kinds))
    box = F.struct((F.col("i") % 10 * 100).cast("int").alias("top"), F.lit(50).alias("left"), (F.col("i") % 10 * 100 + 80).cast("int").alias("bottom"), F.lit(950).alias("right"))
    boxes = F.when(F.col("i") % 5 == 4, F.array(box, box)).otherwise(F.array(box))
    return texts, each.select("doc_id", "k.ord", "start", "k.end", F.expr("i div 10").cast("int").alias("page"), boxes.alias("boxes"))


def _ranges(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    e = _read(spark, sf_dir, "events").where((F.col("event_id") % 2 == odd) & F.col("value").isNotNull())
    s = F.floor(F.col("value") * 100).cast("long")
    return e.select("user_id", s.alias("s"), (s + 1 + F.col("event_id") % 500).alias("e"))


def interval_union(spark, sf_dir):
    return intervals.union(_ranges(spark, sf_dir, 0), _ranges(spark, sf_dir, 1), ["user_id"])


def interval_intersect(spark, sf_dir):
    return intervals.intersect(_ranges(spark, sf_dir, 0), _ranges(spark, sf_dir, 1), ["user_id"])


def interval_subtract(spark, sf_dir):
    return intervals.subtract(_ranges(spark, sf_dir, 0), _ranges(spark, sf_dir, 1), ["user_id"])


def interval_predicates(spark, sf_dir):
    """Counts, for each user, of pairs of an even and an odd range that hold each predicate."""
    return intervals.pair_counts(_ranges(spark, sf_dir, 0), _ranges(spark, sf_dir, 1), ["user_id"])


def normalize_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", normal_text(F.col("text")).alias("norm"))


def renumber_markers(spark, sf_dir):
    return markdown.renumber_markers(_chunks(spark, sf_dir))


def assemble_markdown(spark, sf_dir):
    return markdown.assemble(_chunks(spark, sf_dir))


def parse_segments(spark, sf_dir):
    made = markdown.assemble(_chunks(spark, sf_dir)).select("doc_id", F.concat(F.lit("<!--page-->"), "markdown").alias("markdown"))
    return markdown.parse_segments(made)


def annotate_lines(spark, sf_dir):
    return spans.annotate(*_line_spans(spark, sf_dir))


def strip_lines(spark, sf_dir):
    return spans.plain_text(spans.annotate(*_line_spans(spark, sf_dir)))


def validation_map(spark, sf_dir):
    found = spans.validation_map(spans.annotate(*_line_spans(spark, sf_dir)))
    return found.select("doc_id", "start", "end", "page", F.col("boxes")[0]["top"].alias("top"), F.size("boxes").alias("n_boxes"))


def span_coverage(spark, sf_dir):
    plain, placed = _line_spans(spark, sf_dir)
    return spans.coverage(plain, placed)


def sniff_files(spark, sf_dir):
    """Kinds told by the first bytes of contents made up for each document."""
    head = F.element_at(F.array(*(F.unhex(F.lit(x)) for x in ("255044462D", "89504E470D0A1A0A00", "FFD8FFE0", "524946460000000057454250", "00"))), (F.col("doc_id") % 5 + 1).cast("int"))
    made = _read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))
    return made.select("doc_id", mime_of_content(F.col("content")).alias("mime_type"), F.sha2("content", 256).alias("document_sha256"))


def file_chunks(spark, sf_dir):
    """Chunks of files made up of each document: images and PDF files, of 512 bytes a page and three pages a chunk, named with and without extension."""
    k = F.col("doc_id") % 4
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, ("", ".PDF", ".bmp", ".png"))), (k + 1).cast("int")))
    text = F.coalesce("text", F.lit("")).cast("binary")
    body = F.when(k == 0, F.concat(F.unhex(F.lit("255044462D")), text)).otherwise(text)
    made = _read(spark, sf_dir, "documents").select(name.alias("path"), body.alias("content"))
    found = chunks(made, 3, lambda c: -(-len(c) // 512), lambda c, s, e: c[512 * s : 512 * e])
    return found.select("path", "document_sha256", "chunk_idx", "start_page", "end_page", F.sha2("data", 256).alias("data_sha256"), "mime_type")


def high_confidence_hits(spark, sf_dir):
    e = _read(spark, sf_dir, "events").where(F.col("value").isNotNull())
    hits = e.select(F.col("user_id").alias("anchor_id"), F.col("event_type").alias("frag"), F.col("event_id").alias("hit"), F.col("value").alias("score"))
    return alignment.high_confidence(hits, ["anchor_id"], 0.98)


def _keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, key, line, body): each line behind a key of its own, which stands three times in each sixth."""
    key = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string")), 256)
    plain = F.replace(F.replace(F.col("line"), F.lit("<!--"), F.lit("<!-")), F.lit("$"), F.lit(""))
    rows = _lines(spark, sf_dir).select("doc_id", "i", key.alias("key"), plain.alias("line"))
    again = F.when(F.col("i") % 6 == 5, F.concat(F.lit(" "), "key", F.lit(" and "), "key")).otherwise("")
    return rows.withColumn("body", F.concat("key", F.lit(" "), "line", again))


def _keyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_chunks(_keyed_lines(spark, sf_dir).select("doc_id", "i", F.col("body").alias("line")))


def _keyed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the keyed lines: as they are with some of the line, with a character missing, with three characters changed, in no text at all, and in three places."""
    key, k = F.col("key"), F.col("i") % 6
    changed = F.concat(key.substr(1, 9), F.lit("z"), key.substr(11, 19), F.lit("z"), key.substr(31, 19), F.lit("z"), key.substr(51, 14))
    text = F.when(k == 2, F.concat(key.substr(1, 32), key.substr(34, 31))).when(k == 3, changed).when(k == 4, F.sha2(key, 256)).when(k == 5, key)
    text = text.otherwise(F.concat(key, F.lit(" "), F.substring("line", 1, 30)))
    rows = _keyed_lines(spark, sf_dir).withColumn("c", F.explode(F.sequence(F.lit(0), F.when(k == 5, 2).otherwise(0))))
    top = (F.col("i") % 10 * 100 + F.col("c")).cast("int")
    box = F.struct(top.alias("top"), F.lit(50).alias("left"), (top + 80).alias("bottom"), F.lit(950).alias("right"))
    return rows.select("doc_id", (F.col("doc_id") * 10_000_000 + F.col("i") * 10 + F.col("c")).alias("anchor_id"), text.alias("text"), F.expr("i div 10").cast("int").alias("page"), F.array(box).alias("boxes"))


def align_keyed_lines(spark, sf_dir):
    """Where the anchors of keyed lines stand: in one round, in later ones, with gaps, with changes, one after the other from the last place on, or nowhere."""
    made = markdown.assemble(markdown.renumber_markers(_keyed_chunks(spark, sf_dir)))
    return alignment.align(made, _keyed_anchors(spark, sf_dir))


def process_keyed_documents(spark, sf_dir):
    """Chunks and anchors of keyed lines to Markdown, annotated Markdown and the share covered."""
    return process(_keyed_chunks(spark, sf_dir), _keyed_anchors(spark, sf_dir))


def _refused(row: dict) -> str:
    """A provider that gives a digest of a chunk and refuses some."""
    if (row["doc_id"] + row["chunk_idx"]) % 9 == 4:
        raise ValueError("refused")
    return hashlib.sha256(row["markdown"].encode()).hexdigest()


def provider_answers(spark, sf_dir):
    """What a provider says of each chunk, refusals as rows."""
    return providers.called(_chunks(spark, sf_dir), _refused, "string", retries=1)


def provider_problems(spark, sf_dir):
    """The chunks whose answers are missing, doubled or refused, and answers that nobody asked for."""
    given = _chunks(spark, sf_dir)
    k = F.pmod(F.col("doc_id") * 3 + F.col("chunk_idx"), F.lit(11))
    told = tables.stored(providers.called(given, _refused, "string", retries=0))
    more = told.where(k == 5).unionByName(told.where("chunk_idx = 0 and doc_id % 13 = 2").withColumn("chunk_idx", F.col("chunk_idx") - 1))
    return providers.problems(given, told.where(k != 3).unionByName(more))


def _word_boxes(row: dict) -> list[dict]:
    """A box for each word of a chunk, twenty units a line and ten a word."""
    lines = enumerate(row["markdown"].split("\n"))
    return [{"page": row["chunk_idx"], "text": w, "top": 20 * i, "left": 10 * k, "bottom": 20 * i + 18, "right": 10 * k + 9} for i, line in lines for k, w in enumerate(x for x in line.split(" ") if x)]


def _lines_of_boxes(boxes: list[dict], text: str) -> list[dict]:
    """An anchor for each line of boxes that stands in the text."""
    out = []
    for (page, top), own in groupby(boxes, key=lambda b: (b["page"], b["top"])):
        own = list(own)
        line = " ".join(b["text"] for b in own)
        if line in text:
            out.append({"text": line, "page": page, "boxes": [{"top": top, "left": min(b["left"] for b in own), "bottom": max(b["bottom"] for b in own), "right": max(b["right"] for b in own)}]})
    return out


def two_phase_anchors(spark, sf_dir):
    """Anchors that a two-phase provider makes of the words of ten lines at a time, and of the whole text."""
    lines = _lines(spark, sf_dir).select("doc_id", F.expr("i div 10").cast("int").alias("chunk_idx"), F.struct("i", "line").alias("x"))
    given = lines.groupBy("doc_id", "chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("markdown"))
    provider = providers.TwoPhase(_word_boxes, _lines_of_boxes)
    boxes = tables.stored(providers.called(given, provider.process_chunk, f"array<{providers.CHAR_BOX}>"))
    found = providers.finalized(providers.sound(given, boxes), _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown")), provider)
    box = F.col("boxes")[0]
    return found.select("doc_id", "anchor_id", "text", "page", *(box[c].alias(c) for c in ("top", "left", "bottom", "right")))


def json_chunk_lists(spark, sf_dir):
    """Chunks of JSON lists made of the lines of each document, some with a missing text and some cut off, and why others are left out."""
    lines = F.split(F.col("text"), "\n", -1)
    k = F.col("doc_id") % 5
    holed = F.concat(F.slice(lines, 1, 1), F.array(F.lit(None).cast("string")), F.slice(lines, 2, F.size(lines)))
    body = F.to_json(F.when(k == 3, holed).otherwise(lines))
    made = _read(spark, sf_dir, "documents").where("text is not null").withColumn("body", body)
    cut = F.when(k == 4, F.expr("substring(body, 1, length(body) - 1)")).otherwise(F.col("body"))
    found, left = nested.chunk_lists(made.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), cut.alias("body")))
    return found.select("path", "chunk_idx", "markdown", F.lit(None).cast("string").alias("problem")).unionByName(left.withColumn("markdown", F.lit(None).cast("string")))


def resolve_fuzzy_quotes(spark, sf_dir):
    """A quote for each document, looked for in its keyed lines: one character short, of two lines apart with other words between, or hardly there."""
    rows = _keyed_lines(spark, sf_dir).withColumn("body", F.concat("body", F.lit(" 0000")))
    upto = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", (F.sum(F.length("body") + 1).over(upto) - 1).cast("int")).withColumn("start", F.col("end") - F.length("body"))
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n").alias("markdown"))
    box = F.struct(F.col("i").cast("int").alias("top"), F.lit(50).alias("left"), (F.col("i") + 1).cast("int").alias("bottom"), F.lit(950).alias("right"))
    boxed = placed.select("doc_id", F.col("i").alias("ord"), "start", "end", F.expr("i div 10").cast("int").alias("page"), F.array(box).alias("boxes"))
    other = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), (F.col("i") + 1).cast("string")), 256)
    short = F.concat(F.col("key").substr(1, 32), F.col("key").substr(34, 31))
    quote = F.when(F.col("doc_id") % 3 == 0, short).when(F.col("doc_id") % 3 == 1, F.concat("key", F.lit(f" {'q' * 12} "), other)).otherwise(F.concat(F.col("key").substr(1, 20), F.lit(" " + "q" * 70)))
    found = resolve.resolve(spans.annotate(texts, boxed), rows.where("i = 0").select("doc_id", quote.alias("quote")))
    return found.select("doc_id", "quote", "status", F.array_join(F.transform("locations", lambda x: F.concat_ws(" ", x["page"], x["box"]["top"])), ";").alias("locations"))


def align_documents(spark, sf_dir):
    """Markdown of each document with the places of its scanned lines, and the share that these cover."""
    return process(_chunks(spark, sf_dir), _anchors(spark, sf_dir))


def align_spans(spark, sf_dir):
    """Where the scanned lines of each document stand in its Markdown."""
    return alignment.align(markdown.assemble(markdown.renumber_markers(_chunks(spark, sf_dir))), _anchors(spark, sf_dir))


def resolve_quotes(spark, sf_dir):
    """The first line of each document and a part of its last, looked for in the annotated text; boxes as page, top, left, bottom and right."""
    plain, placed = _line_spans(spark, sf_dir)
    lines = F.split(F.col("markdown"), "\n", -1)
    quotes = plain.select("doc_id", F.explode(F.array(F.element_at(lines, 1), F.substring(F.element_at(lines, -1), 1, 60))).alias("quote"))
    box = lambda x: F.concat_ws(" ", x["page"], *(x["box"][k] for k in ("top", "left", "bottom", "right")))
    found = resolve.resolve(spans.annotate(plain, placed), quotes)
    return found.select("doc_id", "quote", F.size("locations").alias("n_locations"), F.array_join(F.transform("locations", box), ";").alias("locations"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_union, interval_intersect, interval_subtract, interval_predicates, normalize_text, renumber_markers, assemble_markdown, parse_segments,
        annotate_lines, strip_lines, validation_map, span_coverage, sniff_files, file_chunks, high_confidence_hits, align_keyed_lines, process_keyed_documents, provider_answers, provider_problems, two_phase_anchors, json_chunk_lists, resolve_fuzzy_quotes, align_spans, align_documents, resolve_quotes,
    )
}

_RANGES = """
ra AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) AS s, CAST(floor(value * 100) AS BIGINT) + 1 + event_id % 500 AS e, event_id % 2 AS side FROM events WHERE value IS NOT NULL)"""

_SWEEP = """WITH {ranges},
edges AS (
  SELECT user_id, s AS pos, CASE side WHEN 0 THEN 1 ELSE 0 END AS a, CASE side WHEN 1 THEN 1 ELSE 0 END AS b FROM ra
  UNION ALL SELECT user_id, e, CASE side WHEN 0 THEN -1 ELSE 0 END, CASE side WHEN 1 THEN -1 ELSE 0 END FROM ra),
sums AS (SELECT user_id, pos, sum(a) AS a, sum(b) AS b FROM edges GROUP BY user_id, pos),
run AS (SELECT user_id, pos, sum(a) OVER w AS a, sum(b) OVER w AS b FROM sums WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ons AS (SELECT user_id, pos, {holds} AS held FROM run),
turns AS (SELECT user_id, pos, held, coalesce(lag(held) OVER (PARTITION BY user_id ORDER BY pos), false) AS was FROM ons),
cut AS (SELECT user_id, pos, held, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM turns WHERE held <> was)
SELECT user_id, pos AS s, nxt AS e FROM cut WHERE held"""

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
_BARE = "CASE WHEN i % 7 = 3 THEN '<!--table-->' || chr(10) WHEN i % 11 = 5 THEN '<!--figure-->' || chr(10) ELSE '' END || line"
_MATH = r"'\$\$[\s\S]+?\$\$|\$[^$]+?\$'"
_TAGS = f"""{_LINES},
placed AS (SELECT doc_id, i, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS e FROM lines),
given AS (
  SELECT doc_id, 2 * i AS ord, i, e - n AS s, e FROM placed WHERE n > 0
  UNION ALL SELECT doc_id, 2 * i + 1, i, e - n, e - n + n // 2 FROM placed WHERE i % 3 = 0 AND n > 1),
cut AS (SELECT doc_id, regexp_extract_all(text, {_MATH}) AS m, string_split_regex(text, {_MATH}) AS p FROM documents),
parts AS (SELECT doc_id, unnest(m) AS m, unnest(p[:len(m)]) AS p, generate_subscripts(m, 1) AS k FROM cut),
formulas AS (SELECT doc_id, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS fe, length(m) AS n FROM parts),
grown AS (
  SELECT g.doc_id, ord, i, least(s, min(fe - n)) AS s, greatest(e, min(fe)) AS e
  FROM given g LEFT JOIN formulas f ON g.doc_id = f.doc_id AND greatest(s, fe - n) < least(e, fe) GROUP BY g.doc_id, ord, i, s, e),
boxed AS (SELECT *, (i % 10 * 100) || ',50,' || (i % 10 * 100 + 80) || ',950' AS box FROM grown),
tags AS (
  SELECT doc_id, s AS pos, 1 AS opens, s - e AS k1, ord AS k2, i,
    '<span data-bbox="' || box || CASE WHEN i % 5 = 4 THEN ';' || box ELSE '' END || '" data-page="' || (i // 10) || '">' AS tag FROM boxed
  UNION ALL SELECT doc_id, e, 0, e - s, -ord, i, '</span>' FROM boxed),
ranked AS (SELECT *, row_number() OVER w AS r, lag(pos, 1, 0) OVER w AS was, sum(2 * opens - 1) OVER w + 1 - opens AS level FROM tags WINDOW w AS (PARTITION BY doc_id ORDER BY pos, opens, k1, k2 ROWS UNBOUNDED PRECEDING))"""

_KEYED = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
keyed AS (
  SELECT doc_id, i, sha256(doc_id || ':' || i) AS key, replace(replace(raw, '<!--', '<!-'), '$', '') AS line, CASE WHEN i % 7 = 3 THEN 'table' WHEN i % 11 = 5 THEN 'figure' END AS kind FROM lines),
marked AS (
  SELECT *, CASE WHEN kind IS NULL THEN '' ELSE '<!--' || kind || ': ' || row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) || '-->' || chr(10) END AS mark,
    key || ' ' || line || CASE WHEN i % 6 = 5 THEN ' ' || key || ' and ' || key ELSE '' END AS body, CASE WHEN i % 10 = 9 THEN 15 ELSE 2 END AS gap
  FROM keyed),
placed AS (SELECT *, sum(length(mark) + length(body) + gap) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(body) - gap AS pos FROM marked),
found AS (
  SELECT doc_id, i, 0 AS c, pos AS s, pos + CASE WHEN i % 6 < 2 THEN length(regexp_replace(key || ' ' || substr(line, 1, 30), '[^a-zA-Z0-9' || chr(8490) || ']+$', '')) ELSE 64 END AS e FROM placed WHERE i % 6 < 4
  UNION ALL SELECT doc_id, i, c, pos + CASE c WHEN 0 THEN length(body) - 64 WHEN 1 THEN length(body) - 133 ELSE 0 END, pos + CASE c WHEN 0 THEN length(body) WHEN 1 THEN length(body) - 69 ELSE 64 END
  FROM placed, range(0, 3) AS copies(c) WHERE i % 6 = 5)"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(8490), 'abcdefghijklmnopqrstuvwxyzk')"
_BARE_OF_SPACE = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_BOUNDARY = rf"[.!?][{markdown.SUPERSCRIPTS}]*(?:\s+\d[\d,\-]*)?\s+"

_CHUNKS = f"""{_LINES},
chunks AS (SELECT doc_id, CAST(i // 10 AS INTEGER) AS chunk_idx, string_agg({_BARE}, chr(10) || chr(10) ORDER BY i) AS t FROM lines GROUP BY doc_id, i // 10)"""

ORACLES = {
    "provider_answers": f"""WITH {_CHUNKS}
SELECT doc_id, chunk_idx, CASE WHEN (doc_id + chunk_idx) % 9 <> 4 THEN sha256(t) END AS answer, CASE WHEN (doc_id + chunk_idx) % 9 = 4 THEN 'ValueError: refused' END AS error,
  CASE WHEN (doc_id + chunk_idx) % 9 = 4 THEN 2 ELSE 1 END AS attempts
FROM chunks""",
    "provider_problems": f"""WITH {_CHUNKS},
told AS (
  SELECT doc_id, chunk_idx, CASE (doc_id * 3 + chunk_idx) % 11 WHEN 3 THEN 'missing' WHEN 5 THEN 'doubled' ELSE CASE WHEN (doc_id + chunk_idx) % 9 = 4 THEN 'failed' END END AS problem,
    CASE WHEN (doc_id * 3 + chunk_idx) % 11 <> 3 AND (doc_id + chunk_idx) % 9 = 4 THEN 'ValueError: refused' END AS error
  FROM chunks
  UNION ALL SELECT doc_id, -1, 'not asked for', CASE WHEN doc_id % 9 = 4 THEN 'ValueError: refused' END FROM chunks WHERE chunk_idx = 0 AND doc_id % 13 = 2)
SELECT doc_id, chunk_idx, problem, error FROM told WHERE problem IS NOT NULL""",
    "two_phase_anchors": f"""WITH {_LINES},
split AS (SELECT doc_id, i, regexp_extract_all(line, '[^ ]+') AS w FROM lines),
found AS (SELECT s.doc_id, i, array_to_string(w, ' ') AS line, len(w) AS n FROM split s JOIN documents d USING (doc_id) WHERE len(w) > 0 AND contains(text, array_to_string(w, ' ')))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS anchor_id, line AS text, CAST(i // 10 AS INTEGER) AS page, CAST(i % 10 * 20 AS INTEGER) AS top, 0 AS "left",
  CAST(i % 10 * 20 + 18 AS INTEGER) AS bottom, CAST(10 * n - 1 AS INTEGER) AS "right"
FROM found""",
    "json_chunk_lists": f"""WITH {_LINES}
SELECT 'f' || doc_id AS path, CAST(i + CASE WHEN doc_id % 5 = 3 AND i > 0 THEN 1 ELSE 0 END AS INTEGER) AS chunk_idx, line AS markdown, NULL::VARCHAR AS problem FROM lines WHERE doc_id % 5 <> 4
UNION ALL SELECT 'f' || doc_id, CASE WHEN doc_id % 5 = 3 THEN 1 END, NULL, CASE WHEN doc_id % 5 = 3 THEN 'no text' ELSE 'no list of texts' END FROM documents WHERE text IS NOT NULL AND doc_id % 5 > 2""",
    "resolve_fuzzy_quotes": f"""WITH {_LINES},
sizes AS (SELECT doc_id, max(i) AS last FROM lines GROUP BY doc_id),
asked AS (SELECT doc_id, last, doc_id % 3 AS k, sha256(doc_id || ':0') AS a, sha256(doc_id || ':1') AS b FROM sizes)
SELECT doc_id, CASE k WHEN 0 THEN substr(a, 1, 32) || substr(a, 34) WHEN 1 THEN a || ' qqqqqqqqqqqq ' || b ELSE substr(a, 1, 20) || ' ' || repeat('q', 70) END AS quote,
  CASE k WHEN 0 THEN 'found' WHEN 1 THEN CASE WHEN last = 0 THEN 'doubtful' ELSE 'found' END ELSE 'none' END AS status,
  CASE k WHEN 0 THEN '0 0' WHEN 1 THEN CASE WHEN last = 0 THEN '0 0' ELSE '0 0;0 1' END ELSE '' END AS locations
FROM asked""",
    "align_keyed_lines": f"""WITH {_KEYED}
SELECT doc_id, doc_id * 10000000 + i * 10 + c AS anchor_id, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) - 1 AS INTEGER) AS ord FROM found""",
    "process_keyed_documents": f"""WITH {_KEYED},
made AS (
  SELECT doc_id, string_agg(CASE WHEN i > 0 THEN CASE WHEN i % 10 = 0 THEN chr(10) || chr(10) || '<!--page-->' || chr(10) || chr(10) ELSE chr(10) || chr(10) END ELSE '' END || mark || body, '' ORDER BY i) AS markdown
  FROM marked GROUP BY doc_id),
cut AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS was FROM found),
tagged AS (
  SELECT doc_id, max(e) AS last, sum(e - s) AS n, string_agg(substr(markdown, CAST(was + 1 AS BIGINT), CAST(s - was AS BIGINT)) || '<span data-bbox="' || (i % 10 * 100 + c) || ',50,' || (i % 10 * 100 + c + 80) || ',950" data-page="' || (i // 10) || '">'
    || substr(markdown, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) || '</span>', '' ORDER BY s) AS head
  FROM cut JOIN made USING (doc_id) GROUP BY doc_id)
SELECT doc_id, markdown, head || substr(markdown, CAST(last + 1 AS BIGINT)) AS annotated, CAST(n AS DOUBLE) / length(markdown) AS coverage FROM made JOIN tagged USING (doc_id)""",
    "interval_union": _SWEEP.format(ranges=_RANGES.strip(), holds="a > 0 OR b > 0"),
    "interval_intersect": _SWEEP.format(ranges=_RANGES.strip(), holds="a > 0 AND b > 0"),
    "interval_subtract": _SWEEP.format(ranges=_RANGES.strip(), holds="a > 0 AND NOT b > 0"),
    "interval_predicates": f"""WITH {_RANGES.strip()}
SELECT x.user_id, count(*) FILTER (x.s < y.e AND x.e > y.s) AS n_overlaps, count(*) FILTER (x.s >= y.s AND x.e <= y.e) AS n_contained,
  count(*) FILTER (y.s <= x.s AND x.s < y.e) AS n_in_range
FROM ra x JOIN ra y ON x.user_id = y.user_id AND x.side = 0 AND y.side = 1 GROUP BY x.user_id""",
    "parse_segments": rf"""WITH {_LINES},
chunks AS (SELECT doc_id, i // 10 AS c, string_agg({_BARE}, chr(10) || chr(10) ORDER BY i) AS t FROM lines GROUP BY doc_id, i // 10),
made AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) || '<!--page-->' || chr(10) || chr(10) ORDER BY c) AS t FROM chunks GROUP BY doc_id),
apart AS (SELECT doc_id, chr(10) || chr(10) || '<!--page-->' || CASE WHEN t LIKE chr(10) || '%' THEN '' ELSE chr(10) || chr(10) END || t AS md FROM made),
cut AS (SELECT doc_id, string_split_regex(md, '\n{{2,}}') AS b, regexp_extract_all(md, '\n{{2,}}') AS g FROM apart),
each AS (SELECT doc_id, unnest(b) AS block, unnest(list_concat(g, [''])) AS gap, generate_subscripts(b, 1) AS i FROM cut),
blocks AS (
  SELECT doc_id, i, block, sum(length(block) + length(gap)) OVER w - length(gap) AS md_end,
    sum((length(block) - length(replace(block, '<!--page-->', ''))) // 11) OVER w - 1 AS page
  FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
bare AS (SELECT doc_id, i, page, md_end, md_end - length(block) AS md_start, {_BARE_OF_SPACE.format("regexp_replace(block, '(?s)<!--.*?-->', '', 'g')")} AS t FROM blocks WHERE page >= 0),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(t, '^#{{1,6}}\s') THEN 'line' WHEN t LIKE '>%' THEN 'quote' WHEN regexp_matches(t, '^\s{{0,3}}([-*+]|\d+[.)]) ') THEN 'line'
    WHEN regexp_matches(t, '^\s*\|[-:\s|]+\|\s*$') THEN 'rule' WHEN contains(t, '|') THEN 'table' ELSE 'prose' END AS kind
  FROM bare WHERE t <> ''),
prose AS (
  SELECT doc_id, i, regexp_replace(CASE kind WHEN 'quote' THEN {_BARE_OF_SPACE.format("regexp_replace(t, '^>[\\s]?', '')")} ELSE t END, '({_BOUNDARY})([A-Z])', '\1' || chr(1) || '\2', 'g') AS t
  FROM kinds WHERE kind IN ('quote', 'prose')),
pieces AS (SELECT doc_id, i, unnest(string_split(t, chr(1))) AS t, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM prose),
words AS (SELECT *, regexp_extract(regexp_replace(t, '{_BOUNDARY}$', ''), '([a-zA-Z]+)[{markdown.SUPERSCRIPTS}0-9,\-]*$', 1) AS word FROM pieces),
ends AS (SELECT *, CASE WHEN word = '' OR (length(word) > 1 AND lower(word) NOT IN ({", ".join(f"'{w}'" for w in sorted(markdown.ABBREVIATIONS))})) THEN 1 ELSE 0 END AS over FROM words),
runs AS (SELECT *, sum(over) OVER (PARTITION BY doc_id, i ORDER BY k ROWS UNBOUNDED PRECEDING) - over AS run FROM ends),
texts AS (
  SELECT doc_id, i, run AS k, string_agg(t, '' ORDER BY k) AS t FROM runs GROUP BY doc_id, i, run
  UNION ALL SELECT doc_id, i, 0, t FROM kinds WHERE kind = 'line'
  UNION ALL SELECT doc_id, i, generate_subscripts(string_split(t, '|'), 1), unnest(string_split(t, '|')) FROM kinds WHERE kind = 'table'),
found AS (SELECT doc_id, i, k, {_BARE_OF_SPACE.format("t")} AS t FROM texts)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS seq, f.t AS text, CAST(page AS INTEGER) AS page,
  CAST(md_start AS INTEGER) AS md_start, CAST(md_end AS INTEGER) AS md_end
FROM found f JOIN bare USING (doc_id, i) WHERE f.t <> ''""",
    "resolve_quotes": f"""WITH {_TAGS},
paired AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, level ORDER BY r) AS e FROM ranked),
texts AS (SELECT doc_id, length(text) AS n, {_LOW.format("text")} AS low, string_split(text, chr(10)) AS l FROM documents),
asked AS (SELECT DISTINCT doc_id, unnest([l[1], substr(l[-1], 1, 60)]) AS quote FROM texts),
split AS (SELECT doc_id, regexp_extract_all(low, '[a-z0-9]+|[^a-z0-9]+') AS t FROM texts),
tokens AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM split),
sized AS (SELECT doc_id, k, length(t) AS n, CASE WHEN regexp_matches(t, '[a-z0-9]') THEN length(t) ELSE 1 END AS m FROM tokens),
places AS (SELECT doc_id, sum(n) OVER w - n AS at, sum(m) OVER w - m AS s, sum(m) OVER w AS e FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
norms AS (SELECT doc_id, n, regexp_replace(low, '[^a-z0-9]+', ' ', 'g') AS a FROM texts),
quotes AS (SELECT doc_id, quote, regexp_replace({_LOW.format(_BARE_OF_SPACE.format("quote"))}, '[^a-z0-9]+', ' ', 'g') AS b FROM asked),
last AS (SELECT doc_id, quote, n, length(a) - position(reverse(b) IN reverse(a)) - length(b) + 1 AS s, length(b) AS m FROM quotes JOIN norms USING (doc_id) WHERE length(b) >= {resolve.MIN_SCORE}),
met AS (
  SELECT q.doc_id, quote, x.at + q.s - x.s AS s, coalesce(y.at + q.s + q.m - y.s, n) AS e
  FROM last q JOIN places x ON q.doc_id = x.doc_id AND x.s <= q.s AND q.s < x.e LEFT JOIN places y ON q.doc_id = y.doc_id AND y.s <= q.s + q.m AND q.s + q.m < y.e),
hits AS (SELECT DISTINCT m.doc_id, quote, i // 10 AS page, i % 10 * 100 AS top FROM met m JOIN paired p ON m.doc_id = p.doc_id AND opens = 1 AND pos < m.e AND p.e > m.s)
SELECT doc_id, quote, CAST(count(page) AS INTEGER) AS n_locations, coalesce(string_agg(page || ' ' || top || ' 50 ' || (top + 80) || ' 950', ';' ORDER BY page, top), '') AS locations
FROM asked LEFT JOIN hits USING (doc_id, quote) GROUP BY doc_id, quote""",
    "normalize_text": """SELECT doc_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(8490), 'abcdefghijklmnopqrstuvwxyzk'), '[^a-z0-9]+', ' ', 'g'), ' ') AS norm
FROM documents""",
    "renumber_markers": f"""WITH {_LINES},
kinds AS (SELECT doc_id, line, i, CASE WHEN i % 7 = 3 THEN 'table' WHEN i % 11 = 5 THEN 'figure' END AS kind FROM lines),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS n FROM kinds)
SELECT doc_id, CAST(i // 10 AS INTEGER) AS chunk_idx,
  string_agg(CASE WHEN kind IS NULL THEN '' ELSE '<!--' || kind || ': ' || n || '-->' || chr(10) END || line, chr(10) || chr(10) ORDER BY i) AS markdown
FROM numbered GROUP BY doc_id, i // 10""",
    "assemble_markdown": f"""WITH {_LINES},
chunks AS (SELECT doc_id, i // 10 AS c, string_agg({_BARE}, chr(10) || chr(10) ORDER BY i) AS t FROM lines GROUP BY doc_id, i // 10)
SELECT doc_id, string_agg(t, chr(10) || chr(10) || '<!--page-->' || chr(10) || chr(10) ORDER BY c) AS markdown FROM chunks GROUP BY doc_id""",
    "annotate_lines": f"""WITH {_TAGS},
made AS (SELECT doc_id, string_agg(substr(text, CAST(was + 1 AS BIGINT), CAST(pos - was AS BIGINT)) || tag, '' ORDER BY r) AS head, max(pos) AS pos FROM ranked JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(head || substr(text, CAST(pos + 1 AS BIGINT)), text) AS annotated FROM documents LEFT JOIN made USING (doc_id)""",
    "strip_lines": "SELECT doc_id, text AS plain_text FROM documents",
    "validation_map": f"""WITH {_TAGS},
paired AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id, level ORDER BY r) AS e FROM ranked)
SELECT doc_id, CAST(pos AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", CAST(i // 10 AS INTEGER) AS page, CAST(i % 10 * 100 AS INTEGER) AS top,
  CASE WHEN i % 5 = 4 THEN 2 ELSE 1 END AS n_boxes
FROM paired WHERE opens = 1""",
    "span_coverage": f"""WITH {_LINES}
SELECT d.doc_id, coalesce(CAST(sum(length(line)) AS DOUBLE) / nullif(any_value(length(d.text)), 0), 0.0) AS coverage
FROM documents d LEFT JOIN lines USING (doc_id) GROUP BY d.doc_id""",
    "sniff_files": """WITH made AS (
  SELECT doc_id, unhex(CASE doc_id % 5 WHEN 0 THEN '255044462D' WHEN 1 THEN '89504E470D0A1A0A00' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '524946460000000057454250' ELSE '00' END) || encode(text) AS content FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' END AS mime_type, sha256(content) AS document_sha256
FROM made""",
    "file_chunks": """WITH made AS (
  SELECT doc_id % 4 AS k, 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.PDF' WHEN 2 THEN '.bmp' ELSE '.png' END AS path,
    CASE doc_id % 4 WHEN 0 THEN '255044462D' ELSE '' END || hex(encode(coalesce(text, ''))) AS x
  FROM documents),
sized AS (SELECT *, CASE WHEN k < 2 THEN (len(x) // 2 + 511) // 512 ELSE 1 END AS n FROM made),
parts AS (SELECT *, unnest(range(0, greatest(n, 1), 3)) AS s FROM sized)
SELECT path, sha256(unhex(x)) AS document_sha256, CAST(s // 3 AS INTEGER) AS chunk_idx, CAST(s AS INTEGER) AS start_page, CAST(least(s + 3, n) AS INTEGER) AS end_page,
  sha256(unhex(CASE WHEN k < 2 THEN substr(x, 1024 * s + 1, 1024 * (least(s + 3, n) - s)) ELSE x END)) AS data_sha256,
  CASE WHEN k < 2 THEN 'application/pdf' WHEN k = 2 THEN 'image/bmp' ELSE 'image/png' END AS mime_type
FROM parts""",
    "high_confidence_hits": """WITH ranked AS (
  SELECT user_id AS anchor_id, event_type AS frag, event_id AS hit, value AS score, row_number() OVER w AS place, lead(value) OVER w AS second
  FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_type, event_id))
SELECT anchor_id, frag, hit, score FROM ranked WHERE place = 1 AND (second IS NULL OR second < score * 0.98)""",
}
