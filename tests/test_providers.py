"""Providers, nested JSON, quotes in parts, and counts of interval pairs."""

from __future__ import annotations

import json
import random
import time

import pytest

from spanfusion.functions import kernels
from spanfusion.functions.text import normal_places
from spanfusion.operators import align, intervals, resolve, scans
from spanfusion.plans import providers
from spanfusion.plans.process import process_documents
from spanfusion.sources import nested

BOX = "array<struct<top:int,left:int,bottom:int,right:int>>"


def chunks(spark, n: int):
    return spark.createDataFrame([(d, c, f"text {d} {c}") for d in (1, 2) for c in range(n)], "doc_id long, chunk_idx int, markdown string")


def test_calls_are_bounded_and_in_order(spark):
    def call(row):
        state["now"] += 1
        state["most"] = max(state["most"], state["now"])
        time.sleep(0.002 * (5 - row["chunk_idx"] % 5))
        state["now"] -= 1
        return f"{row['markdown']}|{state['most']}"

    state = {"now": 0, "most": 0}
    rows = providers.called(chunks(spark, 30).coalesce(1), call, "string", concurrent=4).collect()
    assert [(r.doc_id, r.chunk_idx) for r in rows] == [(d, c) for d in (1, 2) for c in range(30)]
    most = max(int(r.answer.split("|")[1]) for r in rows)
    assert 2 <= most <= 4 and all(r.answer.startswith(f"text {r.doc_id} {r.chunk_idx}|") and r.error is None for r in rows)
    spread = providers.called(chunks(spark, 30), lambda row: row["markdown"], "string", partitions=7)
    assert spread.rdd.getNumPartitions() == 7 and spread.count() == 60


def test_failures_are_tried_again_and_are_rows(spark):
    def call(row):
        tries = seen.setdefault((row["doc_id"], row["chunk_idx"]), [])
        tries.append(1)
        if row["chunk_idx"] == 1 and len(tries) < 3:
            raise OSError("busy")
        if row["chunk_idx"] == 2:
            raise ValueError("no")
        return "ok"

    seen: dict = {}
    got = {(r.doc_id, r.chunk_idx): (r.answer, r.error, r.attempts) for r in providers.called(chunks(spark, 3).coalesce(1), call, "string", retries=2).collect()}
    assert got == {(d, c): x for d in (1, 2) for c, x in ((0, ("ok", None, 1)), (1, ("ok", None, 3)), (2, (None, "ValueError: no", 3)))}
    assert providers.called(chunks(spark, 0), call, "string").count() == 0


def test_answers_are_checked(spark):
    asked = chunks(spark, 3).drop("markdown")
    rows = [(1, 0, "a", None), (1, 1, "a", None), (1, 1, "b", None), (1, 7, "c", None), (2, 0, "d", None), (2, 1, None, "E: x"), (2, 2, "e", None)]
    given = spark.createDataFrame(rows, "doc_id long, chunk_idx int, answer string, error string")
    assert {(r.doc_id, r.chunk_idx): r.problem for r in providers.problems(asked, given).collect()} == {(1, 1): "doubled", (1, 2): "missing", (1, 7): "not asked for", (2, 1): "failed"}
    with pytest.raises(ValueError, match="document 1, chunk 1: doubled"):
        providers.sound(asked, given)
    assert providers.sound(asked, given, strict=False).count() == 0
    assert providers.sound(asked.where("doc_id = 2"), given.where("doc_id = 2 and chunk_idx <> 1"), strict=False).count() == 0
    assert {r.problem for r in providers.problems(asked.unionAll(asked), given.where("doc_id = 2")).collect()} == {"asked for twice", "missing"}


TEXTS = ["# Title\n\nThe first page says this.", "And the second page says something else."]


def boxes(row):
    text = TEXTS[row["chunk_idx"]]
    return [{"page": row["chunk_idx"], "text": ch, "top": 0, "left": k, "bottom": 9, "right": k + 1} for k, ch in enumerate(text)]


def lines(state, markdown):
    assert "<!--page-->" in markdown
    out = []
    for page in sorted({b["page"] for b in state}):
        text = "".join(b["text"] for b in state if b["page"] == page)
        out.append({"text": text.split("\n")[-1], "page": page, "boxes": [{"top": 0, "left": 0, "bottom": 9, "right": len(text)}]})
    return out


@pytest.mark.parametrize("kind", ["two", "one", "none"])
def test_documents_through_providers(spark, kind):
    given = spark.createDataFrame([(d, c) for d in (1, 2) for c in (1, 0)], "doc_id long, chunk_idx int")
    one = lambda row: [{"text": TEXTS[row["chunk_idx"]].split("\n")[-1], "page": row["chunk_idx"], "boxes": [{"top": 0, "left": 0, "bottom": 9, "right": 9}]}]
    provider = {"two": providers.TwoPhase(boxes, lines), "one": one, "none": None}[kind]
    rows = process_documents(given, lambda row: TEXTS[row["chunk_idx"]], provider).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2]
    for r in rows:
        assert r.markdown == "\n\n<!--page-->\n\n".join(TEXTS) and r.annotated.count("<span ") == (0 if kind == "none" else 2)
        assert ('data-page="1">And the second page says something else</span>.' in r.annotated) == (kind != "none")

    def fails(row):
        if row["doc_id"] == 2:
            raise ValueError("no")
        return TEXTS[row["chunk_idx"]]

    assert [r.doc_id for r in process_documents(given, fails, None, strict=False, retries=0).collect()] == [1]
    with pytest.raises(ValueError, match="document 2, chunk 0: failed"):
        process_documents(given, fails, None, retries=0)


def test_nested_lists(spark, tmp_path):
    box = {"top": 1, "left": 2, "bottom": 3, "right": 4}
    files = {
        "good.json": [[{"text": "a", "page": 0, "box": box}, {"text": "b", "page": 1, "boxes": [box, box]}], [], [{"text": "c", "page": 2, "box": box}]],
        "some.json": [[{"text": None, "page": 0, "box": box}, {"text": "b", "page": 1, "box": {"top": 1}}, {"page": 1, "text": "d"}, {"text": "e", "box": box}, {"text": "f", "page": 3, "box": box}], None],
    }
    for name, x in files.items():
        (tmp_path / name).write_text(json.dumps(x))
    (tmp_path / "bad.json").write_text('[[{"text": "a"')
    found, left = nested.anchor_lists(nested.read_texts(spark, str(tmp_path)))
    got = sorted((r.path.rsplit("/", 1)[1], r.chunk_idx, r.k, r.text, r.page, len(r.boxes)) for r in found.collect())
    assert got == [("good.json", 0, 0, "a", 0, 1), ("good.json", 0, 1, "b", 1, 2), ("good.json", 2, 0, "c", 2, 1), ("some.json", 0, 4, "f", 3, 1)]
    why = sorted(((r.path.rsplit("/", 1)[1], r.chunk_idx, r.k, r.problem) for r in left.collect()), key=repr)
    assert why == sorted([("bad.json", None, None, "no list of lists"), ("some.json", 0, 0, "no text"), ("some.json", 0, 1, "no box"), ("some.json", 0, 2, "no box"), ("some.json", 0, 3, "no page"), ("some.json", 1, None, "no list")], key=repr)
    texts = spark.createDataFrame([("x", json.dumps(["a", None, "b\n"])), ("y", "{}"), ("z", None), ("w", "[]")], "path string, body string")
    found, left = nested.chunk_lists(texts)
    assert sorted(tuple(r) for r in found.collect()) == [("x", 0, "a"), ("x", 2, "b\n")]
    assert {(r.path, r.chunk_idx, r.problem) for r in left.collect()} == {("x", 1, "no text"), ("y", None, "no list of texts"), ("z", None, "no list of texts")}


def parts(text: str, quote: str):
    """Rounds of plain alignment, with the used characters masked."""
    base, places = normal_places(text, trim=False)
    b = bytearray(normal_places(quote.strip(), trim=False)[0].encode())
    size, used, out = len(b), 0, []
    for _ in range(resolve.TURNS):
        h = [[0] * (len(base) + 1) for _ in range(len(b) + 1)]
        for j in range(1, len(b) + 1):
            for i in range(len(base) + 1):
                best = max(0, h[j - 1][i] - 2)
                if i:
                    s = -100 if b[j - 1] == resolve.MASKED else 1 if base[i - 1].encode()[0] == b[j - 1] else -1
                    best = max(best, h[j][i - 1] - 2, h[j - 1][i - 1] + s)
                h[j][i] = best
        top = max(map(max, h))
        if top < resolve.MIN_SCORE:
            break
        j, i = max((j, i) for j, row in enumerate(h) for i, v in enumerate(row) if v == top)
        cells = []
        while j and h[j][i]:
            s = 0 if not i else -100 if b[j - 1] == resolve.MASKED else 1 if base[i - 1].encode()[0] == b[j - 1] else -1
            if i and h[j][i] == h[j - 1][i - 1] + s:
                i, j = i - 1, j - 1
                cells.append(i)
                b[j] = resolve.MASKED
                used += 1
            elif h[j][i] == h[j - 1][i] - 2:
                j -= 1
                b[j] = resolve.MASKED
                used += 1
            else:
                i -= 1
        out += [(int(places[k]), int(places[k + 1])) for k in cells]
    return used / size if size else 0.0, set(out) if size and used >= resolve.MIN_SHARE * size else set()


def test_quotes_in_parts_equal_plain_rounds():
    r = random.Random(13)
    words = [f"{a}{b}" for a in ("ba", "cor", "del", "fim") for b in ("ka", "lon", "mir", "nes")]
    for _ in range(25):
        text = " ".join(r.choice(words) for _ in range(40)).replace("ka ", "ka. ")
        own = text.split(" ")
        pieces = [" ".join(own[k : k + r.randint(3, 7)]) for k in (r.randrange(30), r.randrange(30))]
        quote = f" {pieces[0]} zzz {pieces[1]} "
        if r.random() < 0.5:
            quote = quote.replace("o", "", 1)
        share, spans = resolve.aligned(*normal_places(text, trim=False), quote)
        cells = {(p, q) for s, e in spans for p, q in zip(range(s, e), range(s + 1, e + 1))}
        wanted, plain = parts(text, quote)
        assert share == wanted and cells == {(p, q) for s, e in plain for p, q in zip(range(s, e), range(s + 1, e + 1))}


def test_masked_parts_are_not_bridged(spark):
    tag = '<span data-bbox="{0},0,{0},9" data-page="0">{1}</span>'
    first, mid, last = "the opening words of it", "seven other words stand here", "and the closing words of it"
    text = f"{tag.format(1, first)} {tag.format(2, mid)} {tag.format(3, last)} <!-- {first} -->"
    docs = spark.createDataFrame([(1, text)], "doc_id long, annotated string")
    # The middle is taken first; what is left stands on both sides of it and is found in two more rounds, not in one across the mask.
    quote = f"{first} {mid}{mid[5:]} {last}"
    quotes = spark.createDataFrame([(1, quote), (1, "q" * 50 + " " + first), (1, "q" * 90 + " " + first), (1, None), (2, first), (1, first), (1, first)], "doc_id long, quote string")
    got = {x.quote: x for x in resolve.resolve(docs, quotes).collect()}
    assert [x.box.top for x in got[quote].locations] == [1, 2, 3] and got[quote].status == "found"
    assert got["q" * 50 + " " + first].status == "doubtful" and 0.3 <= got["q" * 50 + " " + first].share < 0.5
    assert got["q" * 90 + " " + first].status == "none" and got["q" * 90 + " " + first].locations == [] and got[None].status == "none"
    assert len(got) == 5
    # A comment is text like other text: its copy of the words stands last and is found first, where no box is.
    assert got[first].locations == [] and got[first].share == 1.0


def test_repeated_lines_are_placed_from_the_last_on(spark):
    line = "the same words on every line of it"
    for n, work in ((200, align.WORK), (3, 0)):
        text = "\n\n".join(["a beginning of its own"] + [line] * n)
        rows = [(1, k, line, 0, [(k, 0, k + 1, 9)]) for k in range(n)]
        anchors = spark.createDataFrame(rows, f"doc_id long, anchor_id long, text string, page int, boxes {BOX}")
        got = sorted((r.anchor_id, r.start, r.ord) for r in align.align(spark.createDataFrame([(1, text)], "doc_id long, markdown string"), anchors, work=work).collect())
        at = len("a beginning of its own") + 2
        assert got == [(k, at + (n - 1 - k) * (len(line) + 2), k) for k in range(n)]


def test_bounds_hold():
    r = random.Random(4)
    for _ in range(400):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(3, n))) for n in (90, 25))
        t = list(b)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(t))
            t[k] = r.choice(["", "a", "bc"])
        a = a[:20] + "".join(t) + a[20:]
        assert kernels.Runs(kernels.encoded(a)).most(kernels.encoded(b)) >= kernels.local_global(kernels.encoded(a), kernels.encoded(b))[0]


@pytest.mark.parametrize("stretch", [intervals.STRETCH, 3])
def test_pair_counts_equal_pairs(spark, monkeypatch, stretch):
    monkeypatch.setattr(intervals, "STRETCH", stretch)
    monkeypatch.setattr(scans, "STRETCH", stretch)
    r = random.Random(15)
    sides = [[(g, s, s + r.randint(-1, 9)) for g in (None, *range(5)) for s in [r.randint(-20, 40) for _ in range(r.randint(0, 9))]] for _ in range(2)]
    a, b = (spark.createDataFrame(x, "g int, s long, e long") for x in sides)
    got = {x.g: (x.n_overlaps, x.n_contained, x.n_in_range) for x in intervals.pair_counts(a, b, ["g"]).collect()}
    want = {}
    for g, s, e in sides[0]:
        for k, s2, e2 in sides[1]:
            if k == g and s < e and s2 < e2:
                old = want.get(g, (0, 0, 0))
                want[g] = (old[0] + (s < e2 and e > s2), old[1] + (s >= s2 and e <= e2), old[2] + (s2 <= s < e2))
    assert got == want
    assert intervals.pair_counts(a.limit(0), b, ["g"]).count() == 0
