"""Chat formatting, ranked search and source divergence, on small tables and against brute force."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re

import pytest

from spanfusion.llm import chat, divergence, queries, search

SAID = "</s>[INST] ok [/INST]"


def records(spark, rows):
    return spark.createDataFrame([(c, t, x if isinstance(x, str) or x is None else json.dumps(x)) for c, t, x in rows], "conv_id long, turn long, record string")


def test_layouts_become_the_same_turns(spark):
    want = [("system", "be brief"), ("user", "why?"), ("assistant", "so.")]
    layouts = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in want]},
        "conversations": {"system": "be brief", "conversations": [{"from": "human", "value": "why?"}, {"from": "gpt", "value": "so."}]},
        "prompt_completion": {"system": "be brief", "prompt": "why?", "completion": "so."},
        "prompt_response": {"system": "be brief", "prompt": "why?", "response": "so."},
        "question_answer": {"system_prompt": "be brief", "question": "why?", "answer": "so."},
        "instruction": {"system": "be brief", "instruction": "why?", "output": "so.", "id": 7, "meta": {"role": "x"}},
        "preference": {"prompt": "why?", "chosen": [{"role": r, "content": t} for r, t in want], "rejected": [{"role": "user", "content": "no"}]},
    }
    table = records(spark, [(k, 0, x) for k, x in enumerate(layouts.values())])
    found = chat.canonical(table).orderBy("conv_id", "seq").collect()
    for k, name in enumerate(layouts):
        own = [r for r in found if r.conv_id == k]
        assert [(r.role, r.text) for r in own] == want and {r.layout for r in own} == {name}
    more = chat.canonical(records(spark, [(0, 0, {"instruction": "add", "input": "1 2", "output": "3"}), (1, 0, {"instruction": "add", "input": "", "output": ""})])).orderBy("conv_id", "seq").collect()
    assert [(r.role, r.text) for r in more] == [("user", "add\n\n1 2"), ("assistant", "3"), ("user", "add"), ("assistant", "")]


def test_records_without_a_layout_stay_as_problems(spark):
    deep = '{"a":' * 50_000
    table = records(spark, [(1, 0, {"nothing": "known"}), (2, 0, "[1]"), (3, 0, None), (None, 0, ""), (5, 0, deep), (6, None, {"messages": []}), (7, 0, {"messages": [{"role": "user", "content": 3}]})])
    found = chat.canonical(table).collect()
    assert len(found) == 7 and all(r.problem and r.role is None for r in found)
    assert chat.canonical(table.limit(0)).count() == 0
    assert chat.read_back(chat.formatted(chat.canonical(table.limit(0)))).count() == 0


def test_fingerprints_tell_kinds_and_not_order_or_values():
    key = lambda x: chat.fingerprint(chat.paths(x))
    assert key({"a": "x", "b": [{"c": 1}, {"c": 2}]}) == key({"b": [{"c": 9}], "a": "", "z": None})
    assert len({key({"a": "1"}), key({"a": 1}), key({"a": True}), key({"a": ["1"]}), key({"a": {"a": "1"}}), key({"b": "1"})}) == 6
    layouts = chat.Layouts()
    assert all(layouts.select(x)[1] is None for x in ({"prompt": "a", "completion": "b", "output": "c"}, {"messages": [{"role": "user"}]}))


def test_escapes_are_reversible():
    r = random.Random(7)
    parts = [*chat.CONTROL, "\\", "<", ">", "[", "|", "x", "\n", "é", "\U0001f600", "<\\|im_end|>", "s>"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 6)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
    assert chat.escape("plain [text] <b>") == "plain [text] <b>"


def test_formatting_reads_back(spark):
    r = random.Random(8)
    parts = [*chat.CONTROL, "\\", "\n", "word ", "é", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "to ol\n<|im_end|>", "", None]), r.choice([None, "".join(r.choice(parts) for _ in range(9))])) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b" * 200_000), (3, None, "assistant", "first"), (41, 5, "assistant", "same"), (41, 5, "assistant", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {x.conv_id: tuple(x) for x in chat.read_back(chat.formatted(chat.canonical(chat.as_records(table)))).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, chat.marked(role or "", text or "")[0], role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(x[4] for x in own if x[3] == "assistant")
        turns = "".join(f"{x[3]}\n{x[4]}\n" for x in own)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[c] == (c, len(own), sha(turns), len(loss), sha(loss), sum(len(x[2]) for x in own)), c


def test_the_planted_conversation(spark):
    row = queries.op11_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert row.n_turns == 2 and row.loss_chars == len(SAID) and row.loss_sha256 == hashlib.sha256(SAID.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{SAID}\nassistant\n{SAID}\n".encode()).hexdigest()


WORDS = ["ab", "cd", "Ef", "é1", "x9", "9", "日本", "q q", "zz"]


def some_text(r: random.Random, n: int) -> str:
    return "".join(r.choice(WORDS) + r.choice([" ", "\n", "-", ", ", "\x00", "_"]) for _ in range(n))


def ranked(documents, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: term.findall((t or "").translate(low))
    own = [(d, terms(t)) for d, t in documents]
    n, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for d, w in own:
            score = 0
            for t in want:
                if tf := w.count(t):
                    df = sum(t in x for _, x in own)
                    m = 100 - 50 + (50 * len(w) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [4, 4096])
def test_search_equals_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(search, "WINDOW", window)
    r = random.Random(9)
    documents = [(r.choice([k, k, -k, 7, 7]), some_text(r, r.randint(1, 40))) for k in range(150)] + [(None, "zz zz"), (None, "zz zz"), (501, None), (502, ""), (503, "!!"), (504, "solo " * 500)]
    items = [(k, some_text(r, r.randint(1, 4))) for k in range(12)] + [(3, "solo"), (None, "zz"), (20, None), (21, ""), (22, "unheard")]
    docs = spark.createDataFrame([(*x, "x", 1) for x in documents], "doc_id long, text string, rank string, score int").repartition(3)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    for top in (5, 50):
        got = sorted((tuple(x) for x in search.search(docs, asked, top).collect()), key=repr)
        assert got == ranked(documents, items, top)
    monkeypatch.setattr(search, "BLOCK", 60)  # several blocks of items
    assert sorted((tuple(x) for x in search.search(docs, asked, 5).collect()), key=repr) == ranked(documents, items, 5)
    assert search.search(docs.limit(0), asked).count() == 0 and search.search(docs, asked.limit(0)).count() == 0


def test_search_counts_long_texts_in_pieces(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 400_000 + "ef"), (2, "x" * 3_000_000), (3, "ef")], "doc_id long, text string")
    got = [tuple(x) for x in search.search(docs, spark.createDataFrame([(1, "ef " + "x" * 3_000_000)], "item_id long, text string")).collect()]
    assert got == ranked([(1, "ab cd " * 400_000 + "ef"), (2, "x" * 3_000_000), (3, "ef")], [(1, "ef " + "x" * 3_000_000)], 50)


def audited(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [(term.findall((t or "").translate(low)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {x[1] for x in own}:
        docs = [x for x in own if x[1] == lang]
        kept = [t for t in {t for w, *_ in docs for t in w} if sum(t in w for w, *_ in docs) >= least]
        sources = {x[2] for x in docs}

        def shares(some):
            n = {t: sum(w.count(t) for w, *_ in some) for t in kept}
            return n, {t: 1 + (1_000_000_000 * (n[t] + 5)) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        all_ = {s: shares([x for x in docs if x[2] == s]) for s in sources}
        q = shares(docs)[1]
        for s in sources:
            n, p = all_[s]
            pairs = sorted((-sum(abs(p[t] - all_[o][1][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[t], t.encode()) for t in kept if n[t] and p[t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, x in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(x)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    r = random.Random(10)
    long_ = "l" * 300
    rows = [(some_text(r, r.randint(0, 20)) + r.choice(["", long_]), r.choice(["en", "en", "fr", None, ""]), r.choice(["a", "b", "c", "é", None, "Z"])) for _ in range(200)]
    rows += [(None, "fr", "d"), ("", "fr", "e"), ("abcd", "de", "a"), ("efgh", "de", "b"), ("efgh", "xx", "b"), ("!!", None, "only")]
    docs = spark.createDataFrame([(1, *x, "t", 0) for x in rows], "doc_id long, text string, lang string, source string, term string, rank int").repartition(3)
    want = audited(rows, 5, 4)
    assert sorted(tuple(x) for x in divergence.audit(docs, 5, 4).collect()) == want
    for name, value in (("BLOCK", 60), ("CELLS", 4), ("TILE", 2), ("HELD", 10)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(tuple(x) for x in divergence.audit(docs, 5, 4).collect()) == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kinds = 3 * 10**15, 10**16, 10**7
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(kinds)).alias("p")).first().p
    assert got == 1 + (10**9 * (n + 5)) // (total + 5 * kinds)
