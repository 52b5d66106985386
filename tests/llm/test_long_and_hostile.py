"""Words made to meet, and texts made to be slow or to fail."""

from __future__ import annotations

import base64
import random
import re
import time

import numpy as np

from spanfusion.llm import boosting, decontaminate, near_duplicates, pii, secrets, substrings
from spanfusion.llm.common import BASES, PRIMES, mix, word_hash


def thue_morse(n: int) -> tuple[str, str]:
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_word_hash_is_the_polynomial_it_says():
    r = random.Random(3)
    words = [[r.randrange(1 << 21) for _ in range(n)] for n in (1, 2, 5000, 70_000, 1, 33)]
    for which in (0, 1):
        wanted = []
        for w in words:
            h = 0
            for k in (2 * which, 2 * which + 1):
                h = h << 31 | sum((v + 1) * pow(BASES[k], j, PRIMES[k]) for j, v in enumerate(w)) % PRIMES[k]
            wanted.append(h)
        got = word_hash(np.array(sum(words, []), np.uint32), np.array([len(w) for w in words]), which)
        assert got.tolist() == mix(np.array(wanted, np.uint64)).tolist()


def test_made_up_words_do_not_meet(spark):
    twelve = " ".join(f"w{i}" for i in range(12))
    one, two = thue_morse(1024)
    a, b = "A" * 65_536, "B" * 65_536
    texts = [f"{one} {twelve}", f"{two} {twelve}", f"{a}{b} {twelve}", f"{b}{a} {twelve}", one, two]
    table = docs(spark, texts)
    assert {r.doc_id: r.n_removed for r in substrings.remove(table).collect()} == dict.fromkeys(range(1, 7), 0)
    assert {r.doc_id: r.component_id for r in near_duplicates.cluster(table.where("doc_id > 4")).collect()} == {5: 5, 6: 6}
    # Ten of twelve shingles are shared: 83 in a hundred.
    assert {r.doc_id: r.component_id for r in near_duplicates.cluster(table.where("doc_id < 5")).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    w, _ = decontaminate.word_hashes([one, two, a + b, b + a])
    assert len(set(w.tolist())) == 4


def test_nested_tokens_are_rows(spark):
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 100_000).decode().rstrip("=")
    head = base64.urlsafe_b64encode(b'{"alg":1}').decode().rstrip("=")
    found = {r.doc_id: r.spans for r in secrets.find(docs(spark, [f"{deep}.{deep}.abc", f"x {head}.{head}.abc", f"{head}.{head}"])).collect()}
    assert found == {1: "", 2: f"jwt:2:{2 + 2 * len(head) + 5}", 3: ""}


def test_long_runs_take_linear_time(monkeypatch):
    n = 1_000_000
    automaton = secrets.keywords()
    monkeypatch.setattr(boosting, "probability", lambda model, x: np.full(len(x), 0.9))
    model = {"cues": {}, "limits": [0.5] * len(pii.KINDS)}
    many = " ".join(f"u{i}@x.org +49 30 {1000000 + i} 1-222-{i:07d}" for i in range(10_000))
    for work in (
        lambda: secrets.spans("eyJ" * (n // 3), automaton), lambda: secrets.spans("eyJ" * (n // 3) + ".eyJ9.x", automaton), lambda: secrets.spans("password" * (n // 8), automaton),
        lambda: pii.all_spans("7" * n, model), lambda: pii.all_spans("a" * n + " x@y.org", model), lambda: pii.all_spans("a@" * (n // 2), model), lambda: pii.all_spans(many, model),
    ):
        began = time.process_time()
        work()
        assert time.process_time() - began < 10


def test_forms_equal_the_plain_patterns():
    mail = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
    r = random.Random(1)
    for _ in range(5_000):
        text = "@ " + "".join(r.choice(["a", ".", "_", "@", " ", "(at)", "[dot]", "b-", "1", "(dot)"]) for _ in range(r.randint(1, 14)))
        assert [(s, e) for s, k, e in pii.candidates(text) if k == 0] == [m.span() for m in mail.finditer(text)]
        digits = "".join(r.choice("12.. a") for _ in range(r.randint(1, 20)))
        assert [m.span() for m in pii.IP.finditer(digits)] == [m.span() for m in ip.finditer(digits)]


def test_taken_equals_all_comparisons():
    r = random.Random(5)
    for _ in range(300):
        base = [(s, 0, s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(r.randint(0, 6)))]
        taken, added = pii.Taken(base), []
        for _ in range(12):
            s = r.randrange(60)
            e = s + r.randint(1, 6)
            meets = any(a < e and s < b for a, _, b in base) or any(a < e and s < b for a, b in added)
            assert taken.meets(s, e) == meets
            if not meets:
                taken.add(s, e)
                added.append((s, e))
