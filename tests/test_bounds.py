"""What is left out of scoring, what is kept of places, and how long rounds take."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pandas as pd
from spanfusion.functions import kernels
from spanfusion.functions.text import packed_places, unpacked_places
from spanfusion.operators import align, resolve
from spanfusion.plans import providers


def test_no_more_characters_are_equal_than_the_bound():
    r = random.Random(4)
    for k in range(400):
        letters = "ab"[: 1 + k % 2] if k < 40 else "abcdefgh "
        a = "".join(r.choice(letters) for _ in range(r.choice((1, 5, 30, 200, 700))))
        b = "".join(r.choice(letters) for _ in range(r.randint(1, 90)))
        if k % 3 == 0 and len(a) > 60:  # parts of the text with gaps between
            at = r.randrange(len(a) - 50)
            b = "".join(c for c in a[at : at + 50] if r.random() < 0.8) or b
        x, y = kernels.encoded(a), kernels.encoded(b)
        same = kernels.local_global(x, y)[2]
        assert kernels.Stretches([x, kernels.encoded("zz")]).most(y) >= same
        found, ends = kernels.scores_at([x, x[: len(x) // 2 + 1]], y)
        if b not in a:
            assert kernels.ending(x, y, int(found[0]), int(ends[0])) == kernels.local_global(x, y)


def test_texts_that_stand_nowhere_are_told_from_those_with_gaps():
    keys = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(40)]
    norm = " some words between ".join(keys)
    gapped = keys[7][:30] + keys[7][33:]
    other = hashlib.sha256(b"other").hexdigest()
    assert align.hopeless([other, keys[3], gapped], [norm[:500], norm[500:]]) == {other}


def test_many_anchors_that_stand_nowhere_cost_little():
    keys = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(600)]
    norm = " and some words of a line ".join(keys)
    frags = pd.DataFrame([(1, 0, 0, 0, 9, norm, packed_places(np.arange(len(norm) + 1)))], columns=["doc_id", "block", "frag", "lo", "hi", "norm", "places"])
    texts = [hashlib.sha256(k.encode()).hexdigest() for k in keys[:200]] + [keys[5][:32] + keys[5][33:]]
    anchors = pd.DataFrame([(k, k, 0, t) for k, t in enumerate(texts)], columns=["rank_no", "anchor_id", "page", "anchor_norm"])
    began = time.process_time()
    at = norm.index(keys[5])
    assert align.finish(frags, anchors, 0.5, 0.9) == [(200, at, at + 64)]
    assert time.process_time() - began < 8


def test_places_take_less_room_than_their_text():
    for places in ([3], [0, 1, 2, 3], [7, 8, 900, 901], np.arange(50_000) * 2 + 5):
        assert unpacked_places(packed_places(np.array(places))).tolist() == list(places)
    assert len(packed_places(np.arange(100_000))) < 5_000


def test_quotes_are_aligned_near_their_words_only():
    r = random.Random(9)
    text = " ".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(4000))
    key = hashlib.sha256(b"2000").hexdigest()
    began = time.process_time()
    for _ in range(20):
        at = r.randrange(10, 50)
        share, spans = resolve.aligned(text, np.arange(len(text) + 1), key[:at] + key[at + 1 :] + " " + "q" * 70)
        assert spans[0][0] == text.index(key) and spans[-1][1] >= text.index(key) + 64 and 0.4 < share < 0.6
    assert time.process_time() - began < 6


def test_answers_are_handed_on_a_few_rows_at_a_time(spark, monkeypatch):
    held = []
    frame = pd.DataFrame

    def seen(rows, columns):
        held.append(len(rows))
        return frame(rows, columns=columns)

    class Rows:
        columns = None

        def mapInPandas(self, run, kind):
            return run

    monkeypatch.setattr(providers.pd, "DataFrame", seen)
    run = providers.called(Rows(), lambda row: row["chunk_idx"], "int")
    given = frame({"doc_id": [1] * 1000, "chunk_idx": range(1000)})
    out = pd.concat(list(run(iter([given]))))
    assert out["answer"].tolist() == list(range(1000)) and max(held) <= 2 * providers.PIECE
