"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon holds words and word beginnings that toxic documents use far more
often than others; both sit in one trie. A Levenshtein automaton is intersected
with the trie: its states are sets of (trie node, edits), built as words need
them. The hits of a document are weighed in windows of words, where quotation
marks and words of reporting tell quoting from abuse, and a logistic model on
these figures gives the score.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfusion.llm.common import bucket, map_slices

TRAIN_ROWS = 3000
LEXICON = 400
MIN_DOCS = 4
MIN_RATIO = 8.0
FUZZY_FROM = 5
WINDOW = 10
PREDICT = 0.7
MAX_STATES = 50_000
WORD = re.compile(r"[^\W_]+")
# Marks and words that report what others say; words that address someone.
QUOTES = "\"'“”„‟«»‹›`"
REPORTS = frozenset("said says called calls quote quoted wrote word term sagte nannte zitat wort dit mot appelé dijo llamó palabra cita".split())
ADDRESS = frozenset("you your u du dich dein ihr sie tu toi vous ton tú vos usted eres".split())


_MARK = re.compile(f"[{QUOTES}]")


def quotations(text: str) -> list[tuple[int, bool, bool]]:
    """Place of each quotation mark, and if it can open and can close; apostrophes inside words are none."""
    out = []
    for m in _MARK.finditer(text):
        a, ch, b = text[m.start() - 1 : m.start()], m[0], text[m.end() : m.end() + 1]
        opens = not a.isalnum() and (bool(b.strip()) or ch in "«‹")
        closes = not b.isalnum() and (bool(a.strip()) or ch in "»›")
        if opens or closes:
            out.append((m.start(), opens, closes))
    return out


def inside(marks: list[tuple[int, bool, bool]], places: list[tuple[int, int]], i: int) -> bool:
    """If word ``i`` stands in a quotation: the last mark before it opens, the next one closes, both within the window."""
    k = bisect(marks, (places[i][0],))
    if not 0 < k < len(marks):
        return False
    first, last = places[max(0, i - WINDOW)][0], places[min(len(places) - 1, i + WINDOW)][1]
    return marks[k - 1][1] and marks[k][2] and marks[k - 1][0] >= first - 2 and marks[k][0] <= last + 2


class Automaton:
    """Trie of words and beginnings (ending in ``*``), with the words' neighbours at one edit."""

    def __init__(self, entries: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, float] = {}
        self.beginning: dict[int, float] = {}
        self.depth = [0]
        for entry, weight in entries.items():
            node = 0
            for ch in entry.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][ch]
            (self.beginning if entry.endswith("*") else self.word)[node] = weight
        # Edits are worth trying only below nodes that lead to a long enough word.
        self.fuzzy = [False] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            long = node in self.word and self.depth[node] >= FUZZY_FROM
            self.fuzzy[node] = long or any(self.fuzzy[c] for c in self.children[node].values())
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.start = self.state(self.closed({(0, 0)}), None)

    def closed(self, nodes: set) -> frozenset:
        """With the nodes that a letter left out of the word leads to."""
        return frozenset(nodes | {(c, 1) for n, e in nodes if e == 0 for c in self.children[n].values() if self.fuzzy[c]})

    def state(self, nodes: frozenset, held: float | None) -> int:
        """``held``: weight of a beginning that the word already has."""
        if not nodes and held is None:
            return -1
        key = (nodes, held)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            exact = [self.word[n] for n, e in nodes if e == 0 and n in self.word] + ([] if held is None else [held])
            near = [self.word[n] for n, e in nodes if e == 1 and n in self.word and self.depth[n] >= FUZZY_FROM]
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append((max(exact), 0) if exact else (max(near), 1) if near else None)
        return self.ids[key]

    def step(self, state: int, ch: str) -> int:
        nodes, held = self.sets[state]
        to = set()
        for n, e in nodes:
            if (c := self.children[n].get(ch)) is not None:
                to.add((c, e))
            if e == 0 and self.fuzzy[n]:
                to.add((n, 1))
                to.update((c, 1) for c in self.children[n].values() if self.fuzzy[c])
        kept = [held] if held is not None else []
        kept += [self.beginning[n] for n, e in to if e == 0 and n in self.beginning]
        got = self.moves[state][ch] = self.state(self.closed(to), max(kept, default=None))
        return got

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and edits of the best entry for ``word``."""
        state, moves = self.start, self.moves
        for ch in word:
            to = moves[state].get(ch)
            state = self.step(state, ch) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]


def entries(text: str) -> set[str]:
    found = set(WORD.findall(text.lower()))
    return found | {f"{w[:k]}*" for w in found for k in (5, 6, 7, 8) if len(w) > k}


def figures(text: str | None, automaton: Automaton) -> list[float]:
    """Sum, largest, share and densest window of the hits' weights, misspelled ones, quoted ones, addressed ones, length."""
    if not text:
        return [0.0] * 8
    if len(automaton.sets) > MAX_STATES:
        automaton.reset()
    low = text.lower()
    words = WORD.findall(low)
    hits = {w: m for w in set(words) if (m := automaton.match(w))}
    if not hits:
        return [0.0] * 7 + [np.log1p(len(words))]
    at = [(i, *hits[w]) for i, w in enumerate(words) if w in hits]
    places = [m.span() for m in WORD.finditer(low)]
    sums, marks = {i: w for i, w, _ in at}, quotations(low)
    exact = fuzzy = quoted = addressed = densest = 0.0
    for i, w, edits in at:
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        if inside(marks, places, i) or not REPORTS.isdisjoint(words[max(0, i - 3) : i]):
            quoted += w
        elif edits:
            fuzzy += w
        else:
            exact += w
        if not ADDRESS.isdisjoint(near):
            addressed += w
        densest = max(densest, sum(sums.get(j, 0.0) for j in range(i, i + WINDOW + 1)))
    return [
        np.log1p(exact), max(w for _, w, _ in at), (exact + fuzzy) / len(words) * 10, densest / 10, np.log1p(fuzzy), np.log1p(quoted), np.log1p(addressed), np.log1p(len(words)),
    ]


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Lexicon and logistic model from labelled documents.

    Learns from documents whose id's crc32 is not 1 modulo 3: at most ``rows``
    with label 1 and twice as many with label 0, by the hash of the id. The
    lexicon comes from two of three of them, the logistic model from all.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    ids = known.where("toxic = 1").orderBy(*order).limit(rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(2 * rows))
    sample = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")

    def build():
        def count(ids, toxic, texts):
            n = (Counter(), Counter())
            for i, y, text in zip(ids, toxic, texts, strict=True):
                n[y].update(entries(text))
            keys = sorted(n[0].keys() | n[1].keys())
            return keys, [n[1][k] for k in keys], [n[0][k] for k in keys]

        return count

    first = sample.where(F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(3)) > 0)
    total = first.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in total}
    a, b = size.get(1, 0), size.get(0, 0)
    seen = map_slices(first, build, "entry string, pos long, neg long", 2).groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (a + 1)) - F.log((F.col("neg") + 0.5) / (b + 1))
    top = seen.where(F.col("pos") >= MIN_DOCS).withColumn("weight", weight).where(F.col("weight") >= float(np.log(MIN_RATIO)))
    chosen = top.orderBy(F.desc(F.col("weight") * F.sqrt("pos")), "entry").limit(LEXICON).collect()
    lexicon = {r["entry"]: float(r["weight"]) for r in chosen}
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def measure():
        automaton = Automaton(shared.value)
        return lambda ids, toxic, texts: (toxic, [figures(t, automaton) for t in texts])

    rows_ = map_slices(sample, measure, "toxic int, x array<double>", 2).toPandas()
    y = rows_["toxic"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return {"lexicon": lexicon, "coef": np.zeros(8), "bias": 3.0 if len(y) and y[0] else -3.0, "mean": np.zeros(8), "scale": np.ones(8)}
    x = np.array([list(v) for v in rows_["x"]])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack(((x - mean) / scale, np.ones(len(y))))
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        keep = np.append(np.full(z.shape[1] - 1, 1.0), 1e-3)
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep)
        w -= np.linalg.solve(hess, z.T @ (p - y) + keep * w)
    return {"lexicon": lexicon, "coef": w[:-1], "bias": float(w[-1]), "mean": mean, "scale": scale}


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    A missing text counts as empty; an empty text has no hits and the score
    that follows from that. Repeated rows each give a row; other columns are
    ignored. Without labels of both kinds the score is the same for all.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def build():
        m = shared.value
        automaton = Automaton(m["lexicon"])

        def run(ids, held, texts):
            x = (np.array([figures(t, automaton) for t in texts]) - m["mean"]) / m["scale"]
            p = 1 / (1 + np.exp(-np.clip(x @ m["coef"] + m["bias"], -30, 30)))
            return ids, held, p, (p >= PREDICT).astype(np.int32)

        return run

    held = bucket(F.col("doc_id"), 3) == 1
    return map_slices(documents.select("doc_id", held.alias("held_out"), "text"), build, "doc_id long, held_out boolean, score double, predicted int", 2)
