"""Language identification with spans of mixed-language text.

Script ranges narrow the candidate languages of each word, hashed letter
trigrams give a score for each word and candidate, and a Viterbi pass with a
penalty for each switch labels the words of a document. Neighbouring words
with one label make a span.

The Viterbi pass is exact and runs in lockstep: documents are cut into chunks
of words, each chunk's best scores from every label to every label are found
side by side, these are chained along each document, and each chunk is then
traced back from the labels at its borders.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfusion.llm.common import bounded_sample, bucket, codes, filter_slices, map_slices

FEATURES = 1 << 16
TRAIN_ROWS = 6000
SWITCH_PENALTY = 14.0
CHUNK_WORDS = 256
SLICE = 2 << 20  # bytes of text labelled at once
SCORED = 1 << 16  # words scored at once
UND = "und"

#: First code points of runs of scripts, and the script of each run (0: not told apart).
SCRIPT_STARTS = (
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9),
    (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17),
    (0x0F00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x1780, 23), (0x1800, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 24), (0x3130, 21), (0x3190, 0), (0x3400, 25), (0xA000, 0), (0xAC00, 21),
    (0xD7B0, 0), (0xF900, 25), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 24), (0xFFA0, 21),
    (0xFFE0, 0), (0x20000, 25), (0x40000, 0),
)
N_SCRIPTS = 26


class Letters:
    """Letter and script of code points, and the words of joined texts."""

    def __init__(self) -> None:
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        self.starts = np.array([a for a, _ in SCRIPT_STARTS], dtype=np.int64)
        self.scripts = np.array([b for _, b in SCRIPT_STARTS], dtype=np.int8)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the texts, each followed by a line feed; first and last+1 place of each word; each word's text; each text's place."""
        lower = [lower_in_place(t or "") for t in texts]
        sizes = np.fromiter((len(t) + 1 for t in lower), dtype=np.int64, count=len(lower))
        c = codes("\n".join([*lower, ""]))
        edge = np.flatnonzero(np.diff(self.alpha[c].view(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        base = np.concatenate(([0], np.cumsum(sizes)))
        return c, begin, end, np.searchsorted(base, begin, side="right") - 1, base

    def trigrams(self, c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hashed trigram for each letter of the words (borders count as 0), and where each word's run starts."""
        origin = int(begin[0]) if len(begin) else 0
        c, begin, end = c[origin : int(end[-1])] if len(end) else c[:0], begin - origin, end - origin
        padded = np.zeros(len(c) + 2, dtype=np.uint32)
        size = end - begin
        run = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(begin - run[:-1], size) + np.arange(run[-1])
        padded[at + 1] = c[at]
        a, b, d = padded[at], padded[at + 1], padded[at + 2]
        h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + d * np.uint32(0xC2B2AE35)
        return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16), run[:-1]

    def script(self, c: np.ndarray) -> np.ndarray:
        return self.scripts[np.searchsorted(self.starts, c, side="right") - 1]


def lower_in_place(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)


def train(documents: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Letter-trigram and script statistics of each language.

    Learns from at most ``rows`` documents with a language and an id whose
    crc32 is not 0 modulo 5, chosen by the hash of the id. The driver gets at
    most FEATURES + N_SCRIPTS counts a language.
    """
    known = documents.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id"), 5) != 0)
    )

    def build():
        letters = Letters()

        def count(langs, texts):
            out = ([], [], [])
            for lang in dict.fromkeys(langs):
                c, begin, end, _, _ = letters.words([t for x, t in zip(langs, texts, strict=True) if x == lang])
                h, _ = letters.trigrams(c, begin, end)
                n = np.concatenate((np.bincount(h, minlength=FEATURES), np.bincount(letters.script(c[begin]), minlength=N_SCRIPTS)))
                at = np.flatnonzero(n)
                out[0].extend([lang] * len(at))
                out[1].extend(at.tolist())
                out[2].extend(n[at].tolist())
            return out

        return count

    seen = map_slices(bounded_sample(known, "doc_id", rows).select("lang", "text"), build, "lang string, f int, n long", 1, SLICE)
    counts = seen.groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((FEATURES + N_SCRIPTS, max(1, len(langs))))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        n[own["f"].to_numpy(), i] = own["n"]
    grams, scripts = n[:FEATURES], n[FEATURES:]
    weights = np.log(grams + 0.2) - np.log(grams.sum(0) + 0.2 * FEATURES)
    allowed = scripts >= 0.01 * np.maximum(1, scripts.sum(0))
    allowed[~allowed.any(1)] = True
    return {"langs": langs, "weights": weights.astype(np.float32), "allowed": allowed}


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float, chunk: int = CHUNK_WORDS) -> np.ndarray:
    """The best label of each row of ``scores`` [words, labels]; text ``i`` has ``count[i]`` rows from ``first[i]``."""
    n_labels = scores.shape[1]
    path = np.zeros(len(scores), dtype=np.int16)
    if n_labels < 2 or not len(scores):
        return path
    per = -(-count // chunk)
    owner = np.repeat(np.arange(len(count)), per)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = first[owner] + rank * chunk
    size = np.minimum(count[owner] - rank * chunk, chunk)
    order = np.argsort(-size, kind="stable")
    start, size, owner, rank = start[order], size[order], owner[order], rank[order]

    def step(v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = v.argmax(-1)
        jump = np.take_along_axis(v, best[..., None], -1) - penalty
        stay = v >= jump
        return np.where(stay, v, jump) + s, stay, best

    moved = np.full((len(start), n_labels, n_labels), -1e30)
    moved[:, np.arange(n_labels), np.arange(n_labels)] = 0
    for t in range(int(size[0])):
        k = int(np.searchsorted(-size, -t, side="left"))
        moved[:k] = step(moved[:k], scores[start[:k] + t][:, None, :])[0]
    at = np.zeros((len(count), int(per.max())), dtype=np.int64)
    at[owner, rank] = np.arange(len(start))
    entry = np.zeros((len(start), n_labels))
    value = np.zeros((len(count), n_labels))
    for r in range(int(per.max())):
        own = np.flatnonzero(per > r)
        here = at[own, r]
        entry[here] = value[own]
        value[own] = (value[own][:, :, None] + moved[here]).max(1)
    v, stays, bests = entry.copy(), [], []
    for t in range(int(size[0])):
        k = int(np.searchsorted(-size, -t, side="left"))
        v[:k], stay, best = step(v[:k], scores[start[:k] + t])
        stays.append(stay)
        bests.append(best.astype(np.int16))
    label = np.zeros(len(count), dtype=np.int64)
    label[:] = value.argmax(1)
    # Labels at chunk ends follow from the last chunk back; each chunk's inner words are traced in lockstep.
    for r in range(int(per.max()) - 1, -1, -1):
        own = np.flatnonzero(per > r)
        here = at[own, r]
        now = label[own]
        for t in range(int(size[here].max()) - 1, -1, -1):
            on = size[here] > t
            rows = here[on]
            path[start[rows] + t] = now[on]
            keep = stays[t][rows, now[on]]
            now[on] = np.where(keep, now[on], bests[t][rows])
        label[own] = now
    return path


class Labeller:
    """Labels texts with one model."""

    def __init__(self, model: dict, penalty: float = SWITCH_PENALTY) -> None:
        self.model, self.penalty, self.letters = model, penalty, Letters()

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[str]]:
        letters, langs, allowed = self.letters, self.model["langs"], self.model["allowed"]
        c, begin, end, owner, base = letters.words(texts)
        n = len(texts)
        pred, score, spans = [UND] * n, [0.0] * n, [""] * n
        if not len(begin) or not langs:
            return pred, score, spans
        s = np.empty((len(begin), len(langs)))
        for i in range(0, len(begin), SCORED):
            h, run = letters.trigrams(c, begin[i : i + SCORED], end[i : i + SCORED])
            s[i : i + SCORED] = np.add.reduceat(self.model["weights"][h], run, axis=0)
        s[~allowed[letters.script(c[begin])]] -= 1e4
        count = np.bincount(owner, minlength=n)
        path = viterbi(s, np.cumsum(count) - count, count, self.penalty)
        share = np.bincount(owner * len(langs) + path, weights=end - begin, minlength=n * len(langs)).reshape(n, -1)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(path) != 0))))
        last = np.concatenate((new[1:], [len(begin)])) - 1
        for i, j in zip(new.tolist(), last.tolist(), strict=True):
            d = owner[i]
            piece = f"{langs[path[i]]}:{begin[i] - base[d]}:{end[j] - base[d]}"
            spans[d] = f"{spans[d]},{piece}" if spans[d] else piece
        for d in np.flatnonzero(count):
            k = int(share[d].argmax())
            pred[d], score[d] = langs[k], float(share[d, k] / share[d].sum())
        return pred, score, spans


def identify(documents: DataFrame, model: dict, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every whole text.

    ``lang_pred`` is the language with most letters on the best path and
    ``score`` its share of the letters; a missing text, or one without a
    letter, gives ``und``, 0 and no spans. Ties go to the first language by
    name. ``spans`` lists ``lang:start:end`` in code points, end exclusive.
    Repeated rows each give a row; other columns are ignored. Without any
    labelled document all texts are ``und``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def build():
        label = Labeller(shared.value, penalty)
        return lambda ids, held, texts: (ids, held, *label(texts))

    held = bucket(F.col("doc_id"), 5) == 0
    kind = "doc_id long, held_out boolean, lang_pred string, score double, spans string"
    return map_slices(documents.select("doc_id", held.alias("held_out"), "text"), build, kind, 2, SLICE)


def told(documents: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``documents`` whose language is told: not ``und``, and with ``least`` of the letters.

    Missing texts and texts without a letter are not told. Repeated rows are
    judged alike; all columns stay as they are.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def build():
        label = Labeller(shared.value)

        def keep(texts):
            pred, score, _ = label(texts)
            return [p != UND and s >= least for p, s in zip(pred, score, strict=True)]

        return keep

    return filter_slices(documents, build, text, SLICE)
