"""Personal data: fixed base patterns, and candidates chosen by boosted trees.

Generators with high recall propose spans that may overlap: every run of
digits and separators, obfuscated mail addresses, account numbers. Boosted
trees score a candidate by its format and by the words around it; those above
their kind's threshold that touch no base span are added, best first.

The corpus says what personal data looks like only through its base spans. So
positives are base spans written another way (other separators, no leading
plus, spaced or spelled parts) in their real surroundings, and formats that no
base pattern has, in the same surroundings; negatives are the corpus's other
candidates, and numbers of no meaning in the same surroundings as well. Chances
are calibrated on a sixth of the rows that the trees do not see, and the
threshold of each kind is set on another sixth.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanfusion.llm import boosting
from spanfusion.llm.common import bounded_sample, map_slices, returned, slices, stored

# Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "id")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # the leftmost match begins where a run of digits does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANY_DIGIT = re.compile("[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9])+")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
HOST = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)+")
CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "handy", "cell", "sms"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "amex"),
    "id": ("ssn", "social security", "passport", "tax id", "ausweis"),
}
CONTEXT = 24
TRAIN_ROWS = 4000  # documents that the trees learn from
KIND_ROWS = 3000  # different vectors of a kind and label that the trees learn from
CUE_WORDS = 400  # words around spans whose weights are learned
PRECISION = 0.95  # of the rows held back, at each kind's threshold
LEAST = 0.5  # no threshold is lower
WORD = re.compile(r"[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in that order."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if ANY_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(ch.isdigit() for ch in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
        out.sort()
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) that a generator proposes; spans may overlap."""
    out = []
    if "@" in text or "(at)" in text or "[at]" in text:
        last = 0
        for m in AT.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in LOCAL_CHARS:
                begin -= 1
            if begin < m.start() and (host := HOST.match(text, m.end())):
                last = host.end()
                out.append((begin, 0, last))
    if ANY_DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n = sum(ch.isdigit() for ch in m[0])
            if n >= 7:
                out.append((m.start(), 2 if n >= 13 else 5 if n == 9 and re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", m[0]) else 3, m.end()))
        out += [(m.start(), 4, m.end()) for m in ACCOUNT.finditer(text)]
    return sorted(set(out))


class Taken:
    """Spans that are taken: some that may overlap, and others that are added and meet none."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.ends = list(accumulate((e for _, _, e in spans), max))
        self.added: list[tuple[int, int]] = []

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        if before and self.ends[before - 1] > start:
            return True
        k = bisect_left(self.added, (start, end))
        return (k > 0 and self.added[k - 1][1] > start) or (k < len(self.added) and self.added[k][0] < end)

    def add(self, start: int, end: int) -> None:
        insort(self.added, (start, end))


def around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()


def features(text: str, start: int, kind: int, end: int, cues: dict[str, float]) -> list[float]:
    """Format and surroundings of a candidate; ``cues`` weighs words near it."""
    span = text[start:end]
    digits = "".join(ch for ch in span if "0" <= ch <= "9")
    groups = re.findall("[0-9]+", span)
    before, after = around(text, start, end)
    account = 0
    if kind == 4:
        plain = span.replace(" ", "")
        account = int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97 == 1
    weights = [cues[w] for w in WORD.findall(before) + WORD.findall(after) if w in cues]
    return [
        float(kind), len(digits), len(span), span.count("-"), span.count("."), span.count(" "), span.count("("), span.count("/"),
        float(span.startswith("+")), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(account), len(set(digits)),
        float(before[-1:].isalnum() or after[:1].isalnum()), float(any(c in before for c in CUES["phone"])),
        float(any(c in before for c in CUES["card"])), float(any(c in before for c in CUES["id"])), float("@" in span),
        float(len(groups) == 3 and [*map(len, groups)] == [3, 3, 4]), float(len(groups) == 3 and len(groups[0]) in (2, 4) and len(groups[1]) <= 2),
        max(weights, default=0.0), sum(weights),
    ]


class Formats:
    """Spans that are personal data and spans that are not, written out from a seed; none is taken from a person."""

    def __init__(self, seed: int, left_out: frozenset[str] = frozenset(), only: frozenset[str] = frozenset()) -> None:
        """``left_out`` names ways of writing that ``variant`` does not use, ``only`` those that it uses alone; so whole ways can be kept from the trees."""
        self.r, self.left_out, self.only = random.Random(seed), left_out, only

    def way(self, ways: tuple[str, ...]) -> str | None:
        ways = tuple(w for w in ways if w not in self.left_out and (not self.only or w in self.only))
        return self.r.choice(ways) if ways else None

    def num(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def card(self) -> str:
        head = self.r.choice("3456") + self.num(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def account(self) -> str:
        land, body = self.r.choice(("DE", "FR", "ES", "GB")), self.num(18)
        check = 98 - int("".join(str(int(ch, 36)) for ch in body + land + "00")) % 97
        return f"{land}{check:02d}{body}"

    def wrong(self, text: str) -> str:
        return text[:-1] + str((int(text[-1]) + self.r.randint(1, 9)) % 10)

    def split(self, text: str, by: str) -> str:
        return by.join(text[i : i + 4] for i in range(0, len(text), 4))

    def personal(self) -> str:
        num = self.num
        return self.r.choice((
            lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"1-{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}",
            lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"tel {num(3)} {num(3)} {num(4)}", lambda: f"call 0{num(3)}/{num(7)}",
            lambda: self.split(self.card(), "."), lambda: self.split(self.card(), "/"), self.account, lambda: self.split(self.account(), " "),
            lambda: f"ssn {num(3)}-{num(2)}-{num(4)}", lambda: f"user{num(2)} (at) mail{num(1)}.example.com", lambda: f"ab{num(2)} [at] example [dot] org",
        ))()

    def other(self) -> str:
        num, day = self.num, self.r.randint
        return self.r.choice((
            lambda: f"20{num(2)}-{day(10, 12)}-{day(10, 28)}", lambda: f"{day(10, 28)}.{day(10, 12)}.20{num(2)}", lambda: num(day(7, 12)),
            lambda: self.wrong(self.card()), lambda: self.split(self.wrong(self.card()), " "), lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(1)}.{num(3)}.{num(3)}.{num(3)}",
            lambda: f"20{num(2)}-20{num(2)}", lambda: f"{day(10, 23)}.{num(2)}-{day(10, 23)}.{num(2)}", lambda: self.wrong(self.account()), lambda: num(day(20, 30)),
            lambda: f"{num(4)} {num(3)}", lambda: f"{num(1)}.{num(2)}.{num(4)}",
        ))()

    def variant(self, span: str, kind: int) -> str | None:
        """A base span written another way, such that the base patterns may miss it."""
        if kind == 0:
            name, host = span.split("@", 1)
            by = self.way((" (at) ", " [at] ", "(at)", " @ "))
            return by and name + by + host.replace(".", self.r.choice((".", " (dot) ", " [dot] ")))
        digits = "".join(ch for ch in span if ch.isdigit())
        if kind == 2:
            by = self.way((".", "/", "  ", "- "))
            return by and self.split(digits, by)
        if kind == 3:
            cut = len(digits) - 7
            form = self.way(("{} {} {}", "{}-{}-{}", "{}.{}.{}", "({}) {}-{}", "{}/{}{}"))
            return form and form.format(digits[:cut], digits[cut : cut + 3], digits[cut + 3 :])
        return None


def examples(text: str, made: Formats) -> Iterator[tuple[str, int, int, int, int]]:
    """(text, start, kind, end, label) to learn from: a document's own candidates, and others put in place of its base spans."""
    base = base_spans(text)
    taken = Taken(base)
    for s, k, e in candidates(text):
        if not taken.meets(s, e):
            yield text, s, k, e, 0
    for a, kind, b in base:
        before, after = text[max(0, a - 2 * CONTEXT) : a], text[b : b + 2 * CONTEXT]
        for span, label in ((made.variant(text[a:b], kind), 1), (made.personal(), 1), (made.other(), 0), (made.other(), 0)):
            if span is None:
                continue
            whole, end = f"{before}{span}{after}", len(before) + len(span)
            for s, k, e in candidates(whole):
                shared = min(e, end) - max(s, len(before))
                if shared > 0 and 5 * shared >= 4 * max(e - s, len(span) - 5):
                    yield whole, s, k, e, label


def train(documents: DataFrame, rows: int = TRAIN_ROWS, per_kind: int = KIND_ROWS, words: int = CUE_WORDS, left_out: frozenset[str] = frozenset()) -> dict:
    """Trees, weights of ``words`` words near spans, and a threshold for each kind.

    Learns from at most ``rows`` documents with digits or ``@``, chosen by the
    hash of the id, and from at most ``per_kind`` different vectors of each
    kind and label, chosen by their hash and weighed by their counts. The
    lowest threshold is taken at which PRECISION of what is chosen among rows
    that neither the trees nor their chances come from is personal data.
    ``left_out`` keeps ways of writing from training, to measure on them.
    """
    sample = stored(bounded_sample(documents.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")), "doc_id", rows).select("text"))
    spark = documents.sparkSession

    def counting():
        def count(texts):
            n: dict[str, list[int]] = {}
            for text in texts:
                for whole, s, _, e, y in examples(text, Formats(zlib.crc32(text.encode("utf-8", "surrogatepass")), left_out)):
                    if whole is text or y:
                        for w in {*WORD.findall(" ".join(around(whole, s, e)))}:
                            n.setdefault(w, [0, 0])[y] += 1
            return list(n), [x[1] for x in n.values()], [x[0] for x in n.values()]

        return count

    seen = map_slices(sample, counting, "word string, pos long, neg long", 0).groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cues = {r["word"]: math.log((r["pos"] + 1) / (r["neg"] + 1)) for r in seen.orderBy(F.desc(F.col("pos") + F.col("neg")), "word").limit(words).collect()}
    shared = spark.sparkContext.broadcast(cues)

    def labelling():
        def label(texts):
            out = ([], [])
            for text in texts:
                for whole, s, k, e, y in examples(text, Formats(zlib.crc32(text.encode("utf-8", "surrogatepass")), left_out)):
                    out[0].append(features(whole, s, k, e, shared.value))
                    out[1].append(y)
            return out

        return label

    each = map_slices(sample, labelling, "x array<double>, y int", 0).groupBy("x", "y").count()
    order = Window.partitionBy(F.col("x")[0], "y").orderBy(F.xxhash64("x"), "x")
    found = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_kind).orderBy("y", F.xxhash64("x"), "x").toPandas()
    x, y, weight = [list(v) for v in found["x"]], found["y"].tolist(), found["count"].tolist()
    made = Formats(11)
    for _ in range(600):  # formats in plain surroundings, so that a corpus without personal data gives a model too
        for span, label in ((made.personal(), 1), (made.other(), 0)):
            text = f"and with {span} the end"
            for s, k, e in candidates(text):
                x.append(features(text, s, k, e, cues))
                y.append(label)
                weight.append(1)
    x, y, weight = np.array(x, dtype=float), np.array(y), np.array(weight, dtype=float)
    model = boosting.fit(x, y, np.minimum(weight, 20.0))
    held = model.pop("held")
    chance = boosting.probability(model, x[held]) if len(held) else np.zeros(0)
    limits = [limit(chance[x[held, 0] == k], y[held][x[held, 0] == k], weight[held][x[held, 0] == k]) for k in range(len(KINDS))]
    return {**model, "cues": cues, "limits": limits}


def limit(chance: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The lowest chance from which on PRECISION of the rows have label 1; 1 (nothing is chosen) without any."""
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum((weight * y)[order]) / np.maximum(np.cumsum(weight[order]), 1e-9)
    good = np.flatnonzero((right >= PRECISION) & (np.append(np.diff(chance[order]), -1) < 0))
    return max(LEAST, float(chance[order][good[-1]])) if len(good) else 1.0


def all_spans(text: str, model: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with the accepted candidates."""
    base = base_spans(text)
    taken = Taken(base)
    free = [c for c in candidates(text) if not taken.meets(c[0], c[2])]
    if not free:
        return base, base
    chance = boosting.probability(model, np.array([features(text, *c, model["cues"]) for c in free]))
    more = list(base)
    for p, c in sorted(zip(-chance, free, strict=True)):
        if -p >= model["limits"][c[1]] and not taken.meets(c[0], c[2]):
            taken.add(c[0], c[2])
            more.append(c)
    return base, sorted(more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(documents: DataFrame, model: dict) -> DataFrame:
    """Counts and digest of the base spans and all spans of every whole text.

    A missing or empty text has no spans. Spans of one start are in the order
    of KINDS. Repeated rows each give a row; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def build():
        def scan(ids, texts):
            counts, digests, spans = ([], [], [], []), [], []
            for text in texts:
                base, every = all_spans(text or "", shared.value)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            return ids, *counts, digests, spans

        return scan

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_slices(documents.select("doc_id", "text"), build, kind, 1)


def redact(documents: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in brackets; a missing text stays missing."""
    import pyarrow as pa
    from pyspark.sql import types as T

    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text)

    def run(batches):
        for batch in returned(batches):
            for part in slices(batch, place):
                done = []
                for t in part.column(place).to_pylist():
                    out, last = [], 0
                    for s, k, e in all_spans(t, shared.value)[1] if t else ():
                        if e > last:
                            out += [t[last : max(s, last)], f"[{KINDS[k].upper()}]"]
                            last = e
                    done.append("".join([*out, t[last:]]) if out else t)
                yield pa.RecordBatch.from_arrays([pa.array(done, part.schema.field(i).type) if i == place else c for i, c in enumerate(part.columns)], schema=part.schema)

    return documents.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in documents.schema]))
