"""Chat formatting: records of many layouts to canonical turns, to marked text with a loss mask, and back.

A record is JSON text. The nested paths of its fields, with their kinds, are
hashed; the hash selects a mapping, which says where the turns are and what
their roles are called. Hashes are worked out from the mappings, for each choice
of their optional fields, so records of one layout that leave some out still
meet it, and a record costs one look-up. Fields that no mapping knows are left
out before hashing. Records that no mapping fits, or that are no JSON objects,
are kept as rows without turns and with a reason.

Turns are marked as ``<|im_start|>role\\ntext<|im_end|>\\n``. Where a text holds a
control string, or one that was escaped before, a backslash is put behind its
first character; taking one away again gives the text as it was. Roles are
percent-encoded. Missing roles and texts count as empty, a missing conversation
id is a conversation, turns of one number are in the order of their formatted
text, missing numbers first.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanfusion.llm.common import map_slices, returned, slices

# Control strings of common templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = CONTROL[0], CONTROL[1] + "\n"
_CONTROL = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are.

    ``turns`` are (role, path) pairs of single turns, or with ``each`` the path of
    a list whose entries have their role at ``role`` and text at ``text``. A
    path's names are parted by dots. Empty single turns that are optional are
    no turns.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    joined: tuple[str, str] | None = None


# The layouts and their names for roles.
_SHARED = {"human": "user", "gpt": "assistant", "bing": "assistant", "chatgpt": "assistant"}
MAPPINGS = (
    Mapping("turn", ("role:s", "text:s"), ("turn:n",), each=".", role="role", text="text"),
    Mapping("messages", ("messages[].role:s", "messages[].content:s"), ("system:s", "messages[].name:s"), turns=(("system", "system"),), each="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from:s", "conversations[].value:s"), ("system:s",), turns=(("system", "system"),), each="conversations", role="from", text="value", roles=_SHARED),
    Mapping("prompt", ("prompt:s",), ("system:s",), turns=(("system", "system"), ("user", "prompt"))),
    Mapping("completion", ("completion:s",), turns=(("assistant", "completion"),)),
    Mapping("prompt_completion", ("prompt:s", "completion:s"), ("system:s",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt:s", "response:s"), ("system:s",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("question:s", "answer:s"), ("system_prompt:s",), turns=(("system", "system_prompt"), ("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction:s", "output:s"), ("input:s", "system:s"), turns=(("system", "system"), ("user", "instruction"), ("assistant", "output")), joined=("instruction", "input")),
    Mapping("preference", ("prompt:s", "chosen[].role:s", "chosen[].content:s"), ("rejected[].role:s", "rejected[].content:s"), each="chosen", role="role", text="content"),
)


def paths(value: object, at: str = "") -> Iterator[str]:
    """The nested paths of a value's fields: names parted by dots, ``[]`` for lists, the kind behind a colon; missing values have none."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from paths(inner, f"{at}.{name}" if at else name)
    elif isinstance(value, list):
        for inner in value:
            yield from paths(inner, f"{at}[]")
    elif value is not None:
        yield at + (":s" if isinstance(value, str) else ":b" if isinstance(value, bool) else ":n")


def fingerprint(found: Iterator[str] | set[str]) -> str:
    """The hash of a set of paths."""
    return hashlib.blake2b("\n".join(sorted(set(found))).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Layouts:
    """Mappings by the hash of the paths that they take."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS) -> None:
        self.by_hash: dict[str, Mapping] = {}
        self.known = {p for m in mappings for p in (*m.needs, *m.may)}
        for m in mappings:
            for k in range(len(m.may) + 1):
                for some in itertools.combinations(m.may, k):
                    self.by_hash.setdefault(fingerprint({*m.needs, *some}), m)

    def select(self, record: dict) -> tuple[str, Mapping | None]:
        key = fingerprint(p for p in paths(record) if p in self.known)
        return key, self.by_hash.get(key)


def _at(record: dict, path: str) -> object:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """The canonical turns (role, text) of a record."""
    out = []
    for role, path in mapping.turns:
        text = _at(record, path)
        if mapping.joined and mapping.joined[0] == path and _at(record, mapping.joined[1]):
            text = f"{text}\n\n{_at(record, mapping.joined[1])}"
        if text is not None and (text or f"{path}:s" in mapping.needs):
            out.append((role, text))
    if mapping.each:
        rows = [record] if mapping.each == "." else _at(record, mapping.each)
        for x in rows if isinstance(rows, list) else []:
            role, text = (x.get(mapping.role) or "", x.get(mapping.text) or "") if isinstance(x, dict) else ("", "")
            out.append((mapping.roles.get(role, role), text))
    return out


TURNS = "conv_id long, turn long, seq int, role string, text string, layout string, problem string"


def canonical(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The canonical turns of (conv_id, turn, record): ``seq`` counts those of one record; ``turn`` tells where it stands in its conversation.

    A record without a mapping is one row with a ``problem`` and without role and text.
    """

    def build() -> Callable:
        layouts = Layouts(mappings)

        def work(ids: list, numbers: list, texts: list) -> list:
            out = []
            for conv, turn, text in zip(ids, numbers, texts, strict=True):
                try:
                    record = json.loads(text or "null")
                except (ValueError, RecursionError):
                    record = None
                if not isinstance(record, dict):
                    out.append((conv, turn, 0, None, None, None, "no JSON object"))
                    continue
                try:
                    key, mapping = layouts.select(record)
                except RecursionError:
                    key, mapping = "too deep", None
                if mapping is None:
                    out.append((conv, turn, 0, None, None, None, f"no layout for {key}"))
                    continue
                out += [(conv, turn, k, role, body, mapping.name, None) for k, (role, body) in enumerate(turns_of(record, mapping))]
            return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 7

        return work

    return map_slices(records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record"), build, TURNS, weight=2)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def marked(role: str, text: str, learned: tuple[str, ...] = ("assistant",)) -> tuple[str, int, int]:
    """A turn's formatted text and the stretch of it under the loss mask; an empty stretch for roles that are not learned."""
    head = f"{OPEN}{quote(role, safe='')}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + (len(body) if role in learned else 0)


FORMATTED = "conv_id long, turn long, seq int, piece string, mask_start int, mask_end int"


def formatted(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Canonical turns as pieces of formatted text, with the loss mask in code points; a conversation is its pieces in the order of turn, seq and piece."""

    def build() -> Callable:
        def work(ids: list, numbers: list, seqs: list, roles: list, texts: list) -> list:
            made = [marked(r or "", t or "", learned) for r, t in zip(roles, texts, strict=True)]
            return [ids, numbers, seqs, *([m[k] for m in made] for k in range(3))]

        return work

    return map_slices(turns.select("conv_id", "turn", "seq", "role", "text"), build, FORMATTED, weight=4)


class Reader:
    """Reads the pieces of one conversation back, in order, without keeping them."""

    def __init__(self) -> None:
        self.n_turns = self.size = self.loss = 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def read(self, piece: str, start: int, end: int) -> None:
        role, rest = piece[len(OPEN) :].split("\n", 1)
        if not piece.startswith(OPEN) or rest.find(CLOSE) != len(rest) - len(CLOSE):
            raise ValueError("a piece of formatted text is not one turn")
        self.n_turns += 1
        self.size += len(piece)
        self.turns.update(f"{unquote(role)}\n{unescape(rest[: -len(CLOSE)])}\n".encode("utf-8", "surrogatepass"))
        text = unescape(piece[start:end])
        self.loss += len(text)
        self.learned.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.size


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted pieces.

    Pieces are sorted within partitions and read as a stream, so a conversation
    of any length holds no more than a batch and two hashes in memory.
    """
    kind = T.StructType.fromDDL(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        done: list[tuple] = []
        now, reader = None, None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)

        for batch in returned(batches):
            for part in slices(batch, 1):
                for conv, piece, start, end in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if reader is None or conv != now:
                        if reader is not None:
                            done.append(reader.row(now))
                        now, reader = conv, Reader()
                    reader.read(piece, start, end)
                if len(done) > 5_000:
                    yield rows()
                    done = []
        if reader is not None:
            done.append(reader.row(now))
        if done:
            yield rows()

    order = pieces.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "seq", "piece")
    return order.select("conv_id", "piece", "mask_start", "mask_end").mapInArrow(run, kind)


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each row of (conv_id, turn, role, text) as a record of the layout that its conversation is taken to have.

    Every fourth conversation each has rows, messages, ShareGPT entries, and
    prompts and completions; roles that a layout cannot tell stay rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    row = F.to_json(F.struct("turn", role.alias("role"), text.alias("text")))
    message = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    name = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    entry = F.to_json(F.struct(F.array(F.struct(name.alias("from"), text.alias("value"))).alias("conversations")))
    kind = F.when(role.isin("user", "assistant", "system"), F.pmod("conv_id", F.lit(4))).otherwise(0)
    single = F.when(role == "user", F.to_json(F.struct(text.alias("prompt")))).when(role == "assistant", F.to_json(F.struct(text.alias("completion")))).otherwise(message)
    record = F.when(kind == 1, message).when(kind == 2, entry).when(kind == 3, single).otherwise(row)
    return conversations.select("conv_id", "turn", record.alias("record"))
