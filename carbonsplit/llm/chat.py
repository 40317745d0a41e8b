"""Chat formatting: templates are compiled to Python closures and rendered turn by turn.

The template language has ``{{ value }}``, ``{% for x in messages %}``, ``{% if %}`` with
``elif`` and ``else``, ``{% generation %}`` around what is learned, and ``{# notes #}``.
Values are names, ``x.field``, strings, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not`` and the
filters ``escape`` and ``upper``.  Nothing else can be reached: no calls, no attributes
but the fields of a message.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{# one element per turn; texts and roles are escaped, so the marks appear nowhere else #}"
    "{% for message in messages %}"
    '<turn role="{{ message.role | escape }}">'
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
#: What ``escape`` writes for the characters of which control strings are made.
ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", '"': "\\q", "#": "\\h"}
_ESCAPED = {v: k for k, v in ESCAPES.items()}
_TABLE = str.maketrans(ESCAPES)
_TURN = re.compile(r'<turn role="([^"<>]*)">([^<>]*)</turn>\n')
#: Code points after which a conversation's output goes on in another row, at the end of a turn.
PIECE_CHARS = 1 << 20

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_LEXEME = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[+|.()])|([A-Za-z_][A-Za-z0-9_]*))")


def escape(text: str) -> str:
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _ESCAPED[m[0]], text)


class TemplateError(ValueError):
    """The template is not in the language."""


class Text(NamedTuple):
    value: str


class Value(NamedTuple):
    kind: str  # text, name, field, add, equal, unequal, and, or, not, filter
    parts: tuple


class Show(NamedTuple):
    value: Value


class For(NamedTuple):
    name: str
    source: str
    body: tuple


class If(NamedTuple):
    test: Value
    body: tuple
    other: tuple


class Learned(NamedTuple):
    body: tuple


_FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper}


class _Expression:
    """Reads one value; the weakest binding is ``or``, the strongest a filter."""

    def __init__(self, source: str):
        self.found, at = [], 0
        while source[at:].strip():
            match = _LEXEME.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.found.append(match[0].strip())
            at = match.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.found[self.at] if self.at < len(self.found) else None

    def take(self, wanted: str | None = None) -> str:
        word = self.peek()
        if word is None or wanted not in (None, word):
            raise TemplateError(f"expected {wanted or 'a value'}, got {word!r}")
        self.at += 1
        return word

    def whole(self) -> Value:
        value = self.binary(0)
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return value

    _LEVELS = ({"or": "or"}, {"and": "and"}, {"==": "equal", "!=": "unequal"}, {"+": "add"})

    def binary(self, level: int) -> Value:
        if level == len(self._LEVELS):
            return self.filtered()
        if level == 2 and self.peek() == "not":
            self.take()
            return Value("not", (self.binary(level),))
        value = self.binary(level + 1)
        while self.peek() in self._LEVELS[level]:
            value = Value(self._LEVELS[level][self.take()], (value, self.binary(level + 1)))
        return value

    def filtered(self) -> Value:
        word = self.take()
        if word == "(":
            value = self.binary(0)
            self.take(")")
        elif word[0] in "'\"":
            value = Value("text", (re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1]),))
        elif word.isidentifier():
            value = Value("name", (word,))
            if self.peek() == ".":
                self.take()
                value = Value("field", (word, self.take()))
        else:
            raise TemplateError(f"unexpected {word!r}")
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Value("filter", (name, value))
        return value


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    pieces = [p for p in _TAGS.split(template) if p and not p.startswith("{#")]
    body, rest, end = _block(pieces, ())
    if end or rest:
        raise TemplateError(f"unexpected {end}")
    return body


def _block(pieces: list[str], ends: tuple[str, ...]) -> tuple[tuple, list[str], str]:
    nodes: list = []
    while pieces:
        piece, pieces = pieces[0], pieces[1:]
        if piece.startswith("{{"):
            nodes.append(Show(_Expression(piece[2:-2]).whole()))
        elif piece.startswith("{%"):
            word, _, more = piece[2:-2].strip().partition(" ")
            if word in ends:
                return tuple(nodes), pieces, piece[2:-2].strip()
            node, pieces = _statement(word, more, pieces)
            nodes.append(node)
        else:
            nodes.append(Text(piece))
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return tuple(nodes), pieces, ""


def _statement(word: str, more: str, pieces: list[str]) -> tuple[NamedTuple, list[str]]:
    if word == "for":
        match = re.fullmatch(r"(\w+)\s+in\s+(\w+)", more.strip())
        if not match:
            raise TemplateError(f"cannot read for {more}")
        body, pieces, _ = _block(pieces, ("endfor",))
        return For(match[1], match[2], body), pieces
    if word == "if":
        body, pieces, end = _block(pieces, ("elif", "else", "endif"))
        other: tuple = ()
        if end.startswith("elif"):
            node, pieces = _statement("if", end[4:], pieces)
            other = (node,)
        elif end == "else":
            other, pieces, _ = _block(pieces, ("endif",))
        return If(_Expression(more).whole(), body, other), pieces
    if word == "generation":
        body, pieces, _ = _block(pieces, ("endgeneration",))
        return Learned(body), pieces
    raise TemplateError(f"no statement {word!r}")


_OPERATIONS = {"add": lambda a, b: a + b, "equal": lambda a, b: a == b, "unequal": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def folded_value(value: Value) -> Value:
    """Values made of strings alone are worked out."""
    if value.kind == "filter":
        inner = folded_value(value.parts[1])
        return Value("text", (_FILTERS[value.parts[0]](str(inner.parts[0])),)) if inner.kind == "text" else Value("filter", (value.parts[0], inner))
    if value.kind in _OPERATIONS or value.kind == "not":
        parts = tuple(folded_value(p) for p in value.parts)
        if all(p.kind == "text" for p in parts):
            known = [p.parts[0] for p in parts]
            return Value("text", (not known[0] if value.kind == "not" else _OPERATIONS[value.kind](*known),))
        return Value(value.kind, parts)
    return value


def folded(nodes: tuple) -> tuple:
    """Constant values become text, decided branches are chosen, neighbouring texts are joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Show):
            value = folded_value(node.value)
            new = [Text(str(value.parts[0]))] if value.kind == "text" else [Show(value)]
        elif isinstance(node, If):
            test = folded_value(node.test)
            if test.kind == "text":
                new = list(folded(node.body if test.parts[0] else node.other))
            else:
                new = [If(test, folded(node.body), folded(node.other))]
        elif isinstance(node, For):
            new = [node._replace(body=folded(node.body))]
        elif isinstance(node, Learned):
            new = [Learned(folded(node.body))]
        else:
            new = [node]
        for one in new:
            if isinstance(one, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + one.value)
            else:
                out.append(one)
    return tuple(out)


#: A closure yields (text, learned) and, after each round of a loop, None: output may be cut there.
Render = Callable[[dict, bool], Iterator[tuple[str, bool] | None]]


def value_of(value: Value) -> Callable[[dict], object]:
    if value.kind == "text":
        return lambda scope, known=value.parts[0]: known
    if value.kind == "name":
        return lambda scope, name=value.parts[0]: scope.get(name, "")
    if value.kind == "field":
        name, field = value.parts

        def field_of(scope: dict) -> object:
            owner = scope.get(name)
            return owner.get(field, "") if isinstance(owner, dict) else ""

        return field_of
    if value.kind == "filter":
        change, inner = _FILTERS[value.parts[0]], value_of(value.parts[1])
        return lambda scope: change(str(inner(scope)))
    parts = [value_of(p) for p in value.parts]
    if value.kind == "not":
        return lambda scope: not parts[0](scope)
    operation = _OPERATIONS[value.kind]
    return lambda scope: operation(parts[0](scope), parts[1](scope))


def generated(nodes: tuple) -> Render:
    steps = [_step(node) for node in nodes]

    def render(scope: dict, learned: bool):
        for step in steps:
            yield from step(scope, learned)

    return render


def _step(node: NamedTuple) -> Render:
    if isinstance(node, Text):
        return lambda scope, learned: iter(((node.value, learned),))
    if isinstance(node, Show):
        shown = value_of(node.value)
        return lambda scope, learned: iter(((str(shown(scope)), learned),))
    if isinstance(node, Learned):
        inner = generated(node.body)
        return lambda scope, learned: inner(scope, True)
    if isinstance(node, If):
        test, body, other = value_of(node.test), generated(node.body), generated(node.other)
        return lambda scope, learned: (body if test(scope) else other)(scope, learned)
    body = generated(node.body)

    def loop(scope: dict, learned: bool):
        for item in scope.get(node.source) or ():
            yield from body({**scope, node.name: item}, learned)
            yield None

    return loop


def compiled(template: str) -> Render:
    return generated(folded(parse(template)))


def pieces(render: Render, messages: Iterable[dict], limit: int = PIECE_CHARS) -> Iterator[tuple[str, list[dict], int]]:
    """``(text, learned spans, turns)`` of a conversation, cut after a turn once ``limit`` code points are reached."""
    parts: list[str] = []
    spans: list[dict] = []
    size = turns = done = 0

    def counted():
        nonlocal turns
        for message in messages:
            turns += 1
            yield message

    for part in render({"messages": counted()}, False):
        if part is None:
            if size >= limit:
                yield "".join(parts), spans, turns - done
                parts, spans, size, done = [], [], 0, turns
            continue
        text, learned = part
        if learned:
            if spans and spans[-1]["end"] == size:
                spans[-1]["end"] = size + len(text)
            else:
                spans.append({"start": size, "end": size + len(text)})
        parts.append(text)
        size += len(text)
    yield "".join(parts), spans, turns - done


_PIECE = "conv_id string, piece long, formatted string, spans array<struct<start: long, end: long>>, turns long"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id`` (as string), ``piece``, ``formatted``, ``spans`` of learned text, ``turns``.

    Turns go by ``turn`` (null first), ties by role and text; null roles and texts are
    empty; rows with a null ``conv_id`` are one conversation; repeated rows are turns of
    their own; empty tables give no rows; other columns do not matter.

    A conversation is read as a stream of sorted rows and written in pieces of about
    ``PIECE_CHARS``, cut between turns, so a long one needs no more memory than another.
    The pieces of a conversation follow one another in one partition.
    """
    compiled(template)  # a wrong template fails here and not in the tasks
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def formatted(batches):
        render = compiled(template)
        turns = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(b["conv_id"], b["role"], b["text"], strict=True))
        out = []
        size = 0
        for conv_id, own in itertools.groupby(turns, key=lambda x: x[0]):
            for n, (text, spans, count) in enumerate(pieces(render, (m for _, m in own))):
                out.append((conv_id, n, text, spans, count))
                size += len(text)
                if size >= PIECE_CHARS:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return placed.mapInPandas(formatted, _PIECE)


_COLUMNS = ["conv_id", "piece", "formatted", "spans", "turns"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces: turns, digests of all turns and of the learned text, lengths.

    ``formatted`` must come straight from :func:`format_conversations`, whose partitions
    keep a conversation's pieces together and in order.
    """

    def read(batches):
        out = []
        rows = (row for b in batches for row in zip(b["conv_id"], b["formatted"], b["spans"], strict=True))
        for conv_id, own in itertools.groupby(rows, key=lambda x: x[0]):
            turns, learned, all_turns, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, spans in own:
                size += len(text)
                for role, said in _TURN.findall(text):
                    all_turns += 1
                    turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    chars += len(said)
                    learned.update(said.encode())
            out.append((conv_id, all_turns, turns.hexdigest(), chars, learned.hexdigest(), size))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=_READ_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_READ_COLUMNS)

    return formatted.mapInPandas(read, _READ)


_READ = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
