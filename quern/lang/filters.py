"""The filter language: one regular expression for tokens, and a precedence-climbing parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ArgumentCountException, ParsingException, TokenizingException, UnknownFunctionException
from . import ast as A

MAX_LENGTH, MAX_NAME = 4000, 128

#: Arguments of each function: fixed values of the language.
ARITY = {
    "contains": (2, 2), "startswith": (2, 2), "endswith": (2, 2), "length": (1, 1), "concat": (2, 2), "indexof": (2, 2), "substring": (2, 3), "matchespattern": (2, 2), "tolower": (1, 1), "toupper": (1, 1), "trim": (1, 1),
    "year": (1, 1), "month": (1, 1), "day": (1, 1), "hour": (1, 1), "minute": (1, 1), "second": (1, 1), "date": (1, 1), "time": (1, 1), "now": (0, 0),
    "round": (1, 1), "floor": (1, 1), "ceiling": (1, 1),
}

#: Operators by how tightly they bind.
BINDS = {"or": 1, "and": 2, "eq": 3, "ne": 3, "gt": 4, "ge": 4, "lt": 4, "le": 4, "add": 5, "sub": 5, "mul": 6, "div": 6, "mod": 6, "in": 8}
PREFIX = 7

_TOKEN = re.compile(
    r"""(?P<ws>\s+)
    |(?i:duration)'(?P<duration>[^']*)'
    |'(?P<string>(?:[^']|'')*)'
    |(?P<guid>[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})(?![\w-])
    |(?P<datetime>\d{4}-\d\d-\d\d[Tt]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)
    |(?P<date>\d{4}-\d\d-\d\d)
    |(?P<time>\d\d:\d\d:\d\d(?:\.\d+)?)
    |(?P<float>[+-]?\d+(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+))(?!\w)
    |(?P<integer>[+-]?\d+)(?!\w)
    |(?P<name>[^\W\d]\w*(?:\.[^\W\d]\w*)*)
    |(?P<mark>[(),:/=-])""",
    re.X,
)

_LITERALS = {"duration": A.Duration, "guid": A.Guid, "datetime": A.DateTime, "date": A.Date, "time": A.Time, "float": A.Float, "integer": A.Integer}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    spaced: bool


def tokens(text: str) -> list[Token]:
    out, at, spaced = [], 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TokenizingException(f"unexpected character {text[at]!r} at {at}", expression=text)
        kind = m.lastgroup or ""
        if kind == "ws":
            spaced = True
        else:
            word = m[kind]
            if kind == "name" and any(len(p) > MAX_NAME for p in word.split(".")):
                raise TokenizingException(f"a name has more than {MAX_NAME} characters", expression=word[:MAX_NAME])
            out.append(Token(kind, word, at, spaced))
            spaced = False
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokens(text), 0

    def peek(self, ahead: int = 0) -> Token | None:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else None

    def take(self) -> Token:
        t = self.peek()
        if t is None:
            raise ParsingException("the expression ends too early", expression=self.text)
        self.at += 1
        return t

    def has(self, mark: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t is not None and t.kind == "mark" and t.text == mark

    def expect(self, mark: str) -> None:
        if not self.has(mark):
            raise self.wrong()
        self.at += 1

    def wrong(self) -> ParsingException:
        t = self.peek()
        return ParsingException(f"unexpected {t.text!r} at {t.at}" if t else "the expression ends too early", expression=self.text)

    def whole(self) -> A.Node:
        node = self.expression(0)
        if self.peek():
            raise self.wrong()
        return node

    def expression(self, least: int) -> A.Node:
        left = self.prefix()
        while (t := self.peek()) and t.kind == "name" and (binds := BINDS.get(op := t.text.lower())) and binds > least:
            after = self.peek(1)
            if not t.spaced and self.tokens[self.at - 1].kind in ("name", "integer", "float") or after is None:
                raise self.wrong()
            self.at += 1
            if op == "in":
                left = A.Compare("in", left, self.choices())
                continue
            right = self.expression(binds)
            kind = A.BoolOp if op in ("and", "or") else A.BinOp if binds in (5, 6) else A.Compare
            left = kind(op, left, right)
        return left

    def choices(self) -> A.Node:
        node = self.prefix()
        return node if isinstance(node, A.List) else A.List((node,))

    def prefix(self) -> A.Node:
        t = self.take()
        if t.kind == "string":
            return A.String(t.text.replace("''", "'"))
        if t.kind in _LITERALS:
            return _LITERALS[t.kind](t.text)
        if t.kind == "mark":
            if t.text == "(":
                return self.group()
            if t.text == "-":
                return A.UnaryOp("neg", self.expression(PREFIX))
        elif t.kind == "name":
            low = t.text.lower()
            operator_next = (n := self.peek()) is not None and n.kind == "name" and n.text.lower() in BINDS
            if low == "not" and n is not None and not operator_next:
                return A.UnaryOp("not", self.expression(PREFIX))
            if low in ("true", "false"):
                return A.Boolean(t.text)
            if low == "null":
                return A.Null()
            return self.call(t) if self.has("(") else self.path(t)
        self.at -= 1
        raise self.wrong()

    def group(self) -> A.Node:
        first = self.expression(0)
        if not self.has(","):
            self.expect(")")
            return first
        items = [first]
        while self.has(","):
            self.at += 1
            if self.has(")"):
                break
            items.append(self.expression(0))
        self.expect(")")
        return A.List(tuple(items))

    def path(self, t: A.Node | Token) -> A.Node:
        node = A.path_node(tuple(t.text.split(".")))
        while self.has("/"):
            self.at += 1
            n = self.take()
            if n.kind != "name":
                self.at -= 1
                raise self.wrong()
            if n.text.lower() in ("any", "all") and self.has("("):
                return self.lambda_(node, n.text.lower())
            for part in n.text.split("."):
                node = A.Attribute(node, part)
        return node

    def lambda_(self, owner: A.Node, op: str) -> A.Node:
        self.expect("(")
        if self.has(")"):
            if op == "all":
                raise ParsingException("all() needs a condition", expression=self.text)
            self.at += 1
            return A.CollectionLambda(owner, op)
        variable = self.take()
        if variable.kind != "name":
            self.at -= 1
            raise self.wrong()
        self.expect(":")
        body = self.expression(0)
        self.expect(")")
        return A.CollectionLambda(owner, op, variable.text, body)

    def call(self, t: Token) -> A.Node:
        name, args = t.text.lower(), []
        self.expect("(")
        while not self.has(")"):
            n = self.peek()
            if n and n.kind == "name" and self.has("=", 1):
                self.at += 2
                args.append(A.NamedParam(n.text, self.expression(0)))
            else:
                args.append(self.expression(0))
            if not self.has(","):
                break
            self.at += 1
        self.expect(")")
        if name not in ARITY:
            raise UnknownFunctionException(f"unknown function {t.text}", expression=self.text)
        low, high = ARITY[name]
        if not low <= len(args) <= high:
            raise ArgumentCountException(f"{t.text} takes {low if low == high else f'{low} to {high}'} arguments, {len(args)} given", expression=self.text)
        return A.Call(name, tuple(args))


def parse_filter(text: str) -> A.Node:
    """The tree of a $filter text."""
    if len(text) > MAX_LENGTH:
        raise ParsingException(f"a filter has at most {MAX_LENGTH} characters")
    return _Parser(text).whole()
