"""Nodes of filter and $apply expressions: frozen, hashable, free of Spark."""

from __future__ import annotations

import dataclasses
import re
import uuid
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from decimal import Decimal
from typing import Any

from ..errors import InvalidValueError


@dataclass(frozen=True)
class Node:
    def children(self) -> list[Node]:
        out: list[Node] = []
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            out += [v] if isinstance(v, Node) else [x for x in v if isinstance(x, Node)] if isinstance(v, tuple) else []
        return out


@dataclass(frozen=True)
class Identifier(Node):
    name: str


@dataclass(frozen=True)
class Attribute(Node):
    """`attr` of what `owner` leads to."""

    owner: Node
    attr: str


@dataclass(frozen=True)
class Literal(Node):
    """text: as written, without quotes. value: the Python value, read late so that a bad date is an error of the request and not of the grammar."""

    text: str

    @property
    def value(self) -> Any:
        return self.text


@dataclass(frozen=True)
class Null(Literal):
    text: str = "null"

    @property
    def value(self) -> None:
        return None


class Boolean(Literal):
    @property
    def value(self) -> bool:
        return self.text.lower() == "true"


class Integer(Literal):
    @property
    def value(self) -> int:
        return int(self.text)


class Float(Literal):
    @property
    def value(self) -> float:
        return float(self.text)

    @property
    def exact(self) -> Decimal:
        return Decimal(self.text)


class String(Literal):
    pass


class Guid(Literal):
    @property
    def value(self) -> uuid.UUID:
        return uuid.UUID(self.text)


def _read(kind: str, text: str, how):
    try:
        return how(text)
    except ValueError as e:
        raise InvalidValueError(f"not a {kind}: {text}", expression=text) from e


class Date(Literal):
    @property
    def value(self) -> date:
        return _read("date", self.text, date.fromisoformat)


class Time(Literal):
    @property
    def value(self) -> time:
        return _read("time", self.text, time.fromisoformat)


class DateTime(Literal):
    @property
    def value(self) -> datetime:
        return _read("date and time", self.text.upper(), lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")))

    @property
    def utc(self) -> datetime:
        """Without zone; a zoned value in UTC."""
        v = self.value
        return v.astimezone(timezone.utc).replace(tzinfo=None) if v.tzinfo else v


_DURATION = re.compile(r"([+-])?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", re.I)


class Duration(Literal):
    @property
    def value(self) -> timedelta:
        m = _DURATION.fullmatch(self.text)
        if not m or not any(m.groups()[1:]):
            raise InvalidValueError(f"not a duration: {self.text}", expression=self.text)
        y, mo, d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
        out = timedelta(days=365.25 * y + 30.44 * mo + d, hours=h, minutes=mi, seconds=s)
        return -out if m[1] == "-" else out


@dataclass(frozen=True)
class List(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Compare(Node):
    """op: eq ne lt le gt ge in"""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class BoolOp(Node):
    """op: and or"""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class BinOp(Node):
    """op: add sub mul div mod"""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class UnaryOp(Node):
    """op: not neg"""

    op: str
    operand: Node


@dataclass(frozen=True)
class NamedParam(Node):
    name: str
    value: Node


@dataclass(frozen=True)
class Call(Node):
    """name: lower case, with its namespace if any."""

    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class CollectionLambda(Node):
    """owner/any(variable: body), or all; any() has neither variable nor body."""

    owner: Node
    op: str
    variable: str | None = None
    body: Node | None = None


@dataclass(frozen=True)
class Aggregate(Node):
    """source with method as alias; source is None for $count."""

    source: str | None
    method: str
    alias: str


@dataclass(frozen=True)
class FilterStage(Node):
    condition: Node


@dataclass(frozen=True)
class AggregateStage(Node):
    aggregates: tuple[Aggregate, ...]


@dataclass(frozen=True)
class GroupByStage(Node):
    fields: tuple[str, ...]
    aggregates: tuple[Aggregate, ...] = ()


def path_of(node: Node) -> tuple[str, ...]:
    """The names along a path, or () if the node is none."""
    if isinstance(node, Identifier):
        return (node.name,)
    if isinstance(node, Attribute):
        head = path_of(node.owner)
        return (*head, node.attr) if head else ()
    return ()


def path_node(names: tuple[str, ...]) -> Node:
    node: Node = Identifier(names[0])
    for n in names[1:]:
        node = Attribute(node, n)
    return node


class NodeVisitor:
    """Calls visit_<Class> for a node, or visits its children."""

    def visit(self, node: Node) -> Any:
        for kind in type(node).__mro__:
            if found := getattr(self, f"visit_{kind.__name__}", None):
                return found(node)
        return self.generic_visit(node)

    def generic_visit(self, node: Node) -> Any:
        for child in node.children():
            self.visit(child)


class NodeTransformer(NodeVisitor):
    """Gives back the tree with each node replaced by what its visit returns; unchanged parts are shared."""

    def generic_visit(self, node: Node) -> Node:
        new = {}
        for f in dataclasses.fields(node):
            v = getattr(node, f.name)
            w = self.visit(v) if isinstance(v, Node) else tuple(self.visit(x) if isinstance(x, Node) else x for x in v) if isinstance(v, tuple) else v
            if w != v:
                new[f.name] = w
        return dataclasses.replace(node, **new) if new else node


class _Unprefix(NodeTransformer):
    def __init__(self, variable: str) -> None:
        self.variable = variable

    def _strip(self, node: Node) -> Node:
        names = path_of(node)
        return path_node(names[1:]) if len(names) > 1 and names[0] == self.variable else node

    def visit_Identifier(self, node: Identifier) -> Node:
        return node

    def visit_Attribute(self, node: Attribute) -> Node:
        return self._strip(node)

    def visit_CollectionLambda(self, node: CollectionLambda) -> Node:
        owner = self.visit(node.owner)
        body = node.body if node.body is None or node.variable == self.variable else self.visit(node.body)
        return dataclasses.replace(node, owner=owner, body=body)


def without_variable(body: Node, variable: str) -> Node:
    """The body of a lambda as an expression on the related entity. An inner lambda of the same variable keeps its own."""
    return _Unprefix(variable).visit(body)
