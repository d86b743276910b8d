"""What a query asks for, whichever front end it came from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType

from .lang.ast import Node

MAX_TOP, MAX_SKIP, MAX_DEPTH = 10_000, 1_000_000, 10


@dataclass(frozen=True)
class OrderKey:
    """path: names joined by /"""

    path: str
    descending: bool = False


def _empty() -> Mapping[str, QueryIntent]:
    return MappingProxyType({})


@dataclass(frozen=True)
class QueryIntent:
    filter: Node | None = None
    select: tuple[str, ...] | None = None
    expand: Mapping[str, QueryIntent] = field(default_factory=_empty)
    orderby: tuple[OrderKey, ...] = ()
    top: int | None = None
    skip: int | None = None
    count: bool = False
    apply: tuple[Node, ...] | None = None

    def unpaged(self) -> QueryIntent:
        return replace(self, top=None, skip=None)


def bounded(intent: QueryIntent, default_order: tuple[str, ...], default_top: int, max_top: int) -> QueryIntent:
    """With the default order if it has none, and with a page of at most max_top rows."""
    order = intent.orderby or tuple(OrderKey(f.removeprefix("-"), f.startswith("-")) for f in default_order)
    return replace(intent, orderby=order, top=min(default_top if intent.top is None else intent.top, max_top))
