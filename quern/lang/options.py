"""Query strings: the options, and the small languages of $select, $orderby, $expand and $apply."""

from __future__ import annotations

import re
from collections.abc import Mapping
from types import MappingProxyType
from urllib.parse import parse_qsl

from ..errors import InvalidValueError, QueryError
from ..intent import MAX_SKIP, MAX_TOP, OrderKey, QueryIntent
from . import ast as A
from .filters import parse_filter

MAX_QUERY = 4096


def split_outside(text: str, marks: str, what: str) -> list[str]:
    """Parts between marks that are in no quotes and no parentheses."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                break
            if c in marks and not depth:
                parts.append(text[start:i])
                start = i + 1
    if depth or quoted:
        raise QueryError(f"unbalanced parentheses or quotes in {what}", what, text)
    return [*parts, text[start:]]


def options(query: str | Mapping[str, object] | None) -> dict[str, str]:
    """Option texts by name, decoded once; of options given twice the last counts, and blank ones don't."""
    if not query:
        return {}
    if isinstance(query, str):
        if len(query) > MAX_QUERY:
            raise QueryError(f"a query has at most {MAX_QUERY} characters")
        return dict(parse_qsl(query.removeprefix("?")))
    return {k: str(v) for k, v in query.items() if v is not None}


def select(text: str) -> tuple[str, ...]:
    return tuple(p for x in text.split(",") if (p := x.strip()))


def orderby(text: str) -> tuple[OrderKey, ...]:
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        words = part.split()
        direction = words[-1].lower() if len(words) > 1 else "asc"
        if len(words) > 2 or direction not in ("asc", "desc"):
            raise QueryError("an order key is a path and asc or desc", "$orderby", part)
        out.append(OrderKey(words[0].replace(".", "/"), direction == "desc"))
    return tuple(out)


def _bounded_int(name: str, text: str | None, most: int) -> int | None:
    if text is None or not text.strip():
        return None
    if not re.fullmatch(r"\s*\+?\d+\s*", text) or int(text) > most:
        raise InvalidValueError(f"{name} is a number from 0 to {most}", name, text)
    return int(text)


def expand(text: str) -> Mapping[str, QueryIntent]:
    out: dict[str, QueryIntent] = {}
    for part in filter(None, map(str.strip, split_outside(text, ",;", "$expand"))):
        name, paren, rest = part.partition("(")
        if paren and not rest.endswith(")"):
            raise QueryError("text after the options of a relation", "$expand", part)
        nested = {}
        for option in split_outside(rest[:-1], ";", "$expand") if paren else ():
            key, _, value = option.strip().partition("=")
            if key.startswith("$") and value.strip():
                nested[key.strip()] = value.strip()
        out[name.strip()] = intent_of(nested, nested=True)
    return MappingProxyType(out)


_AGGREGATE = re.compile(r"(?:(?P<count>\$count)|(?P<source>[\w./]+)\s+with\s+(?P<method>\w+))\s+as\s+(?P<alias>[A-Za-z_]\w*)", re.I)


def _aggregates(text: str) -> tuple[A.Aggregate, ...]:
    out = []
    for part in map(str.strip, split_outside(text, ",", "$apply")):
        m = _AGGREGATE.fullmatch(part)
        if not m:
            raise QueryError("an aggregate is `field with method as name` or `$count as name`", "$apply", part)
        out.append(A.Aggregate(None if m["count"] else m["source"].replace(".", "/"), "count" if m["count"] else m["method"].lower(), m["alias"]))
    return tuple(out)


def apply(text: str) -> tuple[A.Node, ...]:
    """The stages of an $apply text."""
    if not text.strip():
        raise QueryError("$apply is empty", "$apply", text)
    stages: list[A.Node] = []
    for part in map(str.strip, split_outside(text, "/", "$apply")):
        m = re.fullmatch(r"(filter|groupby|aggregate)\s*\((.*)\)", part, re.I | re.S)
        if not m:
            raise QueryError("a stage is filter(...), groupby(...) or aggregate(...)", "$apply", part)
        kind, body = m[1].lower(), m[2].strip()
        if kind == "filter":
            if not body:
                raise QueryError("filter() needs a condition", "$apply", part)
            stages.append(A.FilterStage(parse_filter(body)))
        elif kind == "aggregate":
            stages.append(A.AggregateStage(_aggregates(body)))
        else:
            keys, *rest = (x.strip() for x in split_outside(body, ",", "$apply"))
            fields = tuple(f.strip().replace(".", "/") for f in keys[1:-1].split(",")) if keys.startswith("(") and keys.endswith(")") else ()
            inner = re.fullmatch(r"aggregate\s*\((.*)\)", rest[0], re.I | re.S) if len(rest) == 1 else None
            if not fields or not all(fields) or len(rest) > 1 or rest and not inner:
                raise QueryError("groupby is ((fields)) or ((fields), aggregate(...))", "$apply", part)
            stages.append(A.GroupByStage(fields, _aggregates(inner[1]) if inner else ()))
    for stage in stages[:-1]:
        if isinstance(stage, A.AggregateStage):
            raise QueryError("aggregate(...) must be the last stage", "$apply", text)
    return tuple(stages)


def intent_of(query: str | Mapping[str, object] | None, *, nested: bool = False) -> QueryIntent:
    """The intent of a query string or of a dict of options; unknown options are ignored."""
    o = options(query)
    return QueryIntent(
        filter=parse_filter(o["$filter"]) if o.get("$filter", "").strip() else None,
        select=select(o["$select"]) if "$select" in o else None,
        expand=expand(o["$expand"]) if "$expand" in o else MappingProxyType({}),
        orderby=orderby(o.get("$orderby", "")),
        top=_bounded_int("$top", o.get("$top"), MAX_TOP),
        skip=_bounded_int("$skip", o.get("$skip"), MAX_SKIP),
        count=o.get("$count", "").strip().lower() == "true",
        apply=apply(o["$apply"]) if "$apply" in o and not nested else None,
    )
