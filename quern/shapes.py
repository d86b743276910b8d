"""Rows as objects of declared dataclasses, and those as JSON values."""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Mapping
from typing import Any, TypeVar

from .catalog import public
from .errors import QueryError
from .intent import MAX_DEPTH

T = TypeVar("T")


class _Unset:
    """A field that the query didn't select, which is not the same as null."""

    def __repr__(self) -> str:
        return "UNSET"

    def __bool__(self) -> bool:
        return False


UNSET: Any = _Unset()


def inner(hint: Any) -> tuple[type | None, bool]:
    """The dataclass in a type hint, and whether it is in a list: X, X | None, list[X] or list[X] | None."""
    many = False
    while (origin := typing.get_origin(hint)) is not None:
        if origin in (typing.Union, types.UnionType):
            hint = next((a for a in typing.get_args(hint) if a is not type(None)), None)
        elif origin in (list, tuple):
            many, hint = True, typing.get_args(hint)[0]
        else:
            return None, False
    return (hint, many) if dataclasses.is_dataclass(hint) else (None, False)


def to_object(shape: type[T], row: Mapping[str, Any], depth: int = 0) -> T:
    """An object of the dataclass from a row's dict, nested ones too; fields that the row lacks are UNSET."""
    if depth > MAX_DEPTH:
        raise QueryError(f"objects nest at most {MAX_DEPTH} deep")
    hints, values = typing.get_type_hints(shape), {}
    for f in dataclasses.fields(shape):
        v = row.get(f.name, UNSET)
        nested, _ = inner(hints[f.name])
        if nested is not None and v is not UNSET and v is not None:
            v = [to_object(nested, x, depth + 1) for x in v] if isinstance(v, (list, tuple)) else to_object(nested, v, depth + 1)
        values[f.name] = v
    return shape(**values)


def to_json(value: Any) -> Any:
    """What a client may see: without UNSET and private fields, without those that the class lists in _excluded_fields or that are marked write_only."""
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    if not dataclasses.is_dataclass(value):
        return value
    hidden = getattr(value, "_excluded_fields", ())
    shown = [f for f in dataclasses.fields(value) if public(f.name) and f.name not in hidden and not f.metadata.get("write_only")]
    return {f.name: to_json(v) for f in shown if (v := getattr(value, f.name)) is not UNSET}


def dict_type(shape: type, seen: tuple[type, ...] = ()) -> Any:
    """A TypedDict of the dataclass, all keys optional; a class inside itself is a plain dict."""
    if shape in seen:
        return dict
    hints, keys = typing.get_type_hints(shape), {}
    for f in dataclasses.fields(shape):
        nested, many = inner(hints[f.name])
        kind = hints[f.name] if nested is None else dict_type(nested, (*seen, shape))
        keys[f.name] = list[kind] if nested is not None and many else kind
    return typing.TypedDict(f"{shape.__name__}Dict", keys, total=False)
