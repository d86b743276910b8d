"""Entities, their relations, and what a selector lets through."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from .errors import FieldNotFoundError, InvalidFieldError, QueryError

_NAME = re.compile(r"[A-Za-z_]\w*")


@dataclass(frozen=True)
class Relation:
    """kind: forward (0 or 1 target: `local` here is `remote` there), reverse (0 to n children whose `remote` is our `local`) or many (through bridge(),
    whose columns bridge_local and bridge_remote hold our `local` and the target's `remote`)."""

    kind: str
    target: str
    local: str
    remote: str
    bridge: Callable[[], DataFrame] | None = None
    bridge_local: str = ""
    bridge_remote: str = ""


@dataclass(frozen=True)
class EntityDef:
    """source() gives the table as a lazy DataFrame; pk are the columns that make a row unique, or all columns if there is no key."""

    name: str
    source: Callable[[], DataFrame]
    pk: tuple[str, ...]
    relations: Mapping[str, Relation] = field(default_factory=dict)


class Catalog:
    """Entities by name."""

    def __init__(self, entities: Sequence[EntityDef] = (), namespace: str = "Default") -> None:
        self.entities = {e.name: e for e in entities}
        self.namespace = namespace

    def __getitem__(self, name: str) -> EntityDef:
        if name not in self.entities:
            raise QueryError(f"no entity {name}")
        return self.entities[name]

    def register(self, entity: EntityDef) -> None:
        self.entities[entity.name] = entity


@dataclass(frozen=True)
class Policy:
    """None in an allow-list means no restriction, an empty one allows nothing. expandable: relation name -> Policy of what it leads to, or None for all.

    aliases: API name -> field or dotted path. computed: name -> function giving a Column over the row's columns; requires: name -> names it needs.
    """

    allowed_fields: tuple[str, ...] | None = None
    filterable: tuple[str, ...] | None = None
    not_filterable: tuple[str, ...] = ()
    sortable: tuple[str, ...] | None = None
    not_sortable: tuple[str, ...] = ()
    expandable: Mapping[str, Policy | None] | None = None
    aliases: Mapping[str, str] = field(default_factory=dict)
    computed: Mapping[str, Callable[..., Column]] = field(default_factory=dict)
    requires: Mapping[str, Sequence[str]] = field(default_factory=dict)
    default_order: tuple[str, ...] = ()
    default_top: int = 100
    max_top: int = 500
    apply_keys: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    apply_aggregates: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, target in self.aliases.items():
            if not _NAME.fullmatch(name) or not all(_NAME.fullmatch(p) for p in target.replace("/", ".").split(".")):
                raise ValueError(f"not an alias: {name} -> {target}")

    def real(self, names: Sequence[str]) -> tuple[str, ...]:
        """The path with an alias in first place replaced."""
        head = self.aliases.get(names[0], names[0]).replace("/", ".").split(".")
        return (*head, *names[1:])

    def check(self, names: Sequence[str], use: str = "read") -> tuple[str, ...]:
        """The real path if it may be used so (read, filter, sort); existence is checked where the columns are known."""
        api, real = "/".join(names), self.real(names)
        allow, deny = {"filter": (self.filterable, self.not_filterable), "sort": (self.sortable, self.not_sortable)}.get(use, (None, ()))

        def within(listed: Sequence[str]) -> bool:
            return any(p == x or p.startswith(f"{x}/") for x in (y.replace(".", "/") for y in listed) for p in (api, "/".join(real)))

        if allow is not None:
            if not within(allow):
                raise InvalidFieldError(f"{api} can't be used to {use}", api)
        elif within(deny):
            raise InvalidFieldError(f"{api} can't be used to {use}", api)
        protected(real)
        if self.allowed_fields is not None and names[0] not in self.allowed_fields and real[0] not in self.allowed_fields and names[0] not in self.computed:
            raise FieldNotFoundError(f"no field {api}", api)
        return real

    def relation(self, name: str) -> Policy:
        """The policy behind a relation that may be expanded."""
        if self.expandable is not None and name not in self.expandable:
            raise InvalidFieldError(f"{name} can't be expanded", name)
        return (self.expandable or {}).get(name) or OPEN


def protected(names: Sequence[str]) -> None:
    for n in names:
        if n.startswith("_") or n.lower() == "password":
            raise InvalidFieldError(f"{'/'.join(names)} is private", n)


def public(name: str) -> bool:
    return not name.startswith("_") and name.lower() != "password"


OPEN = Policy()


@dataclass(frozen=True)
class RelationAggregate:
    """A computed column that aggregates a to-many relation, 0 or null where there are no rows: aggregate() is a Column over the related entity."""

    relation: str
    aggregate: Callable[[], Column]
    missing: Any = 0
