"""An intent as a lazy DataFrame: filter, computed columns, order, page, projection, and nested relations, all in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import OPEN, Catalog, EntityDef, Policy, Relation, protected, public
from ..errors import FieldNotFoundError, InvalidFieldError, QueryError
from ..intent import MAX_DEPTH, OrderKey, QueryIntent
from .predicates import Frame, bridge_of


def split_path(path: str) -> tuple[str, ...]:
    return tuple(path.replace(".", "/").split("/"))


def output_names(frame: Frame, intent: QueryIntent) -> list[str]:
    """API names of the fields to give out; relations that are only expanded come on their own."""
    policy = frame.policy
    chosen = [n for n in intent.select or () if n not in intent.expand]
    if intent.select is None or "*" in chosen:
        if policy.allowed_fields is not None:
            return [n for n in policy.allowed_fields if n not in frame.entity.relations]
        aliased = {t: a for a, t in policy.aliases.items() if t in frame.fields}
        return [aliased.get(c, c) for c in frame.fields if public(c)]
    return list(dict.fromkeys(chosen))


def order_columns(frame: Frame, keys: tuple[OrderKey, ...], *, complete: bool) -> list[Column]:
    """Sort columns, nulls first ascending and last descending; complete: with the key, or all columns, behind them, so that the order is total."""
    out = []
    for k in keys:
        real = frame.policy.check(split_path(k.path), "sort")
        column, _ = frame.field(real)
        out.append(column.desc() if k.descending else column.asc())
    if complete:
        own = frame.entity.pk or tuple(frame.fields)
        out += [frame.own(c).asc() for c in own if not isinstance(frame.types[frame.prefix + c], T.MapType)]
    return out


class Nested:
    """Compiles an intent on an entity. Inner levels are compiled the same way, from the inside outwards."""

    def __init__(self, catalog: Catalog, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            raise QueryError(f"relations nest at most {MAX_DEPTH} deep", "$expand")
        self.catalog, self.depth = catalog, depth

    def rows(self, entity: EntityDef, policy: Policy, intent: QueryIntent, df: DataFrame | None = None) -> DataFrame:
        """The rows that an intent asks for, in its order."""
        frame = Frame(self.catalog, entity, policy, df)
        if intent.filter is not None:
            frame.where(intent.filter)
        paged = intent.top is not None or intent.skip is not None
        keys = order_columns(frame, intent.orderby, complete=paged) if intent.orderby or paged else []
        if paged:
            # the page first, so that relations are only looked up for its rows
            frame.df = self._page(frame.df.orderBy(*keys), intent)
        names, columns = self.project(frame, intent)
        for name, nested in intent.expand.items():
            self.expand(frame, name, nested, semi=paged)
            names.append(name)
            columns.append(F.col(f"{frame.prefix}expanded__{name}").alias(name))
        out = frame.df
        if keys and (intent.expand or not paged):
            out = out.orderBy(*keys)
        return out.select(*columns)

    @staticmethod
    def _page(df: DataFrame, intent: QueryIntent) -> DataFrame:
        df = df.offset(intent.skip) if intent.skip else df
        return df if intent.top is None else df.limit(intent.top)

    def project(self, frame: Frame, intent: QueryIntent) -> tuple[list[str], list[Column]]:
        names, columns = [], []
        for name in output_names(frame, intent):
            if name in frame.entity.relations and name not in intent.expand:
                raise InvalidFieldError(f"{name} is a relation; expand it", name)
            real = frame.policy.check(split_path(name))
            names.append(name.replace("/", "_").replace(".", "_"))
            columns.append(frame.field(real)[0].alias(names[-1]))
        return names, columns

    def expand(self, frame: Frame, name: str, intent: QueryIntent, *, semi: bool) -> None:
        """Adds the relation's struct, or array of structs, to the frame as prefix + expanded__ + name."""
        policy = frame.policy.relation(name)
        target = frame.policy.aliases.get(name, name)
        rel = frame.entity.relations.get(target)
        if rel is None:
            raise InvalidFieldError(f"{name} is no relation", name)
        if intent.apply:
            raise QueryError("$apply can't be nested", "$expand", name)
        out = f"{frame.prefix}expanded__{name}"
        child = Frame(self.catalog, self.catalog[rel.target], policy)
        if intent.filter is not None:
            child.where(intent.filter)
        if rel.kind == "forward":
            if intent.top is not None or intent.skip is not None:
                raise QueryError(f"{name} has at most one row; $top and $skip don't apply", "$expand", name)
            self._children(child, intent, semi=intent.filter is not None)
            key = f"{out}__key"
            one = child.df.select(child.own(rel.remote).alias(key), F.struct(*self._columns(child, intent)).alias(out))
            frame.df = frame.df.join(one, frame.own(rel.local) == F.col(key), "left").drop(key)
        else:
            many = self._arrays(child, rel, intent, out, frame if semi else None)
            key = f"{out}__key"
            frame.df = frame.df.join(many, frame.own(rel.local) == F.col(key), "left").drop(key)
            frame.df = frame.df.withColumn(out, F.coalesce(out, F.array().cast(many.schema[out].dataType)))

    def _children(self, child: Frame, intent: QueryIntent, *, semi: bool) -> None:
        """Expands the child's own relations; semi: the child's rows are cut, so only what belongs to them is ranked and grouped."""
        inner = Nested(self.catalog, self.depth + 1)
        for name, nested in intent.expand.items():
            inner.expand(child, name, nested, semi=semi)

    def _columns(self, child: Frame, intent: QueryIntent) -> list[Column]:
        _, columns = self.project(child, intent)
        columns += [F.col(f"{child.prefix}expanded__{n}").alias(n) for n in intent.expand]
        if not columns:
            raise FieldNotFoundError("nothing is selected of a relation", "$expand")
        return columns

    def _arrays(self, child: Frame, rel: Relation, intent: QueryIntent, out: str, parents: Frame | None) -> DataFrame:
        """One ordered array a parent key; paged within each parent."""
        key = f"{out}__key"
        child.df = child.df.withColumn(key, child.own(rel.remote))
        keys = None if parents is None else parents.df.select(parents.own(rel.local).alias(f"{key}s")).distinct()
        if rel.kind == "many":
            # the bridge is cut to the parents' keys before its pairs are made distinct and joined
            start, end = child.prefix + "__from", child.prefix + "__to"
            bridge = bridge_of(rel, child.prefix, keys)
            child.df = child.df.join(bridge, F.col(end) == F.col(key)).withColumn(key, F.col(start))
        elif keys is not None:
            child.df = child.df.join(keys, F.col(key) == F.col(f"{key}s"), "left_semi")
        order = order_columns(child, intent.orderby, complete=True)
        rank = f"{out}__rank"
        child.df = child.df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        skip = intent.skip or 0
        if skip or intent.top is not None:
            child.df = child.df.where(F.col(rank) > skip)
            child.df = child.df if intent.top is None else child.df.where(F.col(rank) <= skip + intent.top)
        self._children(child, intent, semi=parents is not None or intent.filter is not None or skip > 0 or intent.top is not None)
        item = F.struct(F.col(rank).alias("r"), F.struct(*self._columns(child, intent)).alias("v"))
        grouped = child.df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(out))
        return grouped.withColumn(out, F.transform(out, lambda x: x["v"]))


def validate(policy: Policy, entity: EntityDef, catalog: Catalog, intent: QueryIntent, depth: int = 0) -> None:
    """What can be said without columns: expandable relations, private names, depth."""
    if depth > MAX_DEPTH:
        raise QueryError(f"relations nest at most {MAX_DEPTH} deep", "$expand")
    for name in intent.select or ():
        protected(split_path(name))
    for name, nested in intent.expand.items():
        behind = policy.relation(name)
        rel = entity.relations.get(policy.aliases.get(name, name))
        if rel is None:
            raise InvalidFieldError(f"{name} is no relation", name)
        validate(behind or OPEN, catalog[rel.target], catalog, nested, depth + 1)
