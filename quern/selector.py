"""The facade: an entity with a policy, asked by text, dict, builder or intent."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any, TypeVar

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .catalog import OPEN, Catalog, Policy
from .errors import InvalidValueError, QueryError
from .fluent import QueryBuilder
from .intent import QueryIntent, bounded
from .lang import ast as A
from .lang import options
from .operators.aggregation import run_stages
from .operators.collections import Nested, validate
from .operators.predicates import Frame
from .shapes import to_object

T = TypeVar("T")
Query = str | Mapping[str, Any] | QueryBuilder | QueryIntent | None


class Selector:
    """query() and execute() are lazy and unbounded; what collects is bounded by the policy's page. base_df is the scope that a call is confined to."""

    def __init__(self, catalog: Catalog, entity: str, policy: Policy = OPEN) -> None:
        self.catalog, self.entity, self.policy = catalog, catalog[entity], policy

    def intent(self, query: Query) -> QueryIntent:
        out = query if isinstance(query, QueryIntent) else query.build() if isinstance(query, QueryBuilder) else options.intent_of(query)
        if out.apply and (out.filter is not None or out.select is not None or out.expand or out.orderby or out.top is not None or out.skip is not None):
            raise QueryError("$apply goes with no other option", "$apply")
        validate(self.policy, self.entity, self.catalog, out)
        return out

    def query(self, query: Query = None, base_df: DataFrame | None = None) -> DataFrame:
        intent = self.intent(query)
        if intent.apply:
            return run_stages(self.catalog, self.entity, self.policy, intent.apply, base_df)
        return Nested(self.catalog).rows(self.entity, self.policy, intent, base_df)

    execute = query

    def page(self, query: Query = None, base_df: DataFrame | None = None) -> DataFrame:
        """As query(), with the default order and a bounded page; an aggregation is whole, but one of filters alone is a page too."""
        intent = self.intent(query)
        if intent.apply:
            if not all(isinstance(s, A.FilterStage) for s in intent.apply):
                return self.query(intent, base_df)
            condition = intent.apply[0].condition
            for s in intent.apply[1:]:
                condition = A.BoolOp("and", condition, s.condition)
            intent = QueryIntent(filter=condition)
        return self.query(bounded(intent, self.policy.default_order, self.policy.default_top, self.policy.max_top), base_df)

    def get_many(self, query: Query = None, base_df: DataFrame | None = None) -> list[Row]:
        return self.page(query, base_df).collect()

    def query_as_dicts(self, query: Query = None, base_df: DataFrame | None = None) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.get_many(query, base_df)]

    get_many_dicts = query_as_dicts

    def query_as_objects(self, shape: type[T], query: Query = None, base_df: DataFrame | None = None) -> list[T]:
        """Rows as objects of a dataclass; fields that weren't selected are UNSET."""
        return [to_object(shape, r) for r in self.query_as_dicts(query, base_df)]

    def get_one(self, query: Query = None, base_df: DataFrame | None = None) -> Row | None:
        rows = self.page(replace(self.intent(query), top=1), base_df).collect()
        return rows[0] if rows else None

    def get_by_pk(self, value: Any, query: Query = None, base_df: DataFrame | None = None) -> Row | None:
        """The row of a key, which the filter policy doesn't concern; a key of several columns is a tuple."""
        df = self.entity.source() if base_df is None else base_df
        values = value if isinstance(value, tuple) else (value,)
        if len(values) != len(self.entity.pk):
            raise InvalidValueError(f"the key is {', '.join(self.entity.pk) or 'unknown'}", "pk")
        for name, v in zip(self.entity.pk, values, strict=True):
            df = df.where(F.col(name) == F.lit(v).try_cast(df.schema[name].dataType))
        rows = self.query(replace(self.intent(query), filter=None, orderby=(), top=None, skip=None), df).limit(1).collect()
        return rows[0] if rows else None

    def _filtered(self, intent: QueryIntent, base_df: DataFrame | None) -> DataFrame:
        frame = Frame(self.catalog, self.entity, self.policy, base_df)
        if intent.filter is not None:
            frame.where(intent.filter)
        return frame.df

    def count_by(self, query: Query = None, base_df: DataFrame | None = None) -> int:
        """Rows of the filter, whatever the page, fields and relations."""
        return self._filtered(self.intent(query), base_df).count()

    def count_df(self, query: Query = None, base_df: DataFrame | None = None) -> DataFrame:
        return self._filtered(self.intent(query), base_df).agg(F.count(F.lit(1)).alias("count"))

    def exists_by(self, query: Query = None, base_df: DataFrame | None = None) -> bool:
        intent = self.intent(query)
        df = self._filtered(intent, base_df)
        df = df.offset(intent.skip) if intent.skip else df
        return bool(df.limit(1 if intent.top is None else min(intent.top, 1)).count())
