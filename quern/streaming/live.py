"""The same filters and projections over a stream of rows. An extension: the query language itself knows no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalog import OPEN, Catalog, EntityDef, Policy
from ..errors import QueryError
from ..lang import options
from ..operators.collections import Nested


def stream_query(stream: DataFrame, query: str, policy: Policy = OPEN) -> DataFrame:
    """A streaming DataFrame with a query's $filter and $select. Order, pages and relations need all rows and are refused."""
    intent = options.intent_of(query)
    if intent.orderby or intent.top is not None or intent.skip is not None or intent.expand or intent.apply:
        raise QueryError("a stream takes $filter and $select only")
    entity = EntityDef("stream", lambda: stream, ())
    return Nested(Catalog([entity])).rows(entity, policy, intent)
