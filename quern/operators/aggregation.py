"""$apply: stages folded over a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, EntityDef, Policy
from ..errors import FieldNotFoundError, QueryError, UnsupportedFunctionError
from ..lang import ast as A
from .predicates import Frame

METHODS = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "countdistinct": F.count_distinct}


def _aggregate(frame: Frame, a: A.Aggregate) -> Column:
    policy = frame.policy
    source = None
    if a.source is not None:
        source = frame.field(policy.check(a.source.split("/")))[0]
    if a.method == "count":
        out = F.count(F.lit(1))
    elif a.method in policy.apply_aggregates:
        if source is None:
            raise QueryError(f"{a.method} needs a field", "$apply")
        out = policy.apply_aggregates[a.method](source)
    elif a.method == "countdistinct":
        out = F.count_distinct(*([frame.own(c) for c in frame.entity.pk or frame.fields] if source is None else [source]))
    elif a.method in METHODS:
        if source is None:
            raise QueryError(f"{a.method} needs a field", "$apply")
        out = METHODS[a.method](source)
    else:
        raise UnsupportedFunctionError(f"unsupported aggregate method {a.method}", "$apply")
    return out.alias(a.alias)


def _group(frame: Frame, stage: A.GroupByStage) -> DataFrame:
    keys = []
    for name in stage.fields:
        out = name.replace("/", "_")
        if name in frame.policy.apply_keys:
            keys.append((frame.policy.apply_keys[name], out))
            continue
        column, _ = frame.field(frame.policy.check(name.split("/")))
        keys.append((column, out))
    aggregates = [_aggregate(frame, a) for a in stage.aggregates]
    if len({n for _, n in keys} | {a.alias for a in stage.aggregates}) < len(keys) + len(stage.aggregates):
        raise QueryError("two output columns have one name", "$apply")
    df = frame.df
    made = []
    for key, out in keys:
        if callable(key):
            # a named bucket speaks of the entity's columns by their own names
            df = df.withColumns({c: frame.own(c) for c in frame.fields}).withColumn(f"{frame.prefix}key__{out}", key()).drop(*frame.fields)
            made.append(F.col(f"{frame.prefix}key__{out}").alias(out))
        else:
            made.append(key.alias(out))
    return df.groupBy(*made).agg(*aggregates) if aggregates else df.select(*made).distinct()


def run_stages(catalog: Catalog, entity: EntityDef, policy: Policy, stages: Sequence[A.Node], df: DataFrame | None = None) -> DataFrame:
    """The result of an $apply pipeline. After a group the rows are what it gave, so a later filter acts on its names, and a later group on its groups."""
    frame, grouped = Frame(catalog, entity, policy, df), False
    for stage in stages:
        if isinstance(stage, A.FilterStage):
            frame.where(stage.condition)
        elif isinstance(stage, A.AggregateStage):
            return frame.df.agg(*[_aggregate(frame, a) for a in stage.aggregates])
        elif isinstance(stage, A.GroupByStage):
            if grouped and (unknown := [f for f in stage.fields if f.replace("/", "_") not in frame.fields]):
                raise FieldNotFoundError(f"no field {unknown[0]} after the group before", unknown[0])
            out = _group(frame, stage)
            inner = replace(policy, allowed_fields=None, filterable=None, not_filterable=(), aliases={}, computed={}, apply_keys={})
            frame, grouped = Frame(catalog, EntityDef(entity.name, lambda: out, (), {}), inner, out), True
    return frame.df.select(*[frame.own(c).alias(c) for c in frame.fields])
