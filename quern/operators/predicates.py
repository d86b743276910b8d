"""Filter trees as Columns. Paths become left joins added to the frame once each; any and all become EXISTS subqueries."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import OPEN, Catalog, EntityDef, Policy, Relation, RelationAggregate
from ..errors import ArgumentTypeException, FieldNotFoundError, InvalidFieldError, TypeMismatchError, UnsupportedFunctionError
from ..functions import scalar
from ..intent import MAX_DEPTH
from ..lang import ast as A

_fresh = itertools.count()

KINDS = {T.StringType: "str", T.BooleanType: "bool", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DayTimeIntervalType: "duration"}
LITERAL_KINDS = {A.Boolean: "bool", A.Integer: "num", A.Float: "num", A.String: "str", A.Guid: "str", A.Date: "date", A.DateTime: "datetime", A.Time: "time", A.Duration: "duration"}


def kind_of(t: T.DataType) -> str:
    return "num" if isinstance(t, T.NumericType) else KINDS.get(type(t), "any")


@dataclass
class Value:
    """A Column with what is known of it. predicate: it is a condition and not a mere value."""

    column: Column
    kind: str
    type: T.DataType | None = None
    predicate: bool = False
    integral: bool = False


class Frame:
    """An entity's rows, and the columns that paths from them lead to.

    The entity's own columns are called prefix + name in `df`; a relation's, once joined, have a prefix of their own. So no two are confused, however
    often an entity is joined.
    """

    def __init__(self, catalog: Catalog, entity: EntityDef, policy: Policy = OPEN, df: DataFrame | None = None) -> None:
        self.catalog, self.entity, self.policy = catalog, entity, policy
        base = entity.source() if df is None else df
        self.prefix = f"__e{next(_fresh)}__"
        self.fields = list(base.columns)
        self.df = base.select(*[F.col(f"`{c}`").alias(self.prefix + c) for c in base.columns])
        self.joined: dict[tuple[str, ...], tuple[EntityDef, str, list[str]]] = {(): (entity, self.prefix, self.fields)}
        self.types = {f.name: f.dataType for f in self.df.schema.fields}
        self.made: dict[str, str] = {}

    def own(self, name: str) -> Column:
        return F.col(self.prefix + name)

    def relation(self, path: tuple[str, ...], name: str) -> Relation | None:
        return self.joined[path][0].relations.get(name)

    def join(self, path: tuple[str, ...]) -> tuple[EntityDef, str, list[str]]:
        """The entity a path of relations leads to, joined from the left; a to-many step multiplies rows."""
        if path in self.joined:
            return self.joined[path]
        if len(path) > MAX_DEPTH:
            raise InvalidFieldError(f"a path has at most {MAX_DEPTH} relations", "/".join(path))
        entity, prefix, _ = self.join(path[:-1])
        rel = entity.relations.get(path[-1])
        if rel is None:
            raise FieldNotFoundError(f"no relation {'/'.join(path)}", "/".join(path))
        target, new = self.catalog[rel.target], f"__e{next(_fresh)}__"
        other = target.source()
        names = list(other.columns)
        other = other.select(*[F.col(f"`{c}`").alias(new + c) for c in names])
        local = prefix + rel.local
        if rel.kind == "many":
            bridge = bridge_of(rel, new)
            self.df = self.df.join(bridge, F.col(local) == F.col(new + "__from"), "left").join(other, F.col(new + "__to") == F.col(new + rel.remote), "left")
        else:
            self.df = self.df.join(other, F.col(local) == F.col(new + rel.remote), "left")
        self.types |= {f.name: f.dataType for f in other.schema.fields}
        self.joined[path] = (target, new, names)
        return self.joined[path]

    def field(self, names: tuple[str, ...]) -> tuple[Column, T.DataType]:
        """The column at a real path; relations on the way are joined, computed columns made."""
        if len(names) == 1 and (names[0] in self.policy.computed or names[0] in self.made):
            internal = self.compute(names[0])
            return F.col(internal), self.types[internal]
        if names == ("pk",) and "pk" not in self.fields and len(self.entity.pk) == 1:
            names = self.entity.pk
        _, prefix, known = self.join(names[:-1])
        if names[-1] not in known:
            raise FieldNotFoundError(f"no field {'/'.join(names)}", "/".join(names))
        return F.col(prefix + names[-1]), self.types[prefix + names[-1]]

    def compute(self, name: str, depth: int = 0) -> str:
        """The internal name of a computed column, made on first use after those it requires."""
        if name in self.made:
            return self.made[name]
        if depth >= MAX_DEPTH:
            raise InvalidFieldError(f"computed columns require one another more than {MAX_DEPTH} deep", name)
        needed = {n: F.col(self.compute(n, depth + 1)) if n in self.policy.computed else self.field(self.policy.real(n.replace(".", "/").split("/")))[0] for n in self.policy.requires.get(name, ())}
        rule, internal = self.policy.computed[name], f"{self.prefix}computed__{name}"
        if isinstance(rule, RelationAggregate):
            self._aggregate(rule, internal)
        else:
            self.df = self.df.withColumn(internal, rule(**needed))
        self.types[internal] = self.df.schema[internal].dataType
        self.made[name] = internal
        return internal

    def _aggregate(self, rule: RelationAggregate, internal: str) -> None:
        rel = self.entity.relations[rule.relation]
        child, key = self.catalog[rel.target].source(), f"{internal}__key"
        if rel.kind == "many":
            child = child.join(bridge_of(rel, ""), F.col("__to") == child[rel.remote]).withColumn(key, F.col("__from"))
        else:
            child = child.withColumn(key, F.col(rel.remote))
        totals = child.groupBy(key).agg(rule.aggregate().alias(internal))
        self.df = self.df.join(totals, self.own(rel.local) == F.col(key), "left").drop(key)
        if rule.missing is not None:
            self.df = self.df.withColumn(internal, F.coalesce(internal, F.lit(rule.missing)))

    def where(self, node: A.Node) -> None:
        condition = Compiler(self).condition(node)
        self.df = self.df.where(condition)


def bridge_of(rel: Relation, prefix: str, keys: DataFrame | None = None) -> DataFrame:
    """The distinct pairs of a bridge, as prefix__from and prefix__to; keys: only pairs that start at a value of this table's one column."""
    pairs = rel.bridge().select(F.col(rel.bridge_local).alias(prefix + "__from"), F.col(rel.bridge_remote).alias(prefix + "__to"))
    if keys is not None:
        pairs = pairs.join(keys, F.col(prefix + "__from") == F.col(keys.columns[0]), "left_semi")
    return pairs.distinct()


class Compiler(A.NodeVisitor):
    """Compiles one expression over a Frame."""

    def __init__(self, frame: Frame, use: str = "filter") -> None:
        self.frame, self.use = frame, use

    def generic_visit(self, node: A.Node) -> Value:
        raise TypeMismatchError(f"{type(node).__name__} can't stand here")

    def condition(self, node: A.Node) -> Column:
        """The whole expression as a condition; a boolean field by itself is one."""
        v = self.visit(node)
        if not v.predicate and v.kind != "bool":
            raise TypeMismatchError("the expression is no condition")
        return v.column

    def visit_Identifier(self, node: A.Identifier) -> Value:
        names = A.path_of(node)
        real = self.frame.policy.check(names, self.use)
        column, kind = self.frame.field(real)
        return Value(column, kind_of(kind), kind, integral=isinstance(kind, T.IntegralType))

    visit_Attribute = visit_Identifier

    def visit_Null(self, node: A.Null) -> Value:
        raise TypeMismatchError("null goes only to the right of eq and ne")

    def visit_Literal(self, node: A.Literal) -> Value:
        return self.literal(node, None)

    def literal(self, node: A.Literal, beside: T.DataType | None) -> Value:
        """A literal as it compares with a column of type `beside`."""
        v, kind = node.value, LITERAL_KINDS[type(node)]
        if isinstance(node, A.Float) and isinstance(beside, T.DecimalType):
            return Value(F.lit(node.exact), kind)
        if isinstance(node, A.Integer):
            big = not -(1 << 63) <= v < 1 << 63
            return Value(F.lit(Decimal(v) if big else v), kind, integral=True)
        if isinstance(node, A.Guid):
            return Value(F.lit(str(v)), kind)
        if isinstance(node, A.DateTime):
            zoned = isinstance(beside, T.TimestampType)
            text = node.utc.isoformat(sep=" ")
            return Value(F.lit(f"{text}Z" if zoned and v.tzinfo else text).cast("timestamp" if zoned else "timestamp_ntz"), kind)
        if isinstance(node, A.Time):
            return Value(F.lit(v.isoformat(timespec="microseconds")), kind)
        return Value(F.lit(v), kind)

    def pair(self, a: A.Node, b: A.Node) -> tuple[Value, Value]:
        """Both operands; a literal is read for the other's type."""
        if isinstance(a, A.Literal) and not isinstance(b, A.Literal):
            right = self.visit(b)
            self.visit(a) if isinstance(a, A.Null) else None
            return self.literal(a, right.type), right
        left = self.visit(a)
        if isinstance(b, A.Literal) and not isinstance(b, A.Null):
            return left, self.literal(b, left.type)
        return left, self.visit(b)

    @staticmethod
    def together(a: Value, b: Value, op: str) -> None:
        same = {"date": "moment", "datetime": "moment", "any": "any"}
        x, y = same.get(a.kind, a.kind), same.get(b.kind, b.kind)
        if "any" not in (x, y) and x != y and {x, y} != {"time", "str"}:
            raise TypeMismatchError(f"{op}: {a.kind} and {b.kind} don't compare")

    def visit_Compare(self, node: A.Compare) -> Value:
        if node.op == "in":
            left = self.visit(node.left)
            items = []
            for x in node.right.items if isinstance(node.right, A.List) else ():
                if not isinstance(x, A.Literal) or isinstance(x, A.Null):
                    raise TypeMismatchError("a list holds literals other than null")
                v = self.literal(x, left.type)
                self.together(left, v, "in")
                items.append(v.column)
            if not items:
                raise TypeMismatchError("in needs a list")
            return Value(left.column.isin(*items), "bool", predicate=True)
        if isinstance(node.right, A.Null):
            if node.op not in ("eq", "ne"):
                raise TypeMismatchError(f"{node.op} null")
            v = self.visit(node.left)
            return Value(v.column.isNull() if node.op == "eq" else v.column.isNotNull(), "bool", predicate=True)
        a, b = self.pair(node.left, node.right)
        self.together(a, b, node.op)
        x, y = a.column, b.column
        out = {"eq": lambda: x == y, "ne": lambda: x != y, "lt": lambda: x < y, "le": lambda: x <= y, "gt": lambda: x > y, "ge": lambda: x >= y}[node.op]()
        return Value(out, "bool", predicate=True)

    def visit_BoolOp(self, node: A.BoolOp) -> Value:
        a, b = self.visit(node.left), self.visit(node.right)
        if not a.predicate or not b.predicate:
            raise TypeMismatchError(f"{node.op} joins conditions; compare the field with true")
        return Value(a.column & b.column if node.op == "and" else a.column | b.column, "bool", predicate=True)

    def visit_UnaryOp(self, node: A.UnaryOp) -> Value:
        v = self.visit(node.operand)
        if node.op == "not":
            if not v.predicate and v.kind != "bool":
                raise TypeMismatchError("not negates a condition")
            return Value(~v.column, "bool", predicate=True)
        if v.kind not in ("num", "duration", "any"):
            raise TypeMismatchError(f"- of {v.kind}")
        return Value(-v.column, v.kind, v.type, integral=v.integral)

    def visit_BinOp(self, node: A.BinOp) -> Value:
        a, b = self.pair(node.left, node.right)
        moments = {"date", "datetime"}
        if not ({a.kind, b.kind} <= {"num", "any"} or node.op in ("add", "sub") and (a.kind in moments and b.kind in moments | {"duration", "any"} or a.kind == "duration" and b.kind in moments | {"duration"})):
            raise TypeMismatchError(f"{a.kind} {node.op} {b.kind}")
        x, y = a.column, b.column
        whole = a.integral and b.integral
        if node.op == "div":
            out = F.call_function("div", x, F.nullif(y, F.lit(0))) if whole else F.try_divide(x, y)
        elif node.op == "mod":
            out = F.try_mod(x, y)
        else:
            out = x + y if node.op == "add" else x - y if node.op == "sub" else x * y
        kind = a.kind if a.kind == b.kind == "num" else "num" if "num" in (a.kind, b.kind) else "any" if a.kind in moments and b.kind in moments else next((k for k in (a.kind, b.kind) if k in moments), "any")
        return Value(out, kind, integral=whole)

    def visit_Call(self, node: A.Call) -> Value:
        kinds, result, make = scalar.lookup(node.name)
        args = []
        for i, (arg, kind) in enumerate(zip(node.args, kinds, strict=False)):
            if isinstance(arg, A.NamedParam):
                raise UnsupportedFunctionError(f"{node.name} takes no named arguments", node.name)
            if i == 1 and node.name in scalar.NEEDS_TEXT:
                if not isinstance(arg, A.String):
                    raise ArgumentTypeException(f"{node.name} needs a string literal", node.name)
                if node.name == "matchespattern":
                    scalar.check_pattern(arg.text)
            v = self.visit(arg)
            if kind != "any" and v.kind not in ("any", kind) and not (kind == "moment" and v.kind in ("date", "datetime", "time")):
                raise TypeMismatchError(f"{node.name} of {v.kind}", node.name)
            args.append(v.column)
        integral = node.name in ("length", "indexof", "year", "month", "day", "hour", "minute", "second", "floor", "ceiling")
        return Value(make(*args), result, predicate=result == "bool", integral=integral)

    def visit_CollectionLambda(self, node: A.CollectionLambda) -> Value:
        names = A.path_of(node.owner)
        if not names:
            raise InvalidFieldError("any and all follow a relation")
        real = self.frame.policy.check(names, self.use)
        return Value(self.exists(self.frame, (), real, node), "bool", predicate=True)

    def exists(self, outer: Frame, path: tuple[str, ...], rest: tuple[str, ...], node: A.CollectionLambda) -> Column:
        """EXISTS over the relation rest[0]; of several steps the inner ones are EXISTS within, negated together for all."""
        rel = outer.entity.relations.get(rest[0])
        if rel is None:
            raise FieldNotFoundError(f"no relation {'/'.join(rest)}", "/".join(rest))
        child = Frame(self.frame.catalog, self.frame.catalog[rel.target], outer.policy.expandable.get(rest[0]) or OPEN if outer.policy.expandable else OPEN)
        condition = None
        if len(rest) > 1:
            condition = Compiler(child, self.use).exists(child, (), rest[1:], node)
        elif node.body is not None:
            body = Compiler(child, self.use).condition(A.without_variable(node.body, node.variable))
            condition = ~body if node.op == "all" else body
        key = child.own(rel.remote)
        if rel.kind == "many":
            bridge = bridge_of(rel, child.prefix)
            child.df = child.df.join(bridge, F.col(child.prefix + "__to") == key)
            key = F.col(child.prefix + "__from")
        linked = key == outer.own(rel.local).outer()
        if len(rest) > 1 and node.op == "all":
            # the inner step already says that all of its rows fit; here one that doesn't is looked for
            condition = ~condition
        found = child.df.where(linked if condition is None else linked & condition).exists()
        return ~found if node.op == "all" else found
