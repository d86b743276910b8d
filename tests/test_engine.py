"""Meaning on small tables with nulls, missing targets and empty collections, which the driver's tables don't have."""

from dataclasses import dataclass, field, replace
from decimal import Decimal

from urllib.parse import parse_qsl

import pytest
from pyspark.sql import functions as F

from quern import envelope, metadata
from quern.catalog import Catalog, EntityDef, Policy, Relation, RelationAggregate
from quern.errors import FieldNotFoundError, InvalidFieldError, InvalidValueError, QueryError, TypeMismatchError, UnsupportedFunctionError
from quern.fluent import Expand, Field, OrderBy, QueryBuilder
from quern.lang import ast as A
from quern.selector import Selector
from quern.shapes import UNSET, dict_type, to_json
from quern.streaming.live import stream_query


@pytest.fixture(scope="module")
def catalog(spark):
    item = spark.createDataFrame([(1, "ann", Decimal("4.50"), 7, True, 10, "x"), (2, None, None, 0, False, None, "y"), (3, "it's 50%_\\", Decimal("3.00"), -7, True, 99, "z"), (4, "", Decimal("5.00"), 2, None, 10, "w")], "id long, name string, rating decimal(3,2), n int, active boolean, target_id long, password string")
    target = spark.createDataFrame([(10, "T", None), (11, "U", 10)], "id long, code string, parent_id long")
    child = spark.createDataFrame([(1, 1, 5), (2, 1, 3), (3, 1, None), (4, 2, 9)], "id long, item_id long, score int")
    tag = spark.createDataFrame([(100, "A"), (101, "Z")], "id long, label string")
    bridge = spark.createDataFrame([(1, 100), (1, 100), (1, 101), (2, 101)], "item_id long, tag_id long")
    return Catalog(
        [
            EntityDef("item", lambda: item, ("id",), {"target": Relation("forward", "target", "target_id", "id"), "children": Relation("reverse", "child", "id", "item_id"), "tags": Relation("many", "tag", "id", "id", lambda: bridge, "item_id", "tag_id")}),
            EntityDef("target", lambda: target, ("id",), {"parent": Relation("forward", "target", "parent_id", "id"), "items": Relation("reverse", "item", "id", "target_id")}),
            EntityDef("child", lambda: child, ("id",), {"item": Relation("forward", "item", "item_id", "id")}),
            EntityDef("tag", lambda: tag, ("id",), {}),
        ],
        "Test",
    )


@pytest.fixture
def ids(catalog):
    return lambda condition, entity="item", policy=Policy(): sorted(r["id"] for r in Selector(catalog, entity, policy).query({"$filter": condition, "$select": "id"}).collect())


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ("name ne 'ann'", [3, 4]),
        ("name eq null", [2]),
        ("not (rating gt 4)", [3]),
        ("rating eq 4.5", [1]),
        ("active", [1, 3]),
        ("not active", [2]),
        ("active eq true or name eq ''", [1, 3, 4]),
        ("n div 2 eq -3", [3]),
        ("n mod 3 eq -1", [3]),
        ("7 div n eq 1", [1]),
        ("n div 0 eq 1", []),
        ("contains(name, '%_\\')", [3]),
        ("concat(name, 'x') eq 'x'", [2, 4]),
        ("name eq 'it''s 50%_\\'", [3]),
        ("target/code eq 'T'", [1, 4]),
        ("target/code eq null", [2, 3]),
        ("children/any()", [1, 2]),
        ("children/any(c: c/score gt 4)", [1, 2]),
        ("children/all(c: c/score gt 4)", [2, 3, 4]),
        ("children/all(c: c/score gt 2)", [1, 2, 3, 4]),
        ("tags/any(t: t/label eq 'A')", [1]),
        ("not tags/any()", [3, 4]),
        ("id in (1, 3)", [1, 3]),
        ("children/score gt 2", [1, 1, 2]),
        ("-n gt 0", [3]),
    ],
)
def test_filters(ids, condition, want):
    assert ids(condition) == want


def test_lambda_over_two_steps_and_self(ids):
    assert ids("items/children/any(c: c/score eq 3)", "target") == [10]
    assert ids("items/children/all(c: c/score lt 4)", "target") == [11]
    assert ids("parent/code eq 'T'", "target") == [11]


@pytest.mark.parametrize(
    ("condition", "error"),
    [
        ("nope eq 1", FieldNotFoundError),
        ("name eq 1", TypeMismatchError),
        ("n eq 'x'", TypeMismatchError),
        ("n gt null", TypeMismatchError),
        ("null eq n", TypeMismatchError),
        ("n in (1, null)", TypeMismatchError),
        ("name and active", TypeMismatchError),
        ("name", TypeMismatchError),
        ("password eq 'x'", InvalidFieldError),
        ("target/_x eq 1", InvalidFieldError),
        ("children/any(c: c/item/password eq 'x')", InvalidFieldError),
        ("name/any()", FieldNotFoundError),
        ("matchesPattern(name, '(')", InvalidValueError),
        (f"matchesPattern(name, '{'a' * 257}')", InvalidValueError),
        ("contains(name, name)", QueryError),
        ("n eq 2023-02-30", InvalidValueError),
    ],
)
def test_bad_filters(ids, condition, error):
    with pytest.raises(error):
        ids(condition)


def test_policy(catalog):
    ask = lambda q, **p: Selector(catalog, "item", Policy(**p)).query(q)
    for query, policy in [
        ({"$filter": "n eq 1"}, {"filterable": ("name",)}),
        ({"$filter": "n eq 1"}, {"filterable": ()}),
        ({"$filter": "target/code eq 'T'"}, {"not_filterable": ("target",)}),
        ({"$orderby": "n"}, {"sortable": ("id",)}),
        ({"$orderby": "n"}, {"not_sortable": ("n",)}),
        ({"$select": "n"}, {"allowed_fields": ("id",)}),
        ({"$expand": "target"}, {"expandable": {}}),
        ({"$expand": "name"}, {}),
        ({"$select": "password"}, {}),
    ]:
        with pytest.raises(QueryError):
            ask(query, **policy)
    assert ask(None).columns == ["id", "name", "rating", "n", "active", "target_id"]
    assert ask(None, allowed_fields=("id", "n")).columns == ["id", "n"]
    assert Selector(catalog, "item", Policy(filterable=())).get_by_pk("3")["n"] == -7
    assert Selector(catalog, "item").get_by_pk("x") is None
    with pytest.raises(ValueError):
        Policy(aliases={"a b": "n"})


def test_nested(catalog):
    s = Selector(catalog, "item")
    rows = {r["id"]: r for r in s.query("$select=id&$expand=target($select=code),children($select=score;$orderby=score desc),tags($orderby=label desc)").collect()}
    assert rows[1]["target"]["code"] == "T" and rows[2]["target"] is None and rows[3]["target"] is None
    assert [c["score"] for c in rows[1]["children"]] == [5, 3, None] and rows[3]["children"] == []
    assert [t["label"] for t in rows[1]["tags"]] == ["Z", "A"] and rows[4]["tags"] == []
    paged = {r["id"]: r for r in s.query("$select=id&$expand=children($select=id;$orderby=score desc;$skip=1;$top=1)").collect()}
    assert [c["id"] for c in paged[1]["children"]] == [2] and paged[2]["children"] == []
    only = {r["id"]: r["target"] for r in s.query("$select=id&$expand=target($filter=code eq 'X')").collect()}
    assert set(only) == {1, 2, 3, 4} and not any(only.values())
    deep = Selector(catalog, "child").query("$select=id&$expand=item($select=name;$expand=tags($select=label))&$orderby=id&$top=1").collect()
    assert [t["label"] for t in deep[0]["item"]["tags"]] == ["A", "Z"]
    with pytest.raises(QueryError):
        s.query("$expand=target($top=1)")
    text = s.query("$select=id&$orderby=id&$expand=children($select=id;$filter=score gt 3;$orderby=id)").collect()
    built = s.query(QueryBuilder().select(Field("id")).orderby(OrderBy("id")).expand(Expand("children").select("id").filter(Field("score").gt(3)).orderby("id"))).collect()
    assert text == built


def test_pages_counts_and_lazy(catalog, spark):
    s = Selector(catalog, "item", Policy(default_order=("-id",), default_top=2, max_top=3))
    assert [r["id"] for r in s.get_many()] == [4, 3]
    assert len(s.get_many("$top=100")) == 3 and len(s.get_many("$skip=1")) == 2 and s.get_many("$top=0") == []
    assert s.query("$top=100").count() == 4
    assert s.count_by("$filter=n gt 0&$top=1") == 2 and s.exists_by("$filter=n gt 5") and not s.exists_by("$skip=9")
    assert s.get_one("$filter=n eq 2")["id"] == 4 and s.get_one("$filter=n eq 55") is None
    body = envelope.collection(s, "$select=id&$count=true")
    assert body["value"] == [{"id": 4}, {"id": 3}] and body["@odata.count"] == 4 and "$skip=2" in body["@odata.nextLink"]
    assert "@odata.nextLink" not in envelope.collection(s, "$select=id&$skip=3")
    built = QueryBuilder().filter("id gt 1").select(Field("id")).orderby(OrderBy("id")).top(2)
    body = envelope.collection(s, built)
    rest = envelope.collection(s, dict(parse_qsl(body["@odata.nextLink"].split("?")[1])))
    assert body["value"] + rest["value"] == [{"id": 2}, {"id": 3}, {"id": 4}]
    assert "@odata.nextLink" not in envelope.collection(s, QueryBuilder().where(Field("id").gt(1)).top(1))
    scope = catalog["item"].source().where("id < 3")
    assert [r["id"] for r in s.get_many("$select=id", scope)] == [2, 1] and s.count_by(None, scope) == 2
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    s.query("$filter=children/any(c: c/score gt 1)&$expand=tags,target&$orderby=n&$top=2")
    assert len(tracker.getJobIdsForGroup()) == before


def test_computed(catalog):
    policy = Policy(computed={"double": lambda n: n * 2, "word": lambda double, name: F.concat_ws("-", double, name), "kids": RelationAggregate("children", lambda: F.count(F.lit(1)))}, requires={"double": ["n"], "word": ["double", "who"]}, aliases={"who": "name"})
    policy = replace(policy, computed=dict(policy.computed) | {"word": lambda double, who: F.concat_ws("-", double, who)})
    s = Selector(catalog, "item", policy)
    assert [tuple(r) for r in s.query("$filter=double gt 3&$select=word,kids&$orderby=kids desc").collect()] == [("14-ann", 3), ("4-", 0)]
    with pytest.raises(QueryError):
        Selector(catalog, "item", Policy(computed={"a": lambda b: b, "b": lambda a: a}, requires={"a": ["b"], "b": ["a"]})).query("$select=a")


def test_apply(catalog):
    ask = lambda text, **p: sorted(map(tuple, Selector(catalog, "item", Policy(**p)).query({"$apply": text}).collect()), key=repr)
    assert ask("aggregate($count as n, rating with average as r, name with countdistinct as d)") == [(4, Decimal("4.166667"), 3)]
    assert ask("filter(n gt 1000)/aggregate($count as c, n with sum as s)") == [(0, None)]
    assert ask("groupby((active), aggregate(n with sum as s))/filter(s gt 0)") == [(None, 2)]
    assert ask("groupby((target/code))") == [("T",), (None,)]
    assert ask("groupby((big), aggregate(n with spread as s))", apply_keys={"big": lambda: F.col("n") > 0}, apply_aggregates={"spread": lambda c: F.max(c) - F.min(c)}) == [(False, 7), (True, 5)]
    for bad, error in [("aggregate(n with median as m)", UnsupportedFunctionError), ("groupby((zzz))", FieldNotFoundError), ("groupby((n), aggregate(n with sum as n))", QueryError)]:
        with pytest.raises(error):
            ask(bad)
    with pytest.raises(QueryError):
        Selector(catalog, "item").query({"$apply": "aggregate($count as n)", "$top": "1"})
    assert len(Selector(catalog, "item").query_as_dicts({"$apply": "filter(n gt 0)/filter(n gt 1)"})) == 2


def test_visitor_and_registry(catalog, ids):
    from quern.functions import scalar
    from quern.lang import filters

    filters.ARITY["twice"] = (1, 1)
    scalar.REGISTRY["twice"] = (("num",), "num", lambda x: x * 2)
    try:
        assert ids("twice(n) eq 14") == [1]
    finally:
        del filters.ARITY["twice"], scalar.REGISTRY["twice"]

    class Upper(A.NodeTransformer):
        def visit_Identifier(self, node):
            return A.Identifier(node.name.upper())

    assert Upper().visit(filters.parse_filter("a eq 1 and b eq 2")) == filters.parse_filter("A eq 1 and B eq 2")


def test_metadata_and_errors(catalog):
    s = {"items": Selector(catalog, "item", Policy(filterable=("n",))), "targets": Selector(catalog, "target")}
    xml = metadata.edmx(s, "Test")
    assert 'Name="rating" Type="Edm.Decimal"' in xml and "password" not in xml and 'Type="Test.target"' in xml and 'Type="Collection(Test.item)"' in xml and "FilterRestrictions" in xml
    assert [v["name"] for v in metadata.service_document(s)["value"]] == ["items", "targets"]
    body = envelope.error(QueryError("m" * 600, expression="e" * 300), "$filter=a eq 1 $top=2")["error"]
    assert len(body["message"]) == 512 and len(body["details"][0]["message"]) == 256
    assert [p["name"] for p in envelope.parameters(detail=True)] == ["$select", "$expand"] and len(envelope.parameters()) == 7


def test_stream(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
    out = stream_query(stream, "$filter=n mod 3 eq 1&$select=n")
    q = out.writeStream.format("memory").queryName("live_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("live_rows").collect()) == [1, 4, 7]
    with pytest.raises(QueryError):
        stream_query(stream, "$orderby=n")


@dataclass
class Tag:
    label: str


@dataclass
class Target:
    code: str
    parent_id: int | None


@dataclass
class Item:
    _excluded_fields = ("rating",)
    id: int
    name: str | None
    rating: Decimal | None
    target: Target | None
    tags: list[Tag] | None
    n: int = field(default=0, metadata={"write_only": True})


def test_objects(catalog):
    found = Selector(catalog, "item").query_as_objects(Item, "$select=id,rating,n&$expand=tags,target($select=code)&$orderby=id&$top=2")
    assert found[0] == Item(1, UNSET, Decimal("4.50"), Target("T", UNSET), [Tag("A"), Tag("Z")], 7)
    assert found[1].target is None and found[1].name is UNSET
    assert to_json(found) == [{"id": 1, "target": {"code": "T"}, "tags": [{"label": "A"}, {"label": "Z"}]}, {"id": 2, "target": None, "tags": [{"label": "Z"}]}]
    assert dict_type(Item).__annotations__["tags"].__args__[0].__name__ == "TagDict" and not dict_type(Item).__required_keys__
