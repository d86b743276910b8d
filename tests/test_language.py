"""Texts to trees and intents."""

from __future__ import annotations

import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.errors import ArgumentCountException, InvalidValueError, ODataSyntaxError, ParsingException, QueryError, TokenizingException, UnknownFunctionException
from quern.fluent import Expand, Field, OrderBy, QueryBuilder
from quern.intent import OrderKey, QueryIntent, bounded
from quern.lang import ast as A
from quern.lang.filters import parse_filter
from quern.lang.options import apply, intent_of


def test_precedence():
    assert parse_filter("a eq 1 or b eq 2 and c eq 3") == A.BoolOp("or", A.Compare("eq", A.Identifier("a"), A.Integer("1")), A.BoolOp("and", A.Compare("eq", A.Identifier("b"), A.Integer("2")), A.Compare("eq", A.Identifier("c"), A.Integer("3"))))
    assert parse_filter("a add 2 mul 3 gt 4") == A.Compare("gt", A.BinOp("add", A.Identifier("a"), A.BinOp("mul", A.Integer("2"), A.Integer("3"))), A.Integer("4"))
    assert parse_filter("not a eq 1") == A.Compare("eq", A.UnaryOp("not", A.Identifier("a")), A.Integer("1"))
    assert parse_filter("not(a eq 1)") == A.UnaryOp("not", A.Compare("eq", A.Identifier("a"), A.Integer("1")))
    assert parse_filter("A EQ 1 AND B Ne 2").op == "and"


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("'it''s'", A.String("it's")),
        ("-5", A.Integer("-5")),
        ("1.5e3", A.Float("1.5e3")),
        ("TRUE", A.Boolean("TRUE")),
        ("2024-02-29", A.Date("2024-02-29")),
        ("2024-02-29T10:00Z", A.DateTime("2024-02-29T10:00Z")),
        ("10:00:01", A.Time("10:00:01")),
        ("duration'P1DT2H'", A.Duration("P1DT2H")),
        ("0f8fad5b-d9cb-469f-a165-70867728950e", A.Guid("0f8fad5b-d9cb-469f-a165-70867728950e")),
    ],
)
def test_literals(text, node):
    assert parse_filter(f"x eq {text}").right == node


def test_names_like_keywords_are_names():
    for name in ("allowed", "nullable", "anything", "trueish", "order", "notes", "android"):
        assert parse_filter(f"{name} eq 1").left == A.Identifier(name)


def test_paths_lists_and_lambdas():
    assert parse_filter("a.b/c eq 1").left == A.Attribute(A.Attribute(A.Identifier("a"), "b"), "c")
    assert parse_filter("x in ('a')") == parse_filter("x in ('a',)")
    assert parse_filter("a/b/c/any()") == A.CollectionLambda(A.path_node(("a", "b", "c")), "any")
    inner = parse_filter("a/any(x: x/b/any(y: y/c eq x/d))")
    assert A.without_variable(inner.body, "x").owner == A.Identifier("b")


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("a eq", ParsingException),
        ("a eq 1 b", ParsingException),
        ("(a eq 1", ParsingException),
        ("a eq #", TokenizingException),
        ("f(a) eq 1", UnknownFunctionException),
        ("geo.distance(a,b) lt 1", UnknownFunctionException),
        ("length(a,b) eq 1", ArgumentCountException),
        ("a/all()", ParsingException),
        (f"{'a' * 129} eq 1", TokenizingException),
        ("a eq 1" + " " * 4000, ODataSyntaxError),
    ],
)
def test_errors(text, error):
    with pytest.raises(error):
        parse_filter(text)


@given(st.text(max_size=60))
def test_any_text_gives_a_tree_or_a_query_error(text):
    try:
        parse_filter(text)
    except QueryError:
        pass


@given(st.text())
def test_strings_round_trip(text):
    quoted = text.replace("'", "''")
    try:
        assert parse_filter(f"x eq '{quoted}'").right == A.String(text)
    except ODataSyntaxError:
        assert len(quoted) > 3900


def test_bad_dates_fail_when_read():
    node = parse_filter("x eq 2023-02-30").right
    with pytest.raises(InvalidValueError):
        node.value  # noqa: B018
    assert A.Duration("P1Y").value == timedelta(days=365.25)
    assert A.Date("2024-02-29").value == date(2024, 2, 29)


def test_options():
    i = intent_of("?$filter=name%20eq%20'a%26b'&$select=a, b&$orderby=a desc,b/c&$top=5&$skip=2&$count=TRUE&$top=7&x=1")
    assert (i.select, i.orderby, i.top, i.skip, i.count) == (("a", "b"), (OrderKey("a", True), OrderKey("b/c")), 7, 2, True)
    assert i.filter.right == A.String("a&b")
    assert intent_of(None) == intent_of("") == QueryIntent()
    assert intent_of({"$top": ""}).top is None
    assert not intent_of("$count=yes").count


@pytest.mark.parametrize("query", ["$top=-1", "$top=10001", "$skip=1000001", "$top=x"])
def test_bounds(query):
    with pytest.raises(InvalidValueError):
        intent_of(query)


def test_expand_options():
    i = intent_of("$expand=a($select=x,y;$filter=n eq ';)';$top=2;$expand=b($orderby=z desc);select=q),c")
    assert set(i.expand) == {"a", "c"}
    assert i.expand["a"].select == ("x", "y") and i.expand["a"].top == 2
    assert i.expand["a"].expand["b"].orderby == (OrderKey("z", True),)
    with pytest.raises(QueryError):
        intent_of("$expand=a($select=x")


def test_apply():
    stages = apply("filter(a eq ')/(')/groupby((b,c/d), aggregate(e with sum as f, $count as n))/filter(f gt 1)")
    assert stages[1] == A.GroupByStage(("b", "c/d"), (A.Aggregate("e", "sum", "f"), A.Aggregate(None, "count", "n")))
    for bad in ("", "groupby(())", "aggregate()", "top(1)", "aggregate($count as n)/filter(n gt 1)", "filter()"):
        with pytest.raises(QueryError):
            apply(bad)


def test_builder_equals_text():
    built = QueryBuilder().where((Field("a").eq(1) & Field("b").c.contains("x")) | ~Field("d").is_null()).select(Field("a"), Field("b").c).orderby(OrderBy("a").desc()).top(3).skip(1).count().expand(Expand("r").select("x").filter("x gt 1").orderby("x desc").top(2)).build()
    text = intent_of("$filter=(a eq 1 and contains(b/c,'x')) or not (d eq null)&$select=a,b/c&$orderby=a desc&$top=3&$skip=1&$count=true&$expand=r($select=x;$filter=x gt 1;$orderby=x desc;$top=2)")
    assert built == text
    assert QueryBuilder("$filter=a eq 1&$select=a&$top=2").and_filter("b eq 2").build() == intent_of("$filter=(a eq 1) and (b eq 2)&$select=a&$top=2")
    assert QueryBuilder().filter("a eq 1").select("a").query_string() == "$filter=a+eq+1&$select=a"
    with pytest.raises(ValueError):
        QueryBuilder().where(Field("a").eq(1)).to_dict()
    with pytest.raises(TypeError):
        QueryBuilder().select("a", Field("b"))
    with pytest.raises(AttributeError):
        Field("a")._x  # noqa: B018
    assert Field("a").eq(1) == Field("a").eq(1) and hash(Field("a").eq(1)) == hash(Field("a").eq(1))


def test_builder_gives_detached_intents():
    b = QueryBuilder().select("a")
    first = b.build()
    b.select("b").top(1)
    assert first.select == ("a",) and first.top is None


def test_bounded():
    i = bounded(QueryIntent(), ("-a", "b"), 100, 500)
    assert i.orderby == (OrderKey("a", True), OrderKey("b")) and i.top == 100
    assert bounded(QueryIntent(top=9000), (), 100, 500).top == 500 and bounded(QueryIntent(top=0), (), 100, 500).top == 0


def test_language_needs_no_spark():
    code = "import sys; sys.modules['pyspark']=None; import quern.lang.filters, quern.lang.options, quern.intent, quern.fluent, quern.errors"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
