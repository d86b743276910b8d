"""Queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import OPEN, Policy, RelationAggregate
from ..fluent import Expand, Field, OrderBy, QueryBuilder
from ..selector import Query, Selector
from ..sources.tables import driver_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Shape = Callable[[DataFrame], DataFrame]


def add(name: str, entity: str, query: Query, sql: str | None, policy: Policy = OPEN, then: Shape | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = Selector(driver_catalog(spark, folder), entity, policy).query(query)
        return then(df) if then else df

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def filtered(name: str, entity: str, condition: str, columns: str, where: str) -> None:
    add(name, entity, {"$filter": condition, "$select": columns}, f"SELECT {columns} FROM {entity} WHERE {where}")


# scans, comparison, logic
add("flagship", "orders", {"$filter": "o_totalprice gt 100000 and o_orderstatus eq 'F'", "$select": "o_orderkey,o_totalprice", "$orderby": "o_totalprice desc,o_orderkey", "$top": "10"}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("scan_region", "region", None, "SELECT * FROM region")
add("select_star", "nation", {"$select": "*"}, "SELECT * FROM nation")
filtered("filter_eq", "orders", "o_orderstatus eq 'O'", "o_orderkey,o_custkey", "o_orderstatus = 'O'")
filtered("filter_ne", "orders", "o_orderpriority ne '1-URGENT'", "o_orderkey,o_orderpriority", "o_orderpriority <> '1-URGENT'")
filtered("filter_gt_le", "lineitem", "l_quantity gt 10 and l_quantity le 20", "l_orderkey,l_linenumber,l_quantity", "l_quantity > 10 AND l_quantity <= 20")
filtered("filter_ge_lt", "customer", "c_acctbal ge -100.5 and c_acctbal lt 1000", "c_custkey,c_acctbal", "c_acctbal >= -100.5 AND c_acctbal < 1000")
filtered("filter_or", "part", "p_size lt 5 or p_size gt 45", "p_partkey,p_size", "p_size < 5 OR p_size > 45")
filtered("filter_not", "orders", "not (o_orderstatus eq 'O' or o_totalprice lt 50000)", "o_orderkey,o_totalprice", "NOT (o_orderstatus = 'O' OR o_totalprice < 50000)")
filtered("filter_precedence", "part", "p_size eq 1 or p_size eq 2 and p_retailprice gt 1000", "p_partkey,p_size", "p_size = 1 OR (p_size = 2 AND p_retailprice > 1000)")
filtered("filter_in", "orders", "o_orderstatus in ('F', 'P')", "o_orderkey,o_orderstatus", "o_orderstatus IN ('F', 'P')")
filtered("filter_in_one", "nation", "n_nationkey in (3)", "n_nationkey,n_name", "n_nationkey IN (3)")
filtered("filter_eq_null", "customer", "c_name eq null", "c_custkey,c_name", "c_name IS NULL")
filtered("filter_ne_null", "customer", "c_name ne null", "c_custkey,c_name", "c_name IS NOT NULL")
filtered("filter_date", "orders", "o_orderdate ge 1998-01-01 and o_orderdate lt 1999-01-01", "o_orderkey,o_orderdate", "o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'")
filtered("filter_datetime", "events", "ts gt 2024-01-10T12:00:00Z", "event_id,ts", "ts > TIMESTAMP '2024-01-10 12:00:00'")
filtered("filter_datetime_offset", "events", "ts le 2024-01-10T12:30:00.5+02:00", "event_id,ts", "ts <= TIMESTAMP '2024-01-10 10:30:00.5'")
filtered("filter_duration", "orders", "o_orderdate add duration'P30D' gt 2001-07-20", "o_orderkey,o_orderdate", "o_orderdate + INTERVAL 30 DAY > DATE '2001-07-20'")
# arithmetic
filtered("arith_add_mul", "lineitem", "l_extendedprice mul l_discount add l_tax gt 4000", "l_orderkey,l_linenumber,l_extendedprice", "l_extendedprice * l_discount + l_tax > 4000")
filtered("arith_sub", "part", "p_retailprice sub p_size lt 950", "p_partkey,p_retailprice", "p_retailprice - p_size < 950")
filtered("arith_div_int", "part", "p_size div 7 eq 3", "p_partkey,p_size", "p_size // 7 = 3")
filtered("arith_div", "lineitem", "l_extendedprice div l_quantity gt 1900", "l_orderkey,l_linenumber", "l_extendedprice / l_quantity > 1900")
filtered("arith_mod", "orders", "o_orderkey mod 97 eq 5", "o_orderkey,o_custkey", "o_orderkey % 97 = 5")
filtered("arith_negate", "customer", "-c_acctbal gt 500", "c_custkey,c_acctbal", "-c_acctbal > 500")
# functions
for _name, _entity, _condition, _columns, _where in [
    ("contains", "part", "contains(p_name, 'a')", "p_partkey,p_name", "contains(p_name, 'a')"),
    ("startswith", "customer", "startswith(c_mktsegment, 'B')", "c_custkey,c_mktsegment", "starts_with(c_mktsegment, 'B')"),
    ("endswith", "customer", "endswith(c_name, '7')", "c_custkey,c_name", "ends_with(c_name, '7')"),
    ("length", "part", "length(p_type) gt 10", "p_partkey,p_type", "length(p_type) > 10"),
    ("length_some", "part", "length(p_type) gt 6", "p_partkey,p_type", "length(p_type) > 6"),
    ("concat", "orders", "concat(o_orderstatus, o_orderpriority) eq 'F1-URGENT'", "o_orderkey,o_orderpriority", "concat(o_orderstatus, o_orderpriority) = 'F1-URGENT'"),
    ("indexof", "orders", "indexof(o_orderpriority, '-') eq 1", "o_orderkey,o_orderpriority", "instr(o_orderpriority, '-') - 1 = 1"),
    ("substring", "nation", "substring(n_name, 1) ne 'X'", "n_nationkey,n_name", "substring(n_name, 2) <> 'X'"),
    ("substring3", "customer", "substring(c_mktsegment, 0, 4) eq 'AUTO'", "c_custkey,c_mktsegment", "substring(c_mktsegment, 1, 4) = 'AUTO'"),
    ("matchespattern", "customer", "matchesPattern(c_name, '[0-9]*9$')", "c_custkey,c_name", "regexp_matches(c_name, '[0-9]*9$')"),
    ("tolower", "customer", "tolower(c_mktsegment) eq 'building'", "c_custkey,c_mktsegment", "lower(c_mktsegment) = 'building'"),
    ("toupper", "events", "toupper(event_type) eq 'CLICK'", "event_id,event_type", "upper(event_type) = 'CLICK'"),
    ("trim", "events", "trim(event_type) eq 'view'", "event_id,event_type", "trim(event_type) = 'view'"),
    ("trim_padded", "events", "trim(concat('  ', concat(event_type, ' '))) eq 'view'", "event_id,event_type", "trim(concat('  ', event_type, ' ')) = 'view'"),
    ("year", "orders", "year(o_orderdate) eq 1997", "o_orderkey,o_orderdate", "year(o_orderdate) = 1997"),
    ("month", "orders", "month(o_orderdate) in (2, 3)", "o_orderkey,o_orderdate", "month(o_orderdate) IN (2, 3)"),
    ("day", "orders", "day(o_orderdate) eq 31", "o_orderkey,o_orderdate", "day(o_orderdate) = 31"),
    ("hour", "events", "hour(ts) lt 3", "event_id,ts", "hour(ts) < 3"),
    ("minute", "events", "minute(ts) eq 30", "event_id,ts", "minute(ts) = 30"),
    ("second", "events", "second(ts) ge 50", "event_id,ts", "second(ts) >= 50"),
    ("date", "events", "date(ts) eq 2024-01-05", "event_id,ts", "ts::DATE = DATE '2024-01-05'"),
    ("time", "events", "time(ts) gt 22:00:00", "event_id,ts", "ts::TIME > TIME '22:00:00'"),
    ("now", "orders", "o_orderdate lt now()", "o_orderkey,o_orderdate", "o_orderdate < now()::TIMESTAMP"),
    ("round", "customer", "round(c_acctbal) eq 100 or round(c_acctbal) gt 9000", "c_custkey,c_acctbal", "round(c_acctbal) = 100 OR round(c_acctbal) > 9000"),
    ("floor", "part", "floor(p_retailprice) mod 10 eq 3", "p_partkey,p_retailprice", "floor(p_retailprice)::BIGINT % 10 = 3"),
    ("ceiling", "part", "ceiling(p_retailprice) mod 10 eq 3", "p_partkey,p_retailprice", "ceil(p_retailprice)::BIGINT % 10 = 3"),
]:
    filtered(f"fn_{_name}", _entity, _condition, _columns, _where)
# paths and lambdas
add("nav_deep", "orders", {"$filter": "customer/nation/region/r_name eq 'ASIA'", "$select": "o_orderkey,o_custkey"}, "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
add("nav_dotted_text", "customer", {"$filter": "contains(nation.n_name, 'A')", "$select": "c_custkey,nation/n_name"}, "SELECT c_custkey, n_name AS nation_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE contains(n_name, 'A')")
add("nav_missing_target", "documents", {"$filter": "label/quality eq null", "$select": "doc_id"}, "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
# nulls of a left join: a comparison with null is neither true nor false, and so is its negation
add("filter_ne_missing", "documents", {"$filter": "label/quality ne 1", "$select": "doc_id"}, "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality <> 1")
add("filter_not_missing", "documents", {"$filter": "not (label/quality eq 1)", "$select": "doc_id"}, "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1)")
add("filter_or_missing", "documents", {"$filter": "label/quality eq null or label/quality ge 1", "$select": "doc_id"}, "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality >= 1")
add("nav_to_many", "customer", {"$filter": "orders/o_totalprice gt 300000", "$select": "c_custkey"}, "SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
add("lambda_any", "orders", {"$filter": "lines/any(l: l/l_quantity gt 49)", "$select": "o_orderkey"}, "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
add("lambda_any_empty", "orders", {"$filter": "not lines/any()", "$select": "o_orderkey"}, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
add("lambda_all", "orders", {"$filter": "lines/all(l: l/l_quantity gt 5)", "$select": "o_orderkey"}, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 5))")
add("lambda_any_or", "orders", {"$filter": "o_totalprice gt 400000 or lines/any(l: l/l_discount ge 0.1)", "$select": "o_orderkey"}, "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1)")
add("lambda_nested", "customer", {"$filter": "orders/any(o: o/o_orderstatus eq 'F' and o/lines/any(l: l/l_quantity ge 50))", "$select": "c_custkey"}, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50))")
add("lambda_two_steps", "nation", {"$filter": "customers/orders/any(o: o/o_totalprice gt 450000)", "$select": "n_nationkey"}, "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 450000)")
add("lambda_path_inside", "orders", {"$filter": "lines/any(l: l/part/p_size eq 50)", "$select": "o_orderkey"}, "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 50)")
add("lambda_many", "supplier", {"$filter": "parts/any(p: p/p_size eq 1)", "$select": "s_suppkey"}, "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_size = 1)")
# order and pages
add("order_multi", "customer", {"$select": "c_custkey,c_mktsegment", "$orderby": "c_mktsegment,c_acctbal desc,c_custkey", "$top": "20"}, "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 20")
add("order_path", "customer", {"$select": "c_custkey", "$orderby": "nation/n_name desc,c_custkey", "$top": "15"}, "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC, c_custkey LIMIT 15")
add("page_skip_top", "part", {"$select": "p_partkey,p_name", "$orderby": "p_retailprice desc", "$skip": "30", "$top": "12"}, "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12 OFFSET 30")
add("page_skip_only", "supplier", {"$select": "s_suppkey", "$skip": "90"}, "SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 90")
add("page_top_zero", "supplier", {"$select": "s_suppkey", "$top": "0"}, "SELECT s_suppkey FROM supplier LIMIT 0")
add("page_no_key", "lineitem", {"$select": "l_orderkey,l_quantity", "$orderby": "l_quantity desc", "$top": "25"}, "SELECT l_orderkey, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 25")
# aggregation
_money = lambda *names: lambda df: df.withColumns({n: F.round(n, 2) for n in names})
add("apply_aggregate", "orders", {"$apply": "aggregate($count as n, o_totalprice with sum as total, o_totalprice with max as most)"}, "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most FROM orders", then=_money("total"))
add("apply_distinct", "orders", {"$apply": "groupby((o_orderstatus,o_orderpriority))"}, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("apply_group_sum", "lineitem", {"$apply": "filter(l_shipdate le 1998-09-02)/groupby((l_returnflag,l_linestatus), aggregate(l_quantity with sum as sum_qty, l_extendedprice with average as avg_price, $count as n))"}, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL", then=_money("sum_qty", "avg_price"))
add("apply_min_max", "customer", {"$apply": "groupby((c_mktsegment), aggregate(c_acctbal with min as low, c_acctbal with max as high))"}, "SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment")
add("apply_countdistinct", "orders", {"$apply": "groupby((o_orderstatus), aggregate(o_custkey with countdistinct as buyers, o_custkey with count as n))"}, "SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers, count(*) AS n FROM orders GROUP BY o_orderstatus")
add("apply_having", "orders", {"$apply": "groupby((o_custkey), aggregate($count as n))/filter(n ge 15)"}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
add("apply_group_path", "orders", {"$apply": "groupby((customer/nation/n_name), aggregate($count as n))"}, "SELECT n_name AS customer_nation_n_name, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
add("apply_group_twice", "orders", {"$apply": "groupby((o_custkey,o_orderstatus), aggregate($count as n))/groupby((o_orderstatus), aggregate(n with max as most))"}, "SELECT o_orderstatus, max(n) AS most FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
add("apply_aggregate_empty", "orders", {"$apply": "filter(o_totalprice lt 0)/aggregate($count as n, o_custkey with max as k)"}, "SELECT count(*) AS n, max(o_custkey) AS k FROM orders WHERE o_totalprice < 0")
_buckets = Policy(apply_keys={"year": lambda: F.year("o_orderdate").cast("long")}, apply_aggregates={"range": lambda c: F.round(F.max(c) - F.min(c), 2)}, aliases={"status": "o_orderstatus"})
add("apply_custom_key", "orders", {"$apply": "groupby((year), aggregate($count as n))"}, "SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY ALL", _buckets)
add("apply_custom_aggregate", "orders", {"$apply": "groupby((status), aggregate(o_totalprice with range as spread))"}, "SELECT o_orderstatus AS status, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY ALL", _buckets)


# relations; nested results are compared flattened
def _flat(name: str, *fields: str, keep: tuple[str, ...] = ()) -> Shape:
    return lambda df: df.select(*keep, *[F.col(f"{name}.{f}").alias(f) for f in fields])


def _burst(name: str, *fields: str, keep: tuple[str, ...] = ()) -> Shape:
    return lambda df: df.select(*keep, F.posexplode_outer(name).alias("pos", "item")).select(*keep, F.col("pos").cast("long").alias("pos"), *[F.col(f"item.{f}").alias(f) for f in fields])


add("expand_forward", "orders", {"$select": "o_orderkey", "$expand": "customer($select=c_name,c_mktsegment)"}, "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey", then=_flat("customer", "c_name", "c_mktsegment", keep=("o_orderkey",)))
add("expand_forward_nested_rows", "nation", {"$select": "n_name", "$expand": "region"}, None)
add("expand_forward_filter", "orders", {"$select": "o_orderkey", "$expand": "customer($select=c_name;$filter=c_acctbal lt 0)"}, "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal < 0", then=_flat("customer", "c_name", keep=("o_orderkey",)))
add("expand_forward_deep", "orders", {"$select": "o_orderkey", "$expand": "customer($select=c_name;$expand=nation($select=n_name;$expand=region($select=r_name)))"}, "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", then=lambda df: df.select("o_orderkey", "customer.c_name", "customer.nation.n_name", "customer.nation.region.r_name"))
add("expand_forward_missing", "documents", {"$select": "doc_id", "$expand": "label($select=quality)"}, "SELECT d.doc_id, (l.doc_id IS NULL) AS missing, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", then=lambda df: df.select("doc_id", F.col("label").isNull().alias("missing"), "label.quality"))
add("expand_reverse", "region", {"$select": "r_name", "$expand": "nations($select=n_name;$orderby=n_name desc)"}, "SELECT r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name DESC) - 1 AS pos, n_name FROM region JOIN nation ON n_regionkey = r_regionkey", then=_burst("nations", "n_name", keep=("r_name",)))
add("expand_reverse_nested_rows", "region", {"$expand": "nations($expand=customers($select=c_name;$top=2))"}, None)
add("expand_reverse_nested", "region", {"$select": "r_name", "$expand": "nations($select=n_name;$expand=customers($select=c_name;$top=2))"}, "SELECT r_name, n_name, c_name FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 2) ON c_nationkey = n_nationkey", then=lambda df: df.select("r_name", F.explode("nations").alias("n")).select("r_name", "n.n_name", F.explode_outer("n.customers").alias("c")).select("r_name", "n_name", "c.c_name"))
add("expand_many_paged_parent", "supplier", {"$select": "s_suppkey", "$orderby": "s_acctbal desc", "$top": "7", "$expand": "parts($select=p_partkey)"}, "SELECT s_suppkey, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey) AS n FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7)", then=lambda df: df.select("s_suppkey", F.size("parts").cast("long").alias("n")))
add("expand_forward_filter_nested", "orders", {"$select": "o_orderkey", "$expand": "customer($select=c_name;$filter=c_acctbal gt 9000;$expand=events($select=event_id))"}, "SELECT o_orderkey, c_name, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000", then=lambda df: df.where("customer IS NOT NULL").select("o_orderkey", "customer.c_name", F.size("customer.events").cast("long").alias("n")))
add("expand_reverse_page", "customer", {"$select": "c_custkey", "$expand": "orders($select=o_orderkey,o_totalprice;$orderby=o_totalprice desc;$skip=1;$top=2)"}, "SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN NULL ELSE rn - 2 END AS pos, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn > 1 AND rn <= 3) ON c_custkey = o_custkey", then=_burst("orders", "o_orderkey", "o_totalprice", keep=("c_custkey",)))
add("expand_reverse_empty", "orders", {"$select": "o_orderkey", "$expand": "lines($select=l_linenumber;$filter=l_quantity ge 50)"}, "SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity >= 50 GROUP BY o_orderkey", then=lambda df: df.select("o_orderkey", F.size("lines").cast("long").alias("n")))
add("expand_many", "supplier", {"$select": "s_suppkey", "$expand": "parts($select=p_partkey,p_size;$orderby=p_size;$top=3)"}, "SELECT s_suppkey, rn - 1 AS pos, p_partkey, p_size FROM supplier LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_size, p_partkey) AS rn FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey QUALIFY rn <= 3) ON s_suppkey = l_suppkey", then=_burst("parts", "p_partkey", "p_size", keep=("s_suppkey",)))
add("expand_two_levels", "nation", {"$select": "n_nationkey", "$expand": "customers($select=c_custkey;$orderby=c_custkey;$top=2;$expand=orders($select=o_orderkey;$orderby=o_orderkey;$top=2))"}, "SELECT n_nationkey, c_custkey, o_orderkey FROM nation JOIN (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 2) ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) ON o_custkey = c_custkey", then=lambda df: df.select("n_nationkey", F.explode("customers").alias("c")).select("n_nationkey", "c.c_custkey", F.explode_outer("c.orders").alias("o")).select("n_nationkey", "c_custkey", "o.o_orderkey"))
add("expand_two_relations", "nation", {"$select": "n_nationkey", "$expand": "customers($select=c_custkey),suppliers($select=s_suppkey)"}, "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation", then=lambda df: df.select("n_nationkey", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers")))
add("expand_paged_parent", "orders", {"$select": "o_orderkey", "$orderby": "o_totalprice desc", "$top": "10", "$expand": "lines($select=l_quantity),customer($select=c_name)"}, "SELECT o_orderkey, c_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) JOIN customer ON o_custkey = c_custkey", then=lambda df: df.select("o_orderkey", "customer.c_name", F.size("lines").cast("long").alias("n")))


# policies, computed columns, builder
def _balance(c_acctbal: Column) -> Column:
    return F.when(c_acctbal < 0, "debt").otherwise("credit")


_computed = Policy(computed={"balance": _balance, "label": lambda balance, c_name: F.concat_ws(":", balance, c_name), "n_orders": RelationAggregate("orders", lambda: F.count(F.lit(1)))}, requires={"balance": ["c_acctbal"], "label": ["balance", "c_name"]}, aliases={"segment": "c_mktsegment", "country": "nation.n_name"})
add("computed_column", "customer", {"$filter": "balance eq 'debt'", "$select": "c_custkey,label"}, "SELECT c_custkey, 'debt:' || c_name AS label FROM customer WHERE c_acctbal < 0", _computed)
add("computed_relation_count", "customer", {"$filter": "n_orders ge 12", "$select": "c_custkey,n_orders"}, "SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) >= 12", _computed)
add("alias_projection", "customer", {"$filter": "segment eq 'BUILDING'", "$select": "c_custkey,segment,country", "$orderby": "country,c_custkey"}, "SELECT c_custkey, c_mktsegment AS segment, n_name AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'", _computed)
add("builder_where", "orders", QueryBuilder().where(Field("o_totalprice").between(1000, 50000) & ~Field("o_orderstatus").is_in(["F"])).and_where(Field("customer").c_mktsegment.eq("BUILDING") | Field("o_orderpriority").contains("URGENT")).select(Field("o_orderkey")), "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus <> 'F' AND (c_mktsegment = 'BUILDING' OR contains(o_orderpriority, 'URGENT'))")
add("builder_texts", "customer", QueryBuilder().where((Field("c_mktsegment").startswith("A") | Field("c_mktsegment").endswith("G")) & Field("c_name").is_not_null() & Field("c_nationkey").not_in([1, 2])).and_where(Field("c_name").matches("[0-9]*[02468]$")).select(Field("c_custkey")), "SELECT c_custkey FROM customer WHERE (starts_with(c_mktsegment, 'A') OR ends_with(c_mktsegment, 'G')) AND c_name IS NOT NULL AND c_nationkey NOT IN (1, 2) AND regexp_matches(c_name, '[0-9]*[02468]$')")
add("builder_text", "orders", QueryBuilder().filter("o_totalprice gt 200000").or_filter("o_custkey lt 10").select("o_orderkey,o_custkey").orderby("o_orderkey desc").top(40), "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 OR o_custkey < 10 ORDER BY o_orderkey DESC LIMIT 40")
add("builder_expand", "region", QueryBuilder().select(Field("r_name")).expand(Expand("nations").select("n_name").orderby(OrderBy("n_name")).top(2)), "SELECT r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1 AS pos, n_name FROM region JOIN nation ON n_regionkey = r_regionkey QUALIFY pos < 2", then=_burst("nations", "n_name", keep=("r_name",)))


def _count(spark: SparkSession, folder: str) -> DataFrame:
    return Selector(driver_catalog(spark, folder), "orders").count_df({"$filter": "o_orderstatus eq 'F'", "$top": "3", "$expand": "lines"})


QUERIES["count"], SQL["count"] = _count, "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'"


def _paged(entity: str, query: Query, policy: Policy = OPEN) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: Selector(driver_catalog(spark, folder), entity, policy).page(query)


# pages that are bounded without being asked for
QUERIES["page_default"], SQL["page_default"] = _paged("customer", {"$select": "c_custkey"}), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100"
QUERIES["page_bound"], SQL["page_bound"] = _paged("orders", {"$select": "o_orderkey", "$orderby": "o_totalprice", "$top": "9999"}), "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500"
