"""The driver's tables as entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog, EntityDef, Relation

#: Keys of the tables; lineitem has none.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",),
    "documents": ("doc_id",), "labels": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"),
}

#: Relations: (from, name, kind, to, local column, remote column).
LINKS = [
    ("nation", "region", "forward", "region", "n_regionkey", "r_regionkey"),
    ("region", "nations", "reverse", "nation", "r_regionkey", "n_regionkey"),
    ("customer", "nation", "forward", "nation", "c_nationkey", "n_nationkey"),
    ("nation", "customers", "reverse", "customer", "n_nationkey", "c_nationkey"),
    ("supplier", "nation", "forward", "nation", "s_nationkey", "n_nationkey"),
    ("nation", "suppliers", "reverse", "supplier", "n_nationkey", "s_nationkey"),
    ("orders", "customer", "forward", "customer", "o_custkey", "c_custkey"),
    ("customer", "orders", "reverse", "orders", "c_custkey", "o_custkey"),
    ("lineitem", "order", "forward", "orders", "l_orderkey", "o_orderkey"),
    ("orders", "lines", "reverse", "lineitem", "o_orderkey", "l_orderkey"),
    ("lineitem", "part", "forward", "part", "l_partkey", "p_partkey"),
    ("part", "lines", "reverse", "lineitem", "p_partkey", "l_partkey"),
    ("lineitem", "supplier", "forward", "supplier", "l_suppkey", "s_suppkey"),
    ("supplier", "lines", "reverse", "lineitem", "s_suppkey", "l_suppkey"),
    ("events", "customer", "forward", "customer", "user_id", "c_custkey"),
    ("customer", "events", "reverse", "events", "c_custkey", "user_id"),
    ("documents", "label", "forward", "labels", "doc_id", "doc_id"),
    ("labels", "document", "forward", "documents", "doc_id", "doc_id"),
]


def files(spark: SparkSession, folder: str, name: str, kind: str = "parquet", **options: str) -> Callable[[], DataFrame]:
    """A lazy table of any format that Spark reads."""
    return lambda: spark.read.format(kind).options(**options).load(f"{folder}/{name}.{kind}")


def driver_catalog(spark: SparkSession, folder: str) -> Catalog:
    sources = {name: files(spark, folder, name) for name in KEYS}
    relations: dict[str, dict[str, Relation]] = {name: {} for name in KEYS}
    for start, name, kind, target, local, remote in LINKS:
        relations[start][name] = Relation(kind, target, local, remote)
    relations["part"]["suppliers"] = Relation("many", "supplier", "p_partkey", "s_suppkey", sources["lineitem"], "l_partkey", "l_suppkey")
    relations["supplier"]["parts"] = Relation("many", "part", "s_suppkey", "p_partkey", sources["lineitem"], "l_suppkey", "l_partkey")
    return Catalog([EntityDef(n, sources[n], KEYS[n], relations[n]) for n in KEYS], "Driver")
