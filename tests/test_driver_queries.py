"""Every registered query of the engine against its SQL, and the plans that scale rests on."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quern.plans.driver_queries import QUERIES, SQL
from quern.selector import Selector
from quern.sources.tables import driver_catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, compare):
    if name not in SQL:
        assert QUERIES[name](spark, FOLDER).count() > 0
        return
    got, want = compare(QUERIES[name], SQL[name], FOLDER)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown_and_pruning(spark):
    s = Selector(driver_catalog(spark, FOLDER), "orders")
    plan = _plan(s.query("$filter=o_totalprice gt 1000&$select=o_orderkey"))
    assert "GreaterThan(o_totalprice,1000" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in _plan(s.query("$select=o_orderkey&$orderby=o_totalprice desc&$top=3&$skip=2"))
    assert "Python" not in _plan(s.query("$filter=lines/any(l: l/l_quantity gt 4)&$expand=customer,lines($top=2)"))
    count = _plan(s.count_df("$expand=lines&$orderby=o_totalprice"))
    assert "Join" not in count and "Sort" not in count


def test_nested_levels_are_cut_to_their_parents(spark):
    tree = lambda query, entity: Selector(driver_catalog(spark, FOLDER), entity).query(query)._jdf.queryExecution().optimizedPlan().toString()
    # only orders of the customers that are left are ranked: the semi join lies below their window
    paged = tree("$expand=customers($top=2;$expand=orders($top=2))", "nation")
    assert "LeftSemi" in paged[paged.index("o_custkey") :].split("Window", 1)[1]
    assert "LeftSemi" in tree("$expand=customer($filter=c_acctbal lt 0;$expand=orders)", "orders")
    assert "LeftSemi" not in tree("$expand=customers($expand=orders)", "nation")
    # a bridge is cut before its pairs are made distinct
    assert re.search(r"Aggregate \[\w+__from.*\n.*\n.*Join LeftSemi", tree("$top=3&$expand=parts", "supplier"))


@pytest.mark.parametrize("gone", [["quern/llm", "tests/llm"], ["quern/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_works_without_the_training_data_part(gone, tmp_path):
    top, copy = Path(__file__).parents[1], tmp_path / "copy"
    shutil.copytree(top, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or str((Path(d) / n).relative_to(top)) in gone])
    assert not any((copy / g).exists() for g in gone)
    code = "import __spark_entry__ as e; q = set(e.queries()); assert len(q) > 80 and set(e.oracle_sql()) <= q; ops = {n for n in q if n.startswith('op') and n[2].isdigit()}; print(len(ops), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout
    assert out.split() == (["0", "False"] if "quern/llm" in gone else ["10", "False"])
