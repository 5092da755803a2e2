"""Registered queries against their SQL, and what registration promises."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from arbora.plans import queries

from .conftest import ROOT, SMALL


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, tables, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), tables.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_references_are_asked_for_every_symbol(spark):
    known, got = queries.QUERIES["symbols_nodes"](spark, SMALL), queries.QUERIES["resolve_reference"](spark, SMALL)
    assert known.count() > 150
    assert known.join(got.where("outcome = 'resolved' and id = reference"), "id", "left_anti").isEmpty()


def test_aliases_of_every_kind(spark):
    got = queries.QUERIES["legacy_alias_unique"](spark, SMALL)
    assert {r["kind"] for r in got.select(F.element_at(F.split("legacy_id", ":"), 2).alias("kind")).distinct().collect()} == {"function", "class", "global", "module"}


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["seed", "impacted"]
    assert rows.count() > 0


def test_imports_without_the_training_data_subpackage():
    code = "import sys; sys.modules['arbora.llm'] = None\nimport __spark_entry__ as e; assert 'call_edges' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ, timeout=120, check=False)
    assert done.returncode == 0, done.stderr


def test_disassembly(spark):
    assert "co_" not in queries.QUERIES["disassembly"](spark, SMALL).first()["disassembly"][:3]


@pytest.mark.parametrize("parts", [1, 3])
def test_first_wins_takes_the_first_of_equal_places(spark, tmp_path, parts):
    con, (keys, step) = duckdb.connect(), (9, 5000 // parts)
    con.execute(f"create table lineitem as select i // 2000 as l_orderkey, i % {keys} as l_partkey, case when i % 7 > 0 then i end as l_suppkey, case when i % 11 > 0 then 1 end as l_linenumber from range(5000) t(i)")
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(parts):  # the last file is the largest, which Spark reads first
        last = "" if k == parts - 1 else f"limit {step}"
        con.execute(f"copy (select * from lineitem {last} offset {k * step}) to '{tmp_path}/lineitem.parquet/part-{k}.parquet' (format parquet, row_group_size 2048)")
    con.execute("set threads = 1")
    assert normal(queries.QUERIES["node_dedup_first_wins"](spark, str(tmp_path)).toPandas()) == normal(con.sql(queries.SQL["node_dedup_first_wins"]).df())


def test_facet_changes_parses_each_version_once(spark):
    plan = queries.QUERIES["facet_changes"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
