from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest
from conftest import ROOT

import __spark_entry__ as entry
from partloom import session

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = [
    "A1_facet_makes", "A6_dataset_stats", "F8_catalog_cards", "J1_attach_fitment", "J2_enrich_fill", "M1_upsert_catalog", "M4_detect_changes",
    "O1_query_catalog", "O4_url_page", "R1_build_catalog", "S1_read_parts_export", "V5_validate_batch", "W3_year_spans", "W5_rank_cards",
    "X1_extract_application_parts", "X4_vehicle_qualifiers", "X11_select_all", "ST1_page_change_stream",
]
CHOSEN = sorted(entry.queries()) if os.environ.get("PARTLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in NAMES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, sf, duck, name):
    frame = entry.queries()[name](spark, sf)
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert frame.count() > 0
        return
    columns = sorted(frame.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted([tuple(r[c] for c in columns) for r in frame.collect()], key=key)
    relation = duck.sql(oracle)
    assert sorted(relation.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(duck.sql(f"SELECT {listed} FROM ({oracle})").fetchall(), key=key)


def test_entry_gives_rows(spark, sf):
    assert entry.entry(spark).columns == ["id", "sku", "name", "category", "price"]


def test_registry_loads_without_a_session():
    """The driver may list the queries before it starts Spark."""
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _sources():
    for folder, _, files in os.walk(os.path.join(ROOT, "partloom")):
        for name in files:
            if name.endswith(".py"):
                yield os.path.join(folder, name)


@pytest.mark.parametrize("word", ["localCheckpoint", r"\.crossJoin\(", r"\.toPandas\(", r"\.collect\(\)", r"\.rdd\.map"])
def test_library_avoids(word):
    hits = [p for p in _sources() if re.search(word, open(p, encoding="utf-8").read())]
    assert hits == []


def test_a_cluster_has_to_name_its_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = entry.queries()["F3_filter_category"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
    plan = entry.queries()["A4_makes_for_year"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
