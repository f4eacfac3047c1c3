"""Every registered query with SQL gives DuckDB's rows over the same tables."""

import importlib.util
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
LLM = importlib.util.find_spec("quire.llm") is not None
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    if hasattr(value, "item"):
        return plain(value.item())
    return bytes(value) if isinstance(value, bytearray) else value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sql, name):
    got = entry.queries()[name](spark, str(DATA))
    want = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_the_llm_folders(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    found = entry.queries()
    assert found and "pipeline" not in found and not any(k.startswith("op") for k in found)
    assert set(entry.oracle_sql()) <= set(found)


def test_relations_are_an_aggregate_and_packages_are_taken_apart_once(spark):
    from quire.plans.queries import QUERIES

    plans = {n: QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for n in ("j04_relation_lookup", "s01_package_paragraphs")}
    assert "Window" not in plans["j04_relation_lookup"]
    assert "MapInArrow" not in plans["s01_package_paragraphs"]
