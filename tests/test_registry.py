"""Every registered query runs, and gives what its SQL gives."""

from __future__ import annotations

import ast
import collections
import math
import os
from pathlib import Path

import pytest

from tessitura.plans import registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    yield con
    con.close()


def normal(value):
    """Numbers that differ by rounding alone are equal."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    return f"{value}" if not isinstance(value, int) or isinstance(value, bool) else f"{float(value):.9g}" if value else "0"


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs_and_equals_its_sql(spark, tables, monkeypatch, name):
    monkeypatch.setattr(registry, "SWEEPS", 2)
    monkeypatch.setattr(registry, "WORD_SWEEPS", 2)
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(normal(r[c]) for c in columns) for r in df.collect())
    assert len(columns) == len(set(columns))
    if name in registry.ORACLE_SQL:
        found = tables.execute(registry.ORACLE_SQL[name])
        order = [d[0] for d in found.description]
        assert sorted(order) == columns
        want = collections.Counter(tuple(normal(r[order.index(c)]) for c in columns) for r in found.fetchall())
        near = lambda a, b: len(a) == len(b) and all(x == y or math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True))
        assert got == want or all(near(a, b) for a, b in zip(sorted((got - want).elements()), sorted((want - got).elements()), strict=True))


def test_no_name_is_defined_twice():
    for path in Path(registry.__file__).resolve().parent.parent.rglob("*.py"):
        names = collections.Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef))
        assert not [n for n, k in names.items() if k > 1], path
