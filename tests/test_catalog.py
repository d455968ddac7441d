"""Every registered query of the engine against its SQL, over the smallest tables."""

from __future__ import annotations

import ast
import builtins
import importlib
import math
import sys
from pathlib import Path

import duckdb
import pytest

from fathom import catalog, catalog_engine  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    cursor = db.execute(catalog.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_nothing_outside_imports_the_optional_subpackage():
    for path in [*(ROOT / "fathom").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("fathom.llm", "corpus_pipeline")) for n in names), path


def test_entry_points_without_the_optional_subpackage(monkeypatch, spark):
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith(("fathom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setattr(builtins, "__import__", refuse)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(catalog.SQL)
    assert entry.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_other_import_errors_are_not_hidden(monkeypatch):
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'somethingelse'", name="somethingelse")
        return real(name, *args, **kwargs)

    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setattr(builtins, "__import__", refuse)
    with pytest.raises(ModuleNotFoundError, match="somethingelse"):
        importlib.import_module("__spark_entry__")
    monkeypatch.setattr(builtins, "__import__", real)
