"""Every query of the library against its SQL on the smallest tables; those without SQL must give rows."""

import collections
import os

import duckdb
import pytest

import __spark_entry__
from plumbline.plans.oracle import SQL
from plumbline.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def counted(rows, cols):
    return collections.Counter(tuple(repr(round(r[c], 6)) if isinstance(r[c], float) else str(r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert counted(rows, df.columns) == counted(want, df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(SQL) <= set(__spark_entry__.queries())


def test_entry_without_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2:3].isdigit() for k in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False"], out.stderr


def test_bootstrap_resamples_the_orders_of_the_correlation(spark):
    """An interval holds the correlation of the same rows, and is as narrow as their number makes it."""
    rho = {r["c_mktsegment"]: r for r in QUERIES["spearman_by_group"](spark, DIR).collect()}
    ci = {r["c_mktsegment"]: r for r in QUERIES["bootstrap_ci"](spark, DIR).collect()}
    assert set(ci) == set(rho)
    for g, r in rho.items():
        assert ci[g]["ci_low"] < r["rho"] < ci[g]["ci_high"]
        assert ci[g]["ci_high"] - ci[g]["ci_low"] < 6 / r["n"] ** 0.5
