"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from onsetlab.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return round(float(v), 5) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = [[dict(zip(columns, r))[c] for c in order] for r in want.fetchall()]
    assert _plain(got.select(*order).collect()) == _plain(rows)


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(catalog.queries())


def test_queries_cover_all_runs_and_frames(spark):
    n = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
    scored = catalog.queries()["kfold_logistic"](spark, DIR).select("subject", "fold").collect()
    assert sorted(map(tuple, scored)) == [(s, k) for s in ("00", "01") for k in range(1, 7)]
    assert "max_iter" not in catalog.PARAMS  # fits end by their own defaults
    frames = catalog.queries()["concat_patterns"](spark, DIR).select("boldfile", "volume").distinct()
    assert frames.count() == n and frames.select("boldfile").distinct().count() == 6
