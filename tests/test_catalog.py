"""Every registered query against its SQL twin in DuckDB."""

import math
import subprocess
import sys

import duckdb
import pytest

from memspool import catalog

from .conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    def value(v):
        if v is None or str(v) == "<NA>" or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(map(value, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry_imports_without_extras(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("missing", ["xxhash", "ahocorasick", "memspool.llm", "corpus_pipeline"])
def test_entry_survives_missing_parts(missing):
    """In a process of its own, as modules stay imported."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) >= len(catalog.QUERIES) and int(out[1]) >= len(catalog.ORACLES) and out[2] == "False"
