"""Every registered query of the engine against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from framelake import plans
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    want = duck.sql(plans.SQL[name]).df()
    got = plans.QUERIES[name](spark, SF).toPandas()
    fix = lambda df: df.astype({c: "float64" for c in df.columns if str(df[c].dtype) in ("Int64", "Int32", "int32", "int64")})
    assert rows(fix(got)) == rows(fix(want))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert len(plans.QUERIES[name](spark, SF).toPandas()) > 0


def test_stream_equals_batch(spark):
    got = plans.QUERIES["stream_step_equals_batch"](spark, SF).toPandas()
    assert len(got) and (got["n"] == got["n_equal"]).all()
