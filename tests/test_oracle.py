"""Every query with a SQL equivalent gives the same rows in the other engine."""

import pandas as pd
import pytest
from conftest import SF

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v)).astype(object)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got = plain(QUERIES[name](spark, SF).toPandas())
    want = plain(duck.execute(ORACLE[name]).df())
    for c in got.columns:
        if got[c].dtype != want[c].dtype:  # a column that is null throughout
            assert got[c].isna().all() and want[c].isna().all()
            got, want = got.drop(columns=c), want.drop(columns=c)
    pd.testing.assert_frame_equal(got, want, rtol=0, atol=2e-6, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
