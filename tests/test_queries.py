"""Every registered analytics query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from regimark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(plans.ORACLE_SQL[name]).df())


#: Does what m15_out_of_fold_evaluation does, and then what test_runs_are_evaluated_apart holds against numpy.
TWICE = {"m15_out_of_fold_summary"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLE_SQL.keys() - TWICE))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert plans.QUERIES.keys() <= e.queries().keys()
