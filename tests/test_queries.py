"""Every query that has SQL, against that SQL in DuckDB."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from tidewright import plans
from tidewright.functions import angles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, np.generic):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else "-0" if x == 0 and math.copysign(1, x) < 0 else float(f"{x:.9g}")
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return str(x.date()) if x.time() == datetime.time() else str(x)
    if isinstance(x, datetime.date):
        return str(x)
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert found == want


def test_no_negative_zero(spark):
    df = spark.createDataFrame([(-720.0,), (-360.0,), (0.0,), (360.0,), (-1e-20,), (-90.0,), (725.0,)], "a double")
    found = [r[0] for r in df.select(angles.wrap360("a")).collect()]
    assert found == [0.0, 0.0, 0.0, 0.0, 0.0, 270.0, 5.0] and not any(math.copysign(1, x) < 0 for x in found)


#: Without SQL, each of these is held against brute force in test_whole.py or test_walks.py.
NO_SQL = {"C-07", "C-14", "P-04", "G-08", "G-09", "G-10", "G-11", "B-05", "B-08"}


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == NO_SQL


def test_all_operators_are_there():
    counts = {"S": 20, "K": 18, "F": 23, "C": 30, "P": 7, "T": 16, "R": 6, "G": 20, "B": 13, "W": 20, "A": 15}
    assert set(QUERIES) == {f"{k}-{i:02d}" for k, n in counts.items() for i in range(1, n + 1)}
