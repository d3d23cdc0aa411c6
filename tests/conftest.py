import datetime
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quillmark.session import local_session

    session = local_session(cores=4, memory="3g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not there")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return con


def plain(value):
    """A value as both engines give it."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(x)) for k, x in value.items()))
    if hasattr(value, "is_integer"):  # decimals
        return round(float(value), 6)
    return value


@pytest.fixture(scope="session")
def same_as_sql(spark, data, duck):
    def check(query, sql):
        df = query(spark, data)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
        result = duck.sql(sql)
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
        assert got == want

    return check
