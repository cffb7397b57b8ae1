import glob
import os

import pytest

from quizlens.session import local_session

DATA = os.environ.get("QUIZLENS_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """Values of either engine in one comparable form."""
    import decimal

    if hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def same_rows(frame, con, sql):
    columns = sorted(frame.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted(repr([plain(r[i]) for i in order]) for r in cursor.fetchall())
    assert found == wanted
