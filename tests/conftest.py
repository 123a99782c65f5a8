import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    """Values as the two engines return them, made equal: numbers as rounded floats, dates as text."""
    import decimal
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool | str | bytes):
        return value
    if isinstance(value, int | float | decimal.Decimal):
        return round(float(value), 3)
    if isinstance(value, list | tuple):
        return tuple(map(normal, value))
    return str(value)[:10]


def same(frame, con, sql):
    """Asserts that a frame has the rows that the SQL has, by column name."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    rows = sorted((tuple(normal(r[c]) for c in order) for r in frame.collect()), key=repr)
    wanted = sorted((tuple(normal(r[c]) for c in order) for r in expected), key=repr)
    assert len(rows) == len(wanted)
    if rows != wanted:
        for a, b in zip(rows, wanted):
            assert a == pytest.approx(b, abs=2e-3, rel=1e-6) if all(isinstance(x, float) for x in a) else all(x == y or (isinstance(x, float) and abs(x - y) < 2e-3 + 1e-6 * abs(y)) for x, y in zip(a, b)), (a, b)
