import os
import sys

# Small matrices only; more threads would wait for each other beside Spark's.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("STRAINSPARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strainspark.session import get_session

    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="2", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def canonical(frame):
    """Sorted rows of text with floats at six places, columns by name."""
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        return str(list(x)) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(one(x) for x in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(left, right):
        (a, x), (b, y) = canonical(left), canonical(right)
        assert a == b
        numeric = lambda rows: [tuple(str(float(v)) if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v for v in r) for r in rows]
        assert sorted(numeric(x)) == sorted(numeric(y))

    return check
