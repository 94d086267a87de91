import glob
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.runtime import session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session(8, 8, "6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "-"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(int(v))
    if isinstance(v, (int, float)) or any(x in type(v).__name__ for x in ("int", "float", "Decimal")):
        return "-" if v != v else format(round(float(v), 6) + 0.0, ".6f")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict") or type(v).__name__ == "ndarray":
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    return str(v)


def rows_of(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted("|".join(map(plain, r)) for r in df.itertuples(index=False))


def same_as_sql(spark, duck, query, sql):
    a, b = query(spark, SF).toPandas(), duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows_of(a), rows_of(b)
    assert len(x) == len(y)
    assert x == y
