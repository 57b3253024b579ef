import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(DATA).glob("*.parquet")):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Does a DataFrame hold the rows of a DuckDB query, in any order?"""

    def norm(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    def check(df, sql):
        cols = sorted(df.columns)
        rows = df.collect()
        got = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
        assert sorted(duck.sql(sql).columns) == cols
        want = sorted(tuple(norm(v) for v in r) for r in duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall())
        assert got == want

    return check
