import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def canon(v):
    """A value as text that is the same from either engine."""
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return repr(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query's rows with its SQL's, over one of the test directories."""
    duckdb = pytest.importorskip("duckdb")

    def check(query, sql, sf_dir):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        df = query(spark, str(sf_dir))
        cols = sorted(df.columns)
        got = sorted("|".join(map(canon, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        want = sorted("|".join(canon(r[i]) for i in at) for r in rel.fetchall())
        assert got == want
        return len(got)

    return check


@pytest.fixture(scope="session")
def sf_dir():
    p = Path("/root/testdata/sf0.001")
    if not p.exists():
        pytest.skip("no test data here")
    return p
