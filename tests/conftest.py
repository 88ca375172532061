import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    folder = f"{DATA}/sf0.001"
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(v):
    """A value in a form that compares across engines."""
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Runs a query and its SQL over the smallest tables and compares columns and rows."""

    def check(query, sql):
        df = query(spark, f"{DATA}/sf0.001")
        rows = df.collect()
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        ours = sorted(tuple(plain(r[c]) for c in order) for r in rows)
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall())
        assert ours == theirs

    return check
