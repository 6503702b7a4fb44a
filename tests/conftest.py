import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    return folder


@pytest.fixture(scope="session")
def compare(spark, data):
    """compare(query, sql): equal rows, floats to nine digits, columns by name."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in Path(data).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")

    def value(x):
        if x is None or x != x:
            return None
        return round(float(x), 9) + 0.0 if isinstance(x, float) else x

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)

    def run(query, sql):
        ours, theirs = query(spark, data).toPandas(), con.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)

    return run
