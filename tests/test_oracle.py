"""Every core query against its SQL, and the others for rows."""

import pytest

from grainmill.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(compare, name):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_infinite_scores_equal_sql(spark, tmp_path):
    """enrich_scores on infinite scores, with null, NaN and infinities told apart, which compare() takes for one or leaves out."""
    duckdb = pytest.importorskip("duckdb")
    rows = [("a", "inf", 1), ("b", "-inf", 1), ("c", "3.5", 1), ("c", "inf", 2), ("d", "inf", 1), ("d", None, 2), ("e", None, 1), ("e", "-inf", 1), ("f", "nan", 1), ("f", "inf", 1), ("g", "1e300", 1)]
    samples = spark.createDataFrame(rows, "sample_key string, score string, at int")
    columns = ["sample_key", "'t' as tar_path", "1L as priority", "cast(score as double) as aesthetic_score", "timestamp_seconds(at) as indexed_at"]
    samples.selectExpr(*columns).coalesce(1).write.parquet(f"{tmp_path}/sample_index.parquet")
    con = duckdb.connect()
    con.sql(f"create view sample_index as select * from '{tmp_path}/sample_index.parquet/*.parquet'")
    theirs = sorted((k, repr(a)) for k, _, a in con.sql(SQL["enrich_scores"]).fetchall())
    assert theirs == [("a", "inf"), ("b", "-inf"), ("c", "inf"), ("d", "None"), ("e", "-inf"), ("f", "nan"), ("g", "1e+300")]
    assert sorted((r.sample_key, repr(r.aesthetic_score)) for r in QUERIES["enrich_scores"](spark, str(tmp_path)).collect()) == theirs
