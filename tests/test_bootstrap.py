"""Bootstrap medians against SQL, on a table of more rows than a hundred."""

import duckdb

from bondframe.operators import dataflow as D
from bondframe.plans import registry


def test_bootstrap_of_a_larger_table(spark, tmp_path):
    spark.range(350).selectExpr("id + 1 AS s_suppkey", "cast(pow(id, 1.5) AS double) AS s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(f"SELECT draw, median FROM ({registry.ORACLE['bootstrap_medians']})").fetchall()
    got = registry.QUERIES["bootstrap_medians"](spark, str(tmp_path)).select("draw", "median").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 20


def test_a_resample_has_all_places(spark):
    """Of resamples with 5,000 places all medians are near the middle; of 100 places some would be 100 off and more."""
    df = spark.range(5000).selectExpr("id", "cast(id AS double) AS v")
    got = [x.median for x in D.bootstrap_median(df, "id", "v", 20, 5000, 7).collect()]
    assert len(got) == 20 and all(abs(x - 2500) < 170 for x in got)
    assert "range(0, 100)" not in registry.ORACLE["bootstrap_medians"]
