"""The registered link harvest reads every page, whatever its id."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from caselight.plans import oracles, queries

DATA = "/root/testdata/sf0.001"


def test_pages_with_large_ids_count(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    pages.withColumn("page_id", F.when(F.col("page_id") % 2 == 0, F.col("page_id")).otherwise(F.col("page_id") + 3_000_000_000)).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.queries()["link_harvest"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(oracles.oracle_sql()["link_harvest"]).df()
    same = queries.queries()["link_harvest"](spark, DATA).count()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values))
    assert rows(got) == rows(want) and len(got) == same
