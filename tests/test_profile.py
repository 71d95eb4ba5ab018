import duckdb
import pytest

from lakewarden.operators.profile import profile

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("table", ["orders", "events"])
def test_counts_of_all_columns(spark, table):
    """Timestamps and doubles too, which the registered profiles leave out."""
    d, con = spark.read.parquet(f"{SF}/{table}.parquet"), duckdb.connect()
    got = {r["column"]: (r["total"], r["distinctCount"], round(r["nullRate"], 9)) for r in profile(d).collect()}
    want = {c: con.sql(f"SELECT count(*), count(DISTINCT {c}), round(1 - count({c}) / count(*), 9) FROM '{SF}/{table}.parquet'").fetchall()[0] for c in d.columns}
    assert got == want
