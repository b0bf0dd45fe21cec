"""Palettes beyond the 256 entries of the format lose none."""

from rasterloom.plans import queries


def test_every_entry_is_looked_up(spark, tmp_path):
    spark.range(300).selectExpr("cast(id as int) AS n_nationkey", "cast(id % 5 as int) AS n_regionkey", "'x' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(300).selectExpr("id AS l_orderkey", "cast(id as int) AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.idx for r in queries.palette_lookup(spark, str(tmp_path)).collect()) == list(range(300))
