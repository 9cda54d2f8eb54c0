"""Queries that must see every row of their tables, on tables whose cases lie beyond a prefix of ids."""

from dialoom import plans


def test_constraint_report_all(spark, tmp_path):
    rows = [(1, "red tin", 1), (150, "blue tin", 7), (900, "grey tin", 7), (5_000, "grey tin", 8), (70_000, "grey tin", 9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = plans.QUERIES["constraint_report_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("ambiguous_surface", "grey tin", 3), ("duplicate_id", "7", 2)]


def test_upsert_voices_all(spark, tmp_path):
    spark.createDataFrame([(40, "A", 24), (41, None, 23), (80, None, 1)], "c_custkey long, c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = plans.QUERIES["upsert_voices_all"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == {(40, "A", "kept"), (41, None, "kept"), (80, "y", "filled"), (120, "z", "new")}
