"""Sizes that decide on broadcasts, and the folder of scratch tables."""

from pyspark.sql import functions as F

from tidewise.plans import scratch


def test_small_weighs_rows_and_bytes(spark):
    rows = spark.range(100)
    assert scratch.small(rows) and not scratch.small(rows, 99) and scratch.small(rows.limit(0))
    wide = rows.select(F.repeat(F.lit("é"), 1000).alias("text"))
    assert scratch.small(wide, max_bytes=250_000) and not scratch.small(wide, max_bytes=200_000)
    nested = rows.select(F.array_repeat(F.struct(F.col("id"), F.lit("abcd").alias("s")), 50).alias("a"), F.lit(None).cast("array<int>").alias("none"))
    assert scratch.small(nested, max_bytes=300_000) and not scratch.small(nested, max_bytes=100_000)


def test_join_checked_both_ways(spark, monkeypatch):
    left, right = spark.range(50), spark.range(20, 80).withColumn("x", F.col("id") * 2)
    want = sorted(left.join(right, "id").collect())
    assert sorted(scratch.join_checked(left, right, "id").collect()) == want
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    assert not scratch.small(right) and sorted(scratch.join_checked(left, right, "id").collect()) == want


def test_tables_lie_in_the_shared_folder(spark):
    s = scratch.Scratch(spark, "one")
    table = s.write(spark.range(3), "t")
    assert table._scratch_path.startswith(spark.conf.get("spark.checkpoint.dir")) and table.count() == 3
    s.drop(table)
    assert s.write(spark.range(2), "t").count() == 2
