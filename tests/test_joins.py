"""The skew-safe join equals a plain join on every path, whatever the key distribution."""

import pytest
from pyspark.sql import functions as F

from prefixlake.operators import joins
from prefixlake.operators.joins import fits_broadcast, measured_bytes, skew_join


@pytest.fixture(scope="module")
def sides(spark):
    # Key 0 owns a third of the rows, key NULL some, the rest are spread out.
    left = spark.range(30_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700).alias("k"),
        (F.col("id") % 5).alias("part"),
    )
    right = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [None, 0])
def test_paths_agree(rows, sides, how, limit):
    left, right = sides
    expected = left.join(right, "k", how)
    found = skew_join(left, right, ["k"], how, limit=limit)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found, *sorted(expected.columns)) == rows(expected, *sorted(expected.columns))


def test_beyond_the_bound_no_side_is_broadcast(spark, tmp_path):
    # 20 rows in the file, 20,000 after the explode, which Spark's estimate of the left side does not count
    spark.range(20).write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left")).select("id", F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("k"))
    right = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = skew_join(left, right, ["k"], how, limit=0)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString(), how


def test_composite_key(rows, spark, sides):
    left, _ = sides
    right = spark.range(0, 700, 3).select(F.col("id").alias("k"), (F.col("id") % 5).alias("part"), F.lit("x").alias("v"))
    expected = left.join(right, ["k", "part"], "left")
    found = skew_join(left, right, ["k", "part"], "left", limit=0)
    assert rows(found, "id", "k", "part", "v") == rows(expected, "id", "k", "part", "v")


def test_scans_grow_with_the_number_of_joins(sides, tmp_path):
    left, right = sides
    left.write.parquet(str(tmp_path / "left"))
    joined = left.sparkSession.read.parquet(str(tmp_path / "left"))
    for k in range(4):
        joined = skew_join(joined, right.withColumnRenamed("v", f"v{k}"), ["k"], "left", limit=0)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("Join") == 4


def test_size_is_measured(spark):
    df = spark.range(1000).select("id", F.lit("x" * 100).alias("text"), F.array(F.lit(1)).alias("list"))
    assert 100_000 < measured_bytes(df) < 400_000
    assert fits_broadcast(df, 400_000) and not fits_broadcast(df, 100_000)
    assert measured_bytes(df.limit(0)) == 0


def test_a_name_that_is_hot_on_both_sides_is_cut_into_cells(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("name"), "id")
    right = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("name"), F.col("id").alias("other"))
    found = joins.grid_join(left, right, ["name"], rows=200)
    plain = left.join(right, "name")
    assert found.count() == plain.count() and found.exceptAll(plain.select(*found.columns)).count() == 0
    for side in joins.grid_sides(left, right, ["name"], rows=200):
        assert side.groupBy("name", "_left_block", "_right_block").count().agg(F.max("count")).first()[0] < 300


def test_left_rows_without_a_key_are_dealt_over_tasks(spark):
    left = spark.range(200).select(F.when(F.col("id") < 3, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(2).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    for how, matched in (("left", 200), ("left_anti", 198)):
        joined = skew_join(left, right, ["k"], how, limit=0)
        assert joined.count() == matched and "_deal" not in joined.columns
        assert "_deal" in joined._jdf.queryExecution().executedPlan().toString()
