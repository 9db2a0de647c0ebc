from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from postweir.operators import keyed


def numbers(spark, n, parts=3):
    return spark.range(n).repartition(parts).withColumn("k", F.format_string("%05d", "id"))


@pytest.mark.parametrize("parts", [1, 7])
def test_row_index(spark, parts):
    rows = keyed.with_row_index(numbers(spark, 1000, parts), ["k"]).collect()
    assert all(r["row_index"] == r["id"] for r in rows) and len(rows) == 1000


def test_zip_rows_checks_lengths(spark):
    a, b = spark.range(10).withColumnRenamed("id", "a"), spark.range(9).withColumnRenamed("id", "b")
    with pytest.raises(Exception, match="different lengths"):
        keyed.zip_rows([a, b], [["a"], ["b"]]).collect()
    assert keyed.zip_rows([a, b], [["a"], ["b"]], strict=False).count() == 10
    same = keyed.zip_rows([a, a.withColumnRenamed("a", "c")], [["a"], ["c"]]).collect()
    assert all(r["a"] == r["c"] for r in same)


@pytest.mark.parametrize("n", [1, 5, 101, 1000])
def test_exact_split_sizes(spark, n):
    split = {r["split"]: r["count"] for r in keyed.train_dev_test(numbers(spark, n), ["k"]).groupBy("split").count().collect()}
    test = math.ceil(0.2 * n)
    dev = math.ceil(0.2 * (n - test))
    assert (split.get("test", 0), split.get("dev", 0), split.get("train", 0)) == (test, dev, n - test - dev)


def test_split_does_not_depend_on_partitioning(spark):
    one = {r["k"]: r["split"] for r in keyed.train_dev_test(numbers(spark, 300, 1), ["k"]).collect()}
    many = {r["k"]: r["split"] for r in keyed.train_dev_test(numbers(spark, 300, 7), ["k"]).collect()}
    assert one == many


def test_positional_split_caps_dev(spark):
    rows = keyed.positional_split(numbers(spark, 100), ["k"], max_dev=5).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["id"]) if r["split"] == "dev"] == [95, 96, 97, 98, 99]
    assert sum(r["split"] == "dev" for r in keyed.positional_split(numbers(spark, 101), ["k"]).collect()) == 21


def test_sample(spark):
    df = numbers(spark, 200).union(numbers(spark, 200)).union(spark.createDataFrame([(None, None)], "id long, k string"))
    first = {r["k"] for r in keyed.sample_n(df, "k", 50).collect()}
    assert len(first) == 50 and None not in first
    assert first == {r["k"] for r in keyed.sample_n(df.repartition(7), "k", 50).collect()}
    assert first != {r["k"] for r in keyed.sample_n(df, "k", 50, seed=1).collect()}


def test_spread_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("c", 4)], "k string, v int")
    right = spark.createDataFrame([("a", "x")], "k string, w string")
    rows = {(r["v"], r["w"]) for r in keyed.spread_join(left, right, ["k"], F.col("k").isNotNull()).collect()}
    assert rows == {(1, "x"), (2, None), (3, None), (4, None)}
    kept = keyed.spread_join(left, right.select("k"), ["k"], F.col("k").isNotNull(), "left_anti")
    assert {r["v"] for r in kept.collect()} == {2, 3, 4}


def test_first_per_key_on_a_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    rows = keyed.first_per_key(df.repartition(8), ["k"], ["v"])
    assert rows.filter("k = -1").first()["v"] == 0
    assert rows.count() == df.select("k").distinct().count()


def test_rows_that_ask_nothing_are_keyed_by_content(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"), F.create_map(F.lit("a"), "id").alias("m"))
    lookup = spark.range(0, 1000, 20).select(F.col("id").alias("k"), F.lit(1).alias("hit")).hint("merge")
    joined = keyed.spread_join(rows, lookup, ["k"], F.col("k").isNotNull())
    plan = joined._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan and "xxhash64" in plan
    assert joined.count() == 1000 and joined.filter("hit = 1").count() == 50 and joined.columns == ["k", "v", "m", "hit"]
    assert keyed.spread_join(rows, lookup, ["k"], F.col("k").isNotNull(), "left_anti").count() == 950


@pytest.mark.parametrize(("n", "max_dev"), [(0, 5), (1, 5), (7, 1), (1000, 200_000), (1000, 60), (1000, 0)])
def test_positional_split_selects_the_cut(spark, n, max_dev):
    rows = spark.range(n).repartition(3).select(F.when(F.col("id") >= 4, F.col("id") % 4).alias("a"), F.format_string("%05d", F.col("id") * 7 % 1009).alias("b"), F.lit("x" * 50).alias("text"))
    split = keyed.positional_split(rows, ["a", "b"], max_dev=max_dev)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange rangepartitioning" not in plan
    got = sorted(((r["a"] is not None, r["a"] or 0, r["b"]), r["split"]) for r in split.collect())
    train = max(int(0.8 * n), n - max_dev)
    assert [s for _, s in got] == ["train"] * train + ["dev"] * (n - train)
