"""Which groups differ from the overall success rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweir.functions.stats import binomial_test


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def group_significance(df: DataFrame, group: str, success: str, alternative: str = "two-sided",
                       level: float = 0.05) -> DataFrame:
    """Successes, trials, fraction, p-value and Bonferroni flag per group.

    Rows without a group count towards the overall rate only. The test gets one row per group; the input is evaluated once.
    """
    hit = F.col(success).cast("int")
    # one pass over the input; what follows has one row per group
    counted = df.groupBy(F.col(group).alias("grp")).agg(F.sum(hit).alias("successes"), F.count(hit).alias("trials"))
    over = Window.partitionBy(F.lit(0))
    rated = counted.select(
        "*", (F.sum("successes").over(over) / F.sum("trials").over(over)).alias("overall"), F.count("grp").over(over).alias("tests")
    ).filter(F.col("grp").isNotNull())
    tested = rated.withColumn("p_value", binomial_test(F.col("successes"), F.col("trials"), F.col("overall"), alternative))
    return tested.select(
        "grp", "successes", "trials",
        F.when(F.col("trials") > 0, F.col("successes") / F.col("trials")).alias("fraction"),
        "p_value",
        (F.col("p_value") < F.lit(level) / F.col("tests")).alias("is_sig"),
    )
