"""Bot scores and their join with annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_bots(scores: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Flat scores of the accounts that were found; `is_bot` above the threshold, false without a score."""
    return scores.filter(F.col("user").isNotNull()).select(
        F.col("user.id_str").alias("user_id"),
        F.col("user.screen_name").alias("user_screen_name"),
        F.col("cap.universal").alias("cap_universal"),
        F.col("cap.english").alias("cap_english"),
        F.col("scores.english").alias("score_english"),
        F.col("scores.universal").alias("score_universal"),
        F.coalesce(F.col("cap.universal") > threshold, F.lit(False)).alias("is_bot"),
    )


def join_annotations(bots: DataFrame, annotated: DataFrame, null_safe: bool = False) -> DataFrame:
    """Inner join on the screen name; `null_safe` also pairs rows without one."""
    named = annotated.withColumnRenamed("username", "user_screen_name")
    if not null_safe:
        return bots.join(named, "user_screen_name")
    renamed = named.withColumnRenamed("user_screen_name", "_name")
    return bots.join(renamed, F.col("user_screen_name").eqNullSafe(F.col("_name"))).drop("_name")
