"""Reply, quote and retweet counts per post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweir.schema import COUNT_COLUMNS


def interaction_edges(posts: DataFrame, count_replies: bool = True) -> DataFrame:
    """(kind, target) for every reply, quote and retweet; a retweeted quote is no quote."""
    candidates = [
        F.struct(F.lit("quote").alias("kind"), F.when(~F.col("is_retweet"), F.col("quoted_status_id")).alias("target")),
        F.struct(F.lit("retweet").alias("kind"), F.col("retweeted_status_id").alias("target")),
    ]
    if count_replies:
        candidates.append(F.struct(F.lit("reply").alias("kind"), F.col("in_reply_to_status_id").alias("target")))
    edges = posts.select(F.explode(F.array(*candidates)).alias("e")).select("e.kind", "e.target")
    return edges.filter(F.col("target").isNotNull())


def interaction_counts(posts: DataFrame, count_replies: bool = True) -> DataFrame:
    """One row per target: the three counts in a single aggregation over distinct posts."""
    return (
        interaction_edges(posts, count_replies)
        .groupBy(F.col("target").alias("id"))
        .agg(
            F.count_if(F.col("kind") == "reply").alias("num_replies"),
            F.count_if(F.col("kind") == "quote").alias("num_quotes"),
            F.count_if(F.col("kind") == "retweet").alias("num_retweets"),
        )
    )


def with_counts(posts: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the counts to the posts, 0 where a post has none."""
    joined = posts.join(counts, "id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in COUNT_COLUMNS})
