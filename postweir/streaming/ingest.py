"""The capture as a stream of files. Batch extraction stays the reference for exact results: stream
state is bounded, so a copy of a post that arrives later than the watermark appears again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from postweir.operators.extraction import LINE_ORDER, distinct_posts, finish_posts, post_copies
from postweir.session import path_exists, remove_path, stage
from postweir.sources.posts import interval_columns
from postweir.sources.raw import parse_lines


def stream_raw(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Lines of new capture files; the stream's checkpoint takes the place of the file ledger."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(root).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.lit(0).cast("bigint").alias("line_no"),
    )


def stream_posts(lines: DataFrame) -> DataFrame:
    """Flat top-level posts of a line stream."""
    good, _ = parse_lines(lines)
    return post_copies(good, emit_nested=False)


def stream_table(lines: DataFrame, keywords: list[str], stop_words: list[str], extract_retweets: bool = False,
                 extract_quotes: bool = True, by: str = "hour") -> DataFrame:
    """The rows and columns of the batch table without its counts: retained top-level posts, normalised and tagged, with `dt` and `hour`.

    Nested copies and counts need all lines and stay with the batch extraction. Write it with `partition_by` dt and hour.
    """
    posts = finish_posts(stream_posts(lines), keywords, stop_words, extract_retweets, extract_quotes)
    return posts.withColumns(interval_columns(by))


def dedup_stream(posts: DataFrame, time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    return posts.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def winning_copies(copies: DataFrame, time: str = "created_at", delay: str = "1 hour", keep_hours: int = 24) -> DataFrame:
    """Copies of posts (`post_copies`) that may win, for `write_winners`: a top-level copy beats a nested one, then the earlier line.

    Each carries its time (`seen`) and the time until which its place is held against later copies (`until`): `delay` and `keep_hours` past its own. Posts without a
    time are left to the batch.
    """
    until = F.col(time) + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {keep_hours} HOURS")
    return copies.filter(F.col(time).isNotNull()).withColumns({"seen": F.col(time), "until": until})


def write_winners(winners: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each trigger's winners go to a folder of the trigger's number, which a repeated trigger replaces; `read_winners` settles them.

    A trigger ranks its own copies by joins and sorts of Spark, one row a post, and writes those that are better than the place of the post in the folders before. Only the columns of the
    place are read there, and only of posts that are held: until the stream has seen a time past `until`. So a better copy in a later trigger is a correction, and the best
    of the written copies is the batch winner, also of a post that is no longer held.
    """
    place = lambda prefix="": F.struct(*[F.col(f"{prefix}{c}") for c in LINE_ORDER])

    def add(batch: DataFrame, number: int) -> None:
        best = distinct_posts(batch)
        if number and path_exists(batch.sparkSession, path):
            held = batch.sparkSession.read.schema(StructType([*batch.schema, StructField("batch", LongType())])).parquet(path).filter(F.col("batch") < number)
            latest = held.agg(F.max("seen")).first()[0]
            places = held.filter(F.col("until") >= F.lit(latest)).groupBy("id").agg(F.min(place()).alias("place"))
            best = best.join(places, "id", "left").filter(F.col("place").isNull() | (place() < F.col("place"))).select(*batch.columns)
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return winners.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_winners(spark: SparkSession, path: str) -> DataFrame:
    """One row for each post: the best copy that any trigger emitted."""
    return distinct_posts(spark.read.parquet(path).drop("batch", "seen", "until"))


def hourly_counts(edges: DataFrame, time: str = "created_at", target: str = "target", delay: str = "1 hour") -> DataFrame:
    """Interactions per hour and target, each hour emitted once it can no longer change."""
    counts = edges.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), target).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("hour_start"), target, "n")


def open_hours(edges: DataFrame, emitted: DataFrame, time: str = "created_at", target: str = "target") -> DataFrame:
    """Counts of the hours that a finished run of `hourly_counts` still held back, from the stored edges.

    An hour is emitted whole, so the hours missing in `emitted` are those to count; an hour is one of few, and the join has
    one row for each.
    """
    hours = edges.withColumn("hour_start", F.date_trunc("hour", time))
    rest = hours.join(emitted.select("hour_start").distinct(), "hour_start", "left_anti")
    return rest.groupBy("hour_start", target).agg(F.count(F.lit(1)).alias("n"))


def count_hours(edges: DataFrame, path: str, checkpoint: str, time: str = "created_at", target: str = "target") -> StreamingQuery:
    """Count everything available now, whatever its time, and stop: each trigger's interactions per hour and target go to a folder of the trigger's number.

    There is no watermark and no state to outgrow: an edge that comes late adds to its hour, however long ago that was emitted. A trigger that is run again
    after a failure replaces its own folder, so nothing counts twice. `hour_totals` reads the sums, `compact_hours` keeps the folders few.
    """
    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.date_trunc("hour", time).alias("hour_start"), F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_HOUR_COUNTS = "hour_start timestamp, target string, n bigint, batch bigint"


def hour_totals(spark: SparkSession, path: str) -> DataFrame:
    """(hour_start, target, n) over all triggers of `count_hours`. Folders that a compaction has taken in are left out, also if it was cut off before it removed them."""
    counts = spark.read.schema(_HOUR_COUNTS).parquet(path)
    taken = counts.agg(F.min("batch")).first()[0]  # a compaction of the triggers up to k is the folder -1 - k
    if taken is not None and taken < 0:
        counts = counts.filter((F.col("batch") == taken) | (F.col("batch") > -1 - taken))
    return counts.groupBy("hour_start", "target").agg(F.sum("n").alias("n"))


def compact_hours(spark: SparkSession, path: str) -> None:
    """Bring the folders of all triggers so far into one. Run it while no stream writes there."""
    batches = [r["batch"] for r in spark.read.schema(_HOUR_COUNTS).parquet(path).select("batch").distinct().collect()]  # one number a trigger since the last time
    if not batches:
        return
    upto = max(max(batches), *(-1 - b for b in batches if b < 0), 0)
    staged = stage(hour_totals(spark, path), "hours")
    staged.write.mode("overwrite").parquet(f"{path}/batch={-1 - upto}")
    for b in batches:
        if b != -1 - upto:
            remove_path(spark, f"{path}/batch={b}")


def write_stream(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append everything available now to parquet and stop."""
    writer: DataStreamWriter = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)
