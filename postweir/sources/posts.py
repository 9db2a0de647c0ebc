"""Extracted posts at rest: parquet, partitioned by day and hour of the post itself."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postweir.session import remove_path, scratch_path, session_conf


def interval_columns(by: str = "hour") -> dict[str, Column]:
    """Partition columns of the interval a post belongs to."""
    day = {"dt": F.date_format("created_at", "yyyy-MM-dd")}
    return {**day, "hour": F.hour("created_at")} if by == "hour" else day


def write_posts(posts: DataFrame, path: str, mode: str = "overwrite", by: str = "hour", dynamic: bool = False) -> int:
    """Write one folder per interval of `created_at`, rows sorted in each file; returns the row count.

    REBALANCE brings an interval together where it is small and splits it where it is not, so
    an hour that holds a third of all posts becomes several files. The count is observed in
    the same pass. With `dynamic`, only folders that receive rows are replaced.
    """
    seen = Observation("written")
    parts = interval_columns(by)
    placed = posts.withColumns(parts)
    ordered = (
        placed.observe(seen, F.count(F.lit(1)).alias("rows"))
        .hint("rebalance", *parts)
        .sortWithinPartitions(*parts, "created_at")
    )
    # few rows in many hours: opening files is the work, so small partitions stay apart
    with session_conf(posts.sparkSession, spark__sql__adaptive__coalescePartitions__minPartitionSize="16k"):
        ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*parts).parquet(path)
    return seen.get["rows"]


def _folders(df: DataFrame, by: str) -> set[tuple[str | None, int | None]]:
    """The (dt, hour) pairs of a table; bounded by the hours there are."""
    parts = list(interval_columns(by))
    return {(row["dt"], row["hour"] if by == "hour" else None) for row in df.select(*parts).distinct().collect()}


def _in_folders(folders: set[tuple[str | None, int | None]], by: str) -> Column:
    """A condition on the partition columns alone, so that Spark drops the other folders while planning."""
    hours: dict[str | None, list[int | None]] = {}
    for day, hour in sorted(folders, key=str):
        hours.setdefault(day, []).append(hour)
    condition = F.lit(False)
    for day, some in hours.items():
        here = F.col("dt").eqNullSafe(F.lit(day).cast("string"))
        if by == "hour":
            known = [h for h in some if h is not None]
            here = here & (F.coalesce(F.col("hour").isin(known), F.lit(False)) | (F.col("hour").isNull() if None in some else F.lit(False)))
        condition = condition | here
    return condition


def _folder_path(path: str, folder: tuple[str | None, int | None], by: str) -> str:
    none = "__HIVE_DEFAULT_PARTITION__"
    day, hour = folder
    return f"{path}/dt={none if day is None else day}" + (f"/hour={none if hour is None else hour}" if by == "hour" else "")


def stage_merge(posts: DataFrame, path: str, staged: str, merged: str, by: str = "hour", ids: DataFrame | None = None) -> list[str]:
    """Write the whole content of the folders that `merge_posts` is to replace to `merged`; returns the folders that it leaves empty. Nothing is changed yet.

    The folders that hold posts of `ids` or receive new ones are found first, from the ids alone, and become literal conditions on the partition
    columns; only they are read. Posts without a time have a folder of their own.
    """
    spark = posts.sparkSession
    posts.withColumns(interval_columns(by)).write.parquet(staged)
    new = spark.read.parquet(staged)
    parts = list(interval_columns(by))
    gone = new.select("id") if ids is None else ids.select("id")
    stored = spark.read.parquet(path).withColumn("dt", F.date_format("dt", "yyyy-MM-dd"))
    before = _folders(stored.select("id", *parts).join(gone, "id", "left_semi"), by)
    folders = before | _folders(new, by)
    kept = stored.filter(_in_folders(folders, by)).join(gone, "id", "left_anti")
    new.unionByName(kept.select(new.columns)).write.parquet(merged)
    return [_folder_path(path, folder, by) for folder in sorted(before - _folders(spark.read.parquet(merged), by), key=str)]


def apply_merge(spark: SparkSession, merged: str, path: str, emptied: list[str], by: str = "hour") -> int:
    """Replace the folders by their merged content. Done again after a failure, it gives the same table."""
    written = write_posts(spark.read.parquet(merged).drop(*interval_columns(by)), path, by=by, dynamic=True)
    for folder in emptied:
        remove_path(spark, folder)
    return written


def merge_posts(posts: DataFrame, path: str, by: str = "hour", ids: DataFrame | None = None) -> int:
    """Put posts into a written table in the place of the stored posts of `ids` (id; by default those of the new posts).

    Only the folders concerned are read and replaced. The merged rows are staged because a table cannot be read and replaced at once. A folder that is left empty is removed.
    """
    spark = posts.sparkSession
    staged, merged = scratch_path(spark, "new-posts"), scratch_path(spark, "merged-posts")
    emptied = stage_merge(posts, path, staged, merged, by, ids)
    written = apply_merge(spark, merged, path, emptied, by)
    for scratch in (staged, merged):
        remove_path(spark, scratch)
    return written


def _bound(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.strptime(value, "%Y-%m-%d")


def first_files(df: DataFrame, n: int) -> list[str]:
    """The first n files by name among those the filters of `df` leave; no column is read for it."""
    paths = df.select(F.col("_metadata.file_path").alias("path")).distinct().orderBy("path").limit(n)
    return [unquote(row["path"]) for row in paths.collect()]


def read_posts(spark: SparkSession, path: str, cols: list[str] | None = None, start: str | datetime | None = None,
               end: str | datetime | None = None, num_files: int | None = None,
               transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Posts whose interval starts strictly after `start` and strictly before `end`.

    An hour counts by its first instant, so the hour at `start` itself is left out. The
    conditions only use partition columns; Spark prunes folders. `transform` is applied to
    the selected rows.
    """
    reader = spark.read.option("basePath", path)
    df = reader.parquet(path)
    slot = F.to_timestamp_ntz(F.col("dt").cast("string"), F.lit("yyyy-MM-dd"))
    if "hour" in df.columns:
        slot = slot + F.make_dt_interval(F.lit(0), F.col("hour"))
    condition = F.lit(True)
    if start is not None:
        condition = condition & (slot > F.lit(_bound(start).isoformat(" ")).cast("timestamp_ntz"))
    if end is not None:
        condition = condition & (slot < F.lit(_bound(end).isoformat(" ")).cast("timestamp_ntz"))
    df = df.filter(condition)
    if num_files is not None:
        files = first_files(df, num_files)
        df = reader.schema(df.schema).parquet(*files) if files else df.limit(0)
    if cols is not None:
        df = df.select(*cols)
    return transform(df) if transform else df


def register_posts(spark: SparkSession, path: str, name: str = "posts") -> None:
    """Make a written table available to `spark.sql`."""
    read_posts(spark, path).createOrReplaceTempView(name)
