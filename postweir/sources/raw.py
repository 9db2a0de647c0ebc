"""Raw captures: line files under root/Y/M/D/H, plain or gzip."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweir.functions.once import once
from postweir.schema import CORRUPT, RAW_POST_WITH_CORRUPT

# folders are plain (2020/05/07/10) or carry their partition name (y=2020/m=05/d=07/h=10)
_HOUR_PATH = r"/(?:\w+=)?(\d{4})/(?:\w+=)?(\d{2})/(?:\w+=)?(\d{2})/(?:\w+=)?(\d{2})/[^/]+$"
DAY, HOUR = "day", "hour"


def path_interval(path: Column, by: str = HOUR) -> Column:
    """'YYYY_MM_DD' or 'YYYY_MM_DD_HH' from the folders of a path."""
    groups = [F.regexp_extract(path, _HOUR_PATH, i) for i in range(1, 5 if by == HOUR else 4)]
    return F.when(groups[0] != "", F.concat_ws("_", *groups))


def list_files(spark: SparkSession, root: str, by: str = HOUR) -> DataFrame:
    """(interval, file) of every capture file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(path_interval(F.col("path"), by).alias("interval"), F.col("path").alias("file")).filter(
        F.col("interval").isNotNull()
    )


def in_interval_range(interval: Column, start: str | None = None, end: str | None = None) -> Column:
    """Half-open range on interval keys, bounds as 'YYYY-MM-DD' or 'YYYY-MM-DD-HH'."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (interval >= start.replace("-", "_"))
    if end is not None:
        condition = condition & (interval < end.replace("-", "_"))
    return condition


def read_raw(spark: SparkSession, root: str, start: str | None = None, end: str | None = None,
             intervals: list[str] | None = None, by: str = HOUR) -> DataFrame:
    """Lines with their place in the capture.

    The interval conditions only concern the file path, so Spark drops files while planning and
    never opens them. Within one file block, `line_no` grows with the line.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    interval = path_interval(F.col("_metadata.file_path"), by)
    wanted = interval.isNotNull() & in_interval_range(interval, start, end)
    if intervals is not None:
        wanted = wanted & interval.isin(intervals)
    return lines.filter(wanted).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
    )


@F.pandas_udf(T.StringType())
def _literal_to_json(lines: pd.Series) -> pd.Series:
    def convert(line: str) -> str | None:
        try:
            value = ast.literal_eval(line)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return json.dumps(value) if isinstance(value, dict) else None

    return lines.map(convert, na_action="ignore")


def parse_all(lines: DataFrame) -> DataFrame:
    """(post, bad, position) of each line that holds either: a post as struct, or the line itself if it is neither JSON nor a Python literal.

    Empty lines and objects without an id are left out. Only lines that are no JSON reach Python.
    """
    schema = RAW_POST_WITH_CORRUPT
    parsed = lines.filter(F.length("value") > 1).withColumn(
        "_json", once(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    )
    broken = F.col("_json.id").isNull() & (F.col("_json").isNull() | F.col(f"_json.{CORRUPT}").isNotNull())
    parsed = parsed.withColumn("_fixed", _literal_to_json(F.when(broken, F.col("value"))))
    parsed = parsed.withColumn(
        "post", once(F.when(F.col("_fixed").isNotNull(), F.from_json("_fixed", schema)).otherwise(F.col("_json")))
    )
    found = parsed.select(
        F.when(F.col("post.id").isNotNull(), F.col("post")).alias("post"), F.when(broken & F.col("_fixed").isNull(), F.col("value")).alias("bad"),
        "file_path", "block_start", "line_no",
    )
    return found.filter(F.col("post").isNotNull() | F.col("bad").isNotNull())


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): posts as struct `post`, and broken lines as `value`, each with its position.

    A job that wants both writes `parse_all` once and reads it twice.
    """
    both, place = parse_all(lines), ["file_path", "block_start", "line_no"]
    return both.filter(F.col("post").isNotNull()).select("post", *place), both.filter(F.col("bad").isNotNull()).select(F.col("bad").alias("value"), *place)


def pending_intervals(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Intervals whose set of files differs from the ledger's, each to be recomputed whole.

    Both tables are (interval, file). Sets are compared by one full join, never collected.
    """
    seen = files.select("interval", "file").distinct().withColumn("_now", F.lit(True))
    used = ledger.select("interval", "file").distinct().withColumn("_then", F.lit(True))
    both = seen.join(used, ["interval", "file"], "full").groupBy("interval").agg(
        F.count("_now").alias("_files"),
        F.count_if(F.col("_now").isNull() | F.col("_then").isNull()).alias("_different"),
    )
    return both.filter((F.col("_files") > 0) & (F.col("_different") > 0)).select("interval")


def updated_ledger(files: DataFrame, ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger after `done` intervals were processed with the listed files."""
    kept = ledger.select("interval", "file").join(done.select("interval"), "interval", "left_anti")
    added = files.select("interval", "file").join(done.select("interval"), "interval", "left_semi")
    return kept.unionByName(added.distinct())
