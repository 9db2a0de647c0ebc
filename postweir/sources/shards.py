"""Text shards: the same rows once as parquet and once as one text line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 1_000_000


def write_sharded(df: DataFrame, path: str, text_col: str, max_rows: int = MAX_ROWS) -> None:
    """`path`/parquet with all columns and `path`/txt with the text, at most `max_rows` rows per file.

    The text is written from the parquet files, so both hold the same rows although the input is
    computed once. Rows are tied together by their key columns, not by position.
    """
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(f"{path}/parquet")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet")
    rows.select(text_col).write.mode("overwrite").option("maxRecordsPerFile", max_rows).text(f"{path}/txt")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parquet")
