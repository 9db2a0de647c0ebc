"""The smaller inputs and outputs, each with a given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.schema import ANNOTATION, BOT_SCORES, CROWD_TASK, LABELLED_TEXT, PREDICTION


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Keyword list, one per line; the line's number, from 0, is the keyword's. Meant for hundreds of entries.

    A blank line keeps its number and matches nothing; line ends may be those of any system.
    """
    row = spark.read.text(path, wholetext=True).first()
    return row["value"].removesuffix("\n").replace("\r", "").split("\n") if row and row["value"] else []


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id != ''").distinct()


#: Columns that order the rows of a file that has no key, for `zip_rows`.
POSITION = ["file_path", "block_start", "line_no"]


def with_position(df: DataFrame) -> DataFrame:
    """Add the place of each row of a file source; `line_no` grows with the row within a block."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def read_predictions(spark: SparkSession, path: str, name: str, position: bool = False) -> DataFrame:
    """Prediction lines; `label` and its probabilities are renamed after the run. With `position`, also the columns POSITION."""
    df = spark.read.schema(PREDICTION).json(path)
    df = with_position(df) if position else df
    return df.withColumnsRenamed({"label": f"{name}_label", "label_probabilities": f"{name}_probabilities"})


def read_labelled_csv(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    df = spark.read.schema(LABELLED_TEXT).csv(path, header=True, multiLine=True, escape='"')
    return with_position(df) if position else df


def read_crowd_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The wide table of a crowd task: five fields for each of ten users."""
    return spark.read.schema(CROWD_TASK).csv(path, header=True, multiLine=True, escape='"')


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated users as JSON lines: four annotators' labels, lists of labels, and the estimates."""
    return spark.read.schema(ANNOTATION).json(path)


def write_labelled_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_bot_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOT_SCORES).json(path)


def write_metrics(report: DataFrame, path: str) -> None:
    """One JSON line per metric, in a folder per run."""
    report.write.mode("overwrite").partitionBy("run").json(path)
