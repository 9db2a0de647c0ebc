"""From a labelled test file and keyless prediction lines to rows and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.operators.evaluation import classification_report, is_correct
from postweir.operators.keyed import zip_rows
from postweir.sources import tables


def positional_rows(spark: SparkSession, test_csv: str, predictions: str, run: str) -> DataFrame:
    """(run, text, label, prediction, is_correct): the nth line of the predictions belongs to the nth row of the test file; unequal lengths fail."""
    test = tables.read_labelled_csv(spark, test_csv, position=True).withColumnsRenamed({c: f"_t_{c}" for c in tables.POSITION})
    guessed = tables.read_predictions(spark, predictions, "pred", position=True).withColumnsRenamed({c: f"_p_{c}" for c in tables.POSITION})
    glued = zip_rows([test, guessed], [[f"_t_{c}" for c in tables.POSITION], [f"_p_{c}" for c in tables.POSITION]])
    return glued.select(
        F.lit(run).alias("run"), "text", "label", F.col("pred_label").alias("prediction"), is_correct(F.col("label"), F.col("pred_label")).alias("is_correct"),
    )


def run_test_report(spark: SparkSession, test_csv: str, predictions: str, run: str, out: str, **options) -> DataFrame:
    """Write the glued rows to out/rows and the metrics to out/metrics; `options` go to `classification_report`."""
    rows_path = f"{out}/rows"
    positional_rows(spark, test_csv, predictions, run).write.mode("overwrite").parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    report = classification_report(rows, **options)
    tables.write_metrics(report, f"{out}/metrics")
    return report
