"""Crowd annotations to data sets, and predictions on them to metrics and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweir.operators import annotations, bots, evaluation, language, significance
from postweir.session import ship_package
from postweir.sources.tables import write_labelled_csv, write_metrics

CROWD_FIELDS = ["bio", "username", "screenname", "n_retweets", "covid_tweeting_language"]


def with_original_bios(annotated: DataFrame, crowd: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations with `bio_original` from the wide crowd table (ten users a row) and its language."""
    originals = annotations.unpivot_numbered(crowd, CROWD_FIELDS, 10).withColumnRenamed("bio", "bio_original")
    filled = annotations.backfill_bios(annotated, originals)
    rows = [*keys, "bio_original"]
    # a user with several originals has several rows, told apart by the text itself
    found = language.detect_lang(filled.select(*rows).distinct(), profiles, rows, "bio_original")
    return filled.join(found.withColumnRenamed("detected", "bio_original_lang"), rows, "left")


def write_training_data(annotated: DataFrame, out: str, order: list[str], seed: int = 42) -> None:
    """Clean the annotations and write the twelve data sets with their splits."""
    ship_package(annotated.sparkSession)
    clean = annotations.clean_annotations(annotated, order)
    fan = annotations.dataset_fanout(clean.withColumn("row_key", F.concat_ws("\x1f", "text_translated", "text_original")), ["row_key"], seed)
    annotations.write_datasets(fan, out)


def write_report(predicted: DataFrame, out: str) -> None:
    """Metrics per run as JSON and the predicted rows (run, text, label, prediction) as CSV."""
    write_metrics(evaluation.classification_report(predicted), f"{out}/metrics")
    write_labelled_csv(predicted.select("run", "text", "label", "prediction"), f"{out}/rows")


def language_effects(predicted: DataFrame, languages: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided test of the accuracy in each language; rows without text are left out."""
    correct = predicted.filter(F.col("text").isNotNull()).withColumn(
        "is_correct", evaluation.is_correct(F.col("label"), F.col("prediction"))
    )
    return significance.group_significance(correct.join(languages, keys, "left"), "detected", "is_correct")


def bot_shares(scores: DataFrame, annotated: DataFrame, label: str) -> DataFrame:
    """One-sided test for more bots than on average, per annotated label."""
    joined = bots.join_annotations(bots.flatten_bots(scores), annotated)
    return significance.group_significance(joined, label, "is_bot", "greater")
