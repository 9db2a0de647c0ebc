"""Bio corpora on disk, their languages, and the merged predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.operators import corpus, language
from postweir.operators.keyed import positional_split, sample_n
from postweir.operators.predictions import merge_predictions
from postweir.operators.totals import RowTotals
from postweir.session import ship_package, stage
from postweir.sources.shards import MAX_ROWS, read_shards, write_sharded


def write_prediction_corpus(sources: list[DataFrame], out: str, order: list[str], max_rows: int = MAX_ROWS) -> dict[str, int]:
    """Write the shards; returns the row totals after each step."""
    ship_package(sources[0].sparkSession)
    totals = RowTotals()
    bios = corpus.prediction_corpus(sources, order, watch=totals)
    write_sharded(bios.select("user_id", "user_description", "lang"), out, "user_description", max_rows)
    return totals.rows()


def write_pretrain_corpus(sources: list[DataFrame], annotated: DataFrame, out: str, order: list[str],
                          language: str | None = None, max_rows: int = MAX_ROWS) -> None:
    """`out`/train and `out`/dev, cut along (source, order…); the order must identify a row of a source."""
    ship_package(sources[0].sparkSession)
    rows = stage(corpus.pretrain_corpus(sources, annotated, order, language=language), "corpus")
    split = positional_split(rows, ["source", *order])
    for part in ("train", "dev"):
        rows = split.filter(F.col("split") == part).select("user_id", "user_description")
        write_sharded(rows, f"{out}/{part}", "user_description", max_rows)


def write_languages(spark: SparkSession, corpus_path: str, profiles: DataFrame, out: str) -> None:
    """(user_id, userbio_lang) of a written corpus."""
    found = language.detect_lang(read_shards(spark, corpus_path), profiles, ["user_id"], "user_description")
    found.withColumnRenamed("detected", "userbio_lang").write.mode("overwrite").parquet(out)


def write_merged_predictions(spark: SparkSession, corpus_path: str, types: DataFrame, categories: DataFrame,
                             languages: DataFrame, out: str) -> None:
    users = read_shards(spark, corpus_path).select("user_id")
    merge_predictions(users, [types, categories, languages]).write.mode("overwrite").parquet(out)


def bot_check_names(posts: DataFrame, column: str = "user_screen_name", n: int = 5000, seed: int = 42) -> DataFrame:
    """The names whose accounts are to be scored."""
    return sample_n(posts, column, n, seed)
