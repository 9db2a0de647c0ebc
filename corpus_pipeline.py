"""A training-data pipeline: filter, de-duplicate, decontaminate, mask and pack whole documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; each but the last returns the columns it got. Rows are told
apart by doc_id; null texts count as empty, rows without an id are never taken for copies.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweir.llm import leaks, packing, partenum, pii, toxicity
from postweir.llm.catalog import CATEGORIES, table
from postweir.llm.tokens import tokenizer_path
from postweir.session import scratch_path, ship_package


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and the rest of the row as one column, so that no column of it clashes with those that an operator adds."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers, trained on the labelled ones, doesn't call toxic."""
    ship_package(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), CATEGORIES)
    return _unpacked(toxicity.score(_packed(docs), model, CATEGORIES, keep=["text", "row"]).where(F.col("p_toxic") <= toxicity.THRESHOLD), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by near similarity, the one with the least id; of rows of that id in the group, one.

    Rows that share an id but are in other groups are documents of their own, and so are those without words or without an id.
    """
    ship_package(spark)
    found = partenum.near_duplicates(docs).where("doc_id IS NOT NULL AND n_shingles > 0")
    # of the rows with the group's least id, those of the least text hash stay; all are in the same task as their id is the group's name
    least = F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("text_hash"))).over(Window.partitionBy("doc_id", "component_id"))
    marked = found.withColumn("_stays", F.coalesce(F.col("text_hash") == least, F.lit(False)))
    per_text = marked.groupBy("doc_id", "text_hash").agg(F.max("_stays").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    changed = per_text.where("NOT _stays OR _rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_stays")
    # a merge join whatever the size, as the ids grow with the texts; the window then needs no shuffle of its own
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    joined = keyed.join(changed.hint("merge"), ["_id", "_hash"], "left")
    place = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash"))
    kept = joined.withColumn("_place", place).where(F.col("_stays").isNull() | (F.col("_stays") & (F.col("_place") == 1)))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    ship_package(spark)
    return _unpacked(leaks.find_leaks(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["text", "row"]).where(F.size("leaks") == 0), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [KIND] in the place of personal data; n_chars follows the text."""
    ship_package(spark)
    return pii.mask_personal_data(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path(), end=1)


STAGES = [
    ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data), ("packing", pack_documents),
]
ORACLE_SQL = None  # a trained filter and token ids are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        path = os.path.join(root, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
