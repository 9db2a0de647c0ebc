"""Annotated users: back-filling bios, cleaning labels and building the data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweir.functions import labels as L
from postweir.functions.text import compose_text, preprocess
from postweir.operators.keyed import first_per_key, with_exact_split


def unpivot_numbered(df: DataFrame, fields: list[str], count: int) -> DataFrame:
    """field_1 … field_count stacked in parallel: one row per number, one column per field."""
    rows = [
        F.struct(F.lit(i).alias("position"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i in range(1, count + 1)
    ]
    return df.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def backfill_bios(annotated: DataFrame, originals: DataFrame) -> DataFrame:
    """Add `bio_original` by user name, the annotated bio where there is none; several originals multiply the row."""
    named = originals.filter(F.col("username").isNotNull()).select("username", "bio_original")
    joined = annotated.join(named, "username", "left")
    return joined.withColumn("bio_original", F.coalesce("bio_original", "bio"))


def clean_annotations(df: DataFrame, order: list[str]) -> DataFrame:
    """Clean texts, keep the first row per text pair, shorten labels, flag ambiguous rows."""
    texts = df.withColumns({
        "text_translated": preprocess(F.col("bio")),
        "text_original": preprocess(F.col("bio_original")),
        "screenname": preprocess(F.col("screenname")),
        "username": preprocess(F.col("username")),
    })
    rows = first_per_key(texts, ["text_translated", "text_original"], order)
    four = range(1, 5)
    changed: dict[str, Column] = {}
    changed.update({f"type{i}": L.map_label(F.col(f"type{i}"), L.TYPES) for i in four})
    changed.update({f"coarsetype{i}": L.map_label(F.col(f"coarsetype{i}"), L.TYPES_MERGED) for i in four})
    changed["estimated_coarse_type"] = L.map_label(F.col("estimated_coarse_type"), L.TYPES_MERGED)
    changed.update({f"category{i}": L.map_labels(F.col(f"category{i}"), L.CATEGORIES) for i in four})
    changed.update({f"coarsecat{i}": L.map_labels(F.col(f"coarsecat{i}"), L.CATEGORIES_MERGED) for i in four})
    changed["estimated_coarse_majority_category"] = L.map_label(
        F.col("estimated_coarse_majority_category"), L.CATEGORIES_MERGED
    )
    changed["estimated_gender"] = L.map_label(F.col("estimated_gender"), L.GENDERS)
    mapped = rows.withColumns(changed)

    def four_of(name: str) -> list[Column]:
        return [F.col(f"{name}{i}") for i in four]

    return mapped.withColumns({
        "type_is_ambiguous": L.is_ambiguous(*four_of("type")),
        "type_merged_is_ambiguous": L.is_ambiguous(*four_of("coarsetype")),
        "category_is_ambiguous": L.is_ambiguous_multi(*four_of("category")),
        "category_merged_is_ambiguous": L.is_ambiguous_multi(*four_of("coarsecat")),
    })


def dataset_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fan out to the twelve data sets: (dataset, keys…, text, label), rows without a label dropped.

    One pass: each row is exploded into the data sets it belongs to.
    """
    copies = []
    for text_col, suffix in (("text_translated", ""), ("text_original", "_multilang")):
        named = compose_text(F.col("username"), F.col("screenname"), F.col(text_col))
        for kind, label, ambiguous in (
            ("type_merged", "estimated_coarse_type", "type_merged_is_ambiguous"),
            ("category_merged", "estimated_coarse_majority_category", "category_merged_is_ambiguous"),
        ):
            for variant, text, member in (
                ("", F.col(text_col), F.lit(True)),
                ("_unambiguous", F.col(text_col), ~F.col(ambiguous)),
                ("_with_username", named, F.lit(True)),
            ):
                copies.append(F.struct(
                    F.lit(f"{kind}{variant}{suffix}").alias("dataset"),
                    text.alias("text"),
                    F.col(label).alias("label"),
                    member.alias("member"),
                ))
    rows = df.select(*keys, F.explode(F.array(*copies)).alias("d"))
    return rows.filter(F.col("d.member") & F.col("d.label").isNotNull()).select("d.dataset", *keys, "d.text", "d.label")


def dataset_fanout(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """The data sets with their parts: `part` is 'train' or 'test', `split` is 'test', 'train' or 'dev'.

    20 % of all rows are test; of each data set's remaining rows 20 % are dev. A data set's
    "all" file of a part is simply all its rows of that part.
    """
    parted = with_exact_split(df, keys, 0.2, seed)
    rows = dataset_rows(parted, [*keys, "is_test"])
    # at most 12 names x 2 flags
    split = with_exact_split(rows, keys, 0.2, seed + 1, ["dataset", "is_test"], few_groups=True, name="_dev", stage=False)
    return split.select(
        "dataset",
        F.when(F.col("is_test"), "test").otherwise("train").alias("part"),
        F.when(F.col("is_test"), "test").when(F.col("_dev"), "dev").otherwise("train").alias("split"),
        *keys, "text", "label",
    )


def write_datasets(fanout: DataFrame, path: str) -> None:
    """CSV files under dataset=…/split=…; the text and label columns only."""
    (
        fanout.select("dataset", "split", "text", "label")
        .hint("rebalance", "dataset", "split")
        .write.mode("overwrite").partitionBy("dataset", "split").csv(path, header=True, escape='"')
    )
