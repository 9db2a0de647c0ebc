"""User-bio corpora for pre-training and for prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweir.functions.once import once
from postweir.functions.text import longer_than, normalize_text
from postweir.operators.keyed import first_per_key, spread_join

# sees the table after each step, for example `RowTotals`
Watch = Callable[[str, DataFrame], DataFrame]


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All rows of all sources; `source` numbers them in the order given."""
    tagged = [df.withColumn("source", F.lit(i)) for i, df in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _unwatched(step: str, df: DataFrame) -> DataFrame:
    return df


def _normalized(df: DataFrame, text_col: str, more_than: int, watch: Watch) -> DataFrame:
    clean = df.withColumn(text_col, once(normalize_text(F.col(text_col))))
    return watch("long enough", clean.filter(longer_than(F.col(text_col), more_than)))


def without_names(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows whose name is not listed; rows without a name stay."""
    listed = names.select(column).filter(F.col(column).isNotNull()).distinct()
    return spread_join(df, listed, [column], F.col(column).isNotNull(), "left_anti")


def pretrain_corpus(sources: list[DataFrame], annotated: DataFrame, order: list[str], *, id_col: str = "user_id",
                    text_col: str = "user_description", name_col: str = "user_screen_name",
                    language: str | None = None, watch: Watch = _unwatched) -> DataFrame:
    """Distinct (user, bio) pairs of unannotated users, bios of more than 3 characters after normalising."""
    rows = union_sources(sources)
    if language:
        rows = rows.filter(F.col("lang") == language)
    pairs = watch("distinct", first_per_key(watch("read", rows), [id_col, text_col], ["source", *order]))
    present = watch("with bio", pairs.filter(F.col(text_col).isNotNull()))
    unseen = watch("not annotated", without_names(present, annotated, name_col))
    return _normalized(unseen, text_col, 3, watch)


def prediction_corpus(sources: list[DataFrame], order: list[str], *, id_col: str = "user_id",
                      text_col: str = "user_description", watch: Watch = _unwatched) -> DataFrame:
    """First row of each user, bios of at least 3 characters after normalising.

    The first row wins before missing bios are dropped: a user whose first row has none is left out.
    """
    rows = watch("distinct", first_per_key(watch("read", union_sources(sources)), [id_col], ["source", *order]))
    return _normalized(watch("with bio", rows.filter(F.col(text_col).isNotNull())), text_col, 2, watch)
