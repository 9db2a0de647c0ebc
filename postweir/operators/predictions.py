"""Predictions and languages brought together with the users they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postweir.operators.keyed import zip_rows


def merge_predictions(users: DataFrame, parts: list[DataFrame], key: str = "user_id") -> DataFrame:
    """Users with the columns of every part, joined by key; a user missing in a part gets NULLs.

    The key must be unique in each part: a part that has one twice would multiply the user. Parts without a key are for `merge_by_position`.
    """
    merged = users.select(key)
    for part in parts:
        merged = merged.join(part, key, "left")
    return merged


def merge_by_position(users: DataFrame, users_order: list[str], parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """As `merge_predictions` for parts that only share the row order; unequal lengths fail."""
    frames, orders = [users, *[p for p, _ in parts]], [users_order, *[o for _, o in parts]]
    return zip_rows(frames, orders)
