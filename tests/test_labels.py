from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postweir.functions import labels as L
from postweir.operators import annotations


def test_map_label_is_strict(spark):
    df = spark.createDataFrame([("Institution",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(L.map_label(F.col("l"), L.TYPES)).collect()] == ["institution", None, None]
    unknown = spark.createDataFrame([("Robot",)], "l string")
    with pytest.raises(Exception, match="unknown label: Robot"):
        unknown.select(L.map_label(F.col("l"), L.TYPES)).collect()
    assert unknown.select(L.map_label(F.col("l"), L.TYPES, strict=False)).first()[0] is None


def test_map_labels_keeps_one_null(spark):
    df = spark.createDataFrame([(["Media", "", None, "Media", "Art"],)], "l array<string>")
    assert df.select(L.map_labels(F.col("l"), L.CATEGORIES)).first()[0] == ["art", "media", None]


def test_ambiguity(spark):
    rows = [("a", "a", "a", None), ("a", "a", "a", "b"), ("a", "a", None, None), (None,) * 4, ("a", "a", "a", "a")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert [r[0] for r in df.select(L.is_ambiguous(*[F.col(c) for c in "abcd"])).collect()] == [False, True, True, True, False]


def test_ambiguity_of_lists_counts_null_elements(spark):
    rows = [([None], [None], [None], ["a", "b"]), (["a"], ["a"], [None], []), (["a"], ["a"], ["a"], None), (["a"], ["a"], ["a", "b"], None)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, c array<string>, d array<string>")
    assert [r[0] for r in df.select(L.is_ambiguous_multi(*[F.col(c) for c in "abcd"])).collect()] == [False, True, False, True]


def test_unpivot_and_backfill(spark):
    wide = spark.createDataFrame([("b1", "b2", "u1", "u2")], "bio_1 string, bio_2 string, username_1 string, username_2 string")
    long = annotations.unpivot_numbered(wide, ["bio", "username"], 2).withColumnRenamed("bio", "bio_original")
    annotated = spark.createDataFrame([("u1", "x"), ("u3", "y"), (None, "z")], "username string, bio string")
    rows = {(r["username"], r["bio_original"]) for r in annotations.backfill_bios(annotated, long).collect()}
    assert rows == {("u1", "b1"), ("u3", "y"), (None, "z")}
