"""Samples, splits and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.operators import keyed
from postweir.plans import adapters as A


def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.sample_n(A.table(spark, sf, "documents"), "text", 300).select(F.md5("text").alias("digest"))


def split_train_test_dev(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.train_dev_test(A.table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"])


def split_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    train, test = keyed.split_by_hash(A.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def zip_rows(spark: SparkSession, sf: str) -> DataFrame:
    vectors = A.table(spark, sf, "embeddings").select("vec_id", "label")
    docs = A.table(spark, sf, "documents").select("doc_id", "lang")
    return keyed.zip_rows([vectors, docs], [["vec_id"], ["doc_id"]], strict=False)


QUERIES = {
    "sample_n": sample_n,
    "split_train_test_dev": split_train_test_dev,
    "split_by_hash": split_by_hash,
    "zip_rows": zip_rows,
}
ORACLES = {
    "sample_n": """
SELECT md5(text) AS digest FROM (SELECT DISTINCT text FROM documents) ORDER BY md5('42:' || text), text LIMIT 300""",
    "split_train_test_dev": """
WITH d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, count(*) OVER () AS n FROM documents),
t AS (SELECT doc_id, lang, r <= ceil(0.2 * n) AS is_test FROM d),
v AS (
  SELECT *, row_number() OVER (PARTITION BY is_test ORDER BY md5('43:' || doc_id)) AS r, count(*) OVER (PARTITION BY is_test) AS n
  FROM t)
SELECT doc_id, lang, CASE WHEN is_test THEN 'test' WHEN r <= ceil(0.2 * n) THEN 'dev' ELSE 'train' END AS split FROM v""",
    "split_by_hash": """
SELECT o_orderkey, CASE WHEN left(md5('42:' || o_orderkey), 8) >= '33333333' THEN 'train' ELSE 'test' END AS part FROM orders""",
    "zip_rows": """
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row_index FROM embeddings),
d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents)
SELECT row_index, vec_id, label, doc_id, lang FROM v FULL JOIN d USING (row_index)""",
}
