"""Labels, annotator agreement, bios and data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.functions import labels as L
from postweir.operators import annotations, bots
from postweir.plans import adapters as A

_PRIORITIES = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "middle", "4-NOT SPECIFIED": "none"}
_FLAGS = {"A": "x", "N": "x", "R": "y"}


def map_label(spark: SparkSession, sf: str) -> DataFrame:
    orders = A.table(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise(F.lit(""))
    return orders.select("o_orderkey", L.map_label(label, _PRIORITIES, strict=False).alias("label"))


def map_label_list(spark: SparkSession, sf: str) -> DataFrame:
    lines = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_returnflag"))).alias("flags")
    )
    mapped = L.map_labels(F.col("flags"), _FLAGS)
    return lines.select("l_orderkey", F.array_join(mapped, ",", "-").alias("labels"))


def ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.wide_annotators(spark, sf)
    flag = L.is_ambiguous(*[F.col(f"a{i}") for i in range(1, 5)])
    return rows.select("l_orderkey", "a1", "a2", "a3", "a4", flag.alias("is_ambiguous"))


def ambiguity_multi(spark: SparkSession, sf: str) -> DataFrame:
    lines = A.table(spark, sf, "lineitem")
    # list labels: all flags an annotator gave, '' (a missing label) where the tax is zero
    label = F.when(F.col("l_tax") == 0, F.lit("")).otherwise(F.col("l_returnflag"))
    rows = lines.groupBy("l_orderkey").agg(*[
        F.collect_set(F.when(F.col("l_linenumber") == i, label)).alias(f"a{i}") for i in range(1, 5)
    ])
    lists = [L.map_labels(F.col(f"a{i}"), _FLAGS) for i in range(1, 5)]
    return rows.select("l_orderkey", L.is_ambiguous_multi(*lists).alias("is_ambiguous")).filter(~F.col("is_ambiguous"))


def bio_backfill(spark: SparkSession, sf: str) -> DataFrame:
    lines = A.table(spark, sf, "lineitem").filter("l_linenumber <= 4")
    wide = lines.groupBy("l_orderkey").agg(*[
        F.max(F.when(F.col("l_linenumber") == i, F.col(c))).alias(f"{name}_{i}")
        for i in range(1, 5) for name, c in (("bio", "l_returnflag"), ("username", "l_suppkey"))
    ])
    long = annotations.unpivot_numbered(wide, ["bio", "username"], 4)
    suppliers = A.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("username"), F.concat(F.lit("own "), F.col("s_name")).alias("bio")
    )
    named = long.withColumnRenamed("bio", "bio_original").filter(F.col("username") % 3 != 0)
    return annotations.backfill_bios(suppliers, named).select("username", "bio", "bio_original")


def dataset_fanout(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = A.table(spark, sf, "documents"), A.table(spark, sf, "labels")
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("text").alias("text_translated"), F.concat(F.lit("original "), "text").alias("text_original"),
        F.concat(F.lit("u"), F.col("doc_id")).alias("username"), F.col("source").alias("screenname"),
        F.col("quality").cast("string").alias("estimated_coarse_type"),
        F.col("toxic").cast("string").alias("estimated_coarse_majority_category"),
        (F.col("lang") != "en").alias("type_merged_is_ambiguous"),
        (F.col("n_chars") > 1000).alias("category_merged_is_ambiguous"),
    )
    fan = annotations.dataset_fanout(rows, ["doc_id"])
    return fan.select("dataset", "part", "split", "doc_id", F.md5("text").alias("digest"), "label")


def bot_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return _bots(spark, sf)


def _bots(spark: SparkSession, sf: str) -> DataFrame:
    e = A.events(spark, sf)
    scores = e.select(
        F.when(F.col("event_type") != "error", F.struct(
            F.col("id").alias("id_str"), F.concat(F.lit("user"), F.col("user_id")).alias("screen_name")
        )).alias("user"),
        F.when(F.col("event_type") != "signup", F.struct(
            (F.col("value") / 100).alias("universal"), (F.col("value") / 50).alias("english")
        )).alias("cap"),
        F.struct((F.col("value") / 10).alias("universal"), (F.col("value") / 5).alias("english")).alias("scores"),
    )
    return bots.flatten_bots(scores)


def bot_join(spark: SparkSession, sf: str) -> DataFrame:
    users = A.table(spark, sf, "customer").select(
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("user"), F.col("c_custkey"))).alias("username"),
        F.col("c_mktsegment").alias("majority_vote_type"),
    )
    return bots.join_annotations(_bots(spark, sf), users).select("user_id", "user_screen_name", "is_bot", "majority_vote_type")


QUERIES = {
    "map_label": map_label,
    "map_label_list": map_label_list,
    "ambiguity": ambiguity,
    "ambiguity_multi": ambiguity_multi,
    "bio_backfill": bio_backfill,
    "dataset_fanout": dataset_fanout,
    "bot_flatten": bot_flatten,
    "bot_join": bot_join,
}

_WHEN_PRIORITY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PRIORITIES.items())
_BOTS = """bots AS (
  SELECT CAST(event_id AS VARCHAR) AS user_id, 'user' || user_id AS user_screen_name,
         CASE WHEN event_type <> 'signup' THEN value / 100 END AS cap_universal,
         CASE WHEN event_type <> 'signup' THEN value / 50 END AS cap_english,
         value / 5 AS score_english, value / 10 AS score_universal,
         coalesce(event_type <> 'signup' AND value / 100 > 0.25, false) AS is_bot
  FROM events WHERE event_type <> 'error')"""
_SETS = []
for _suffix, _text in (("", "text"), ("_multilang", "'original ' || text")):
    for _kind, _label, _clear in (("type_merged", "quality", "lang = 'en'"), ("category_merged", "toxic", "n_chars <= 1000")):
        for _variant, _value, _where in (
            ("", _text, "true"),
            ("_unambiguous", _text, _clear),
            ("_with_username", f"'u' || doc_id || ' ' || source || ' ' || {_text}", "true"),
        ):
            _SETS.append(
                f"SELECT '{_kind}{_variant}{_suffix}' AS dataset, doc_id, is_test, md5({_value}) AS digest,"
                f" CAST({_label} AS VARCHAR) AS label FROM parted WHERE {_label} IS NOT NULL AND {_where}"
            )

ORACLES = {
    "map_label": f"""
SELECT o_orderkey, CASE CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE '' END {_WHEN_PRIORITY} END AS label FROM orders""",
    "map_label_list": """
WITH m AS (
  SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_returnflag IN ('A', 'N') THEN 'x' ELSE 'y' END AS v
  FROM lineitem)
SELECT l_orderkey, string_agg(coalesce(v, '-'), ',' ORDER BY v NULLS LAST) AS labels FROM m GROUP BY l_orderkey""",
    "ambiguity": """
WITH w AS (
  SELECT l_orderkey, min(l_returnflag) FILTER (WHERE l_linenumber = 1) AS a1, min(l_returnflag) FILTER (WHERE l_linenumber = 2) AS a2,
         min(l_returnflag) FILTER (WHERE l_linenumber = 3) AS a3, min(l_returnflag) FILTER (WHERE l_linenumber = 4) AS a4
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a1, a2, a3, a4,
       (SELECT count(v) < 3 OR count(DISTINCT v) <> 1 FROM (VALUES (a1), (a2), (a3), (a4)) t(v)) AS is_ambiguous
FROM w""",
    "ambiguity_multi": """
WITH one AS (
  SELECT l_orderkey, l_linenumber,
         list(DISTINCT CASE WHEN l_tax = 0 THEN '-' WHEN l_returnflag IN ('A', 'N') THEN 'x' ELSE 'y' END) AS labels
  FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
single AS (SELECT l_orderkey, labels[1] AS v FROM one WHERE len(labels) = 1)
SELECT l_orderkey, false AS is_ambiguous FROM single GROUP BY l_orderkey HAVING count(*) >= 3 AND count(DISTINCT v) = 1""",
    "bio_backfill": """
WITH w AS (
  SELECT l_orderkey, l_linenumber, max(l_returnflag) AS bio_original, max(l_suppkey) AS username
  FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
SELECT s_suppkey AS username, 'own ' || s_name AS bio, coalesce(bio_original, 'own ' || s_name) AS bio_original
FROM supplier LEFT JOIN w ON s_suppkey = username AND username % 3 <> 0""",
    "dataset_fanout": f"""
WITH d AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, count(*) OVER () AS n
  FROM documents LEFT JOIN labels USING (doc_id)),
parted AS (SELECT *, r <= ceil(0.2 * n) AS is_test FROM d),
sets AS ({' UNION ALL '.join(_SETS)}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, is_test ORDER BY md5('43:' || doc_id)) AS dr,
         count(*) OVER (PARTITION BY dataset, is_test) AS dn
  FROM sets)
SELECT dataset, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part,
       CASE WHEN is_test THEN 'test' WHEN dr <= ceil(0.2 * dn) THEN 'dev' ELSE 'train' END AS split, doc_id, digest, label
FROM ranked""",
    "bot_flatten": f"WITH {_BOTS} SELECT * FROM bots",
    "bot_join": f"""
WITH {_BOTS}
SELECT user_id, user_screen_name, is_bot, c_mktsegment AS majority_vote_type
FROM bots JOIN customer ON user_screen_name = 'user' || c_custkey AND c_mktsegment <> 'MACHINERY'""",
}
