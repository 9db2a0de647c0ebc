"""Ingest, extraction, interaction counts, files and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.functions.posts import parse_created_at, retained, user_mentions
from postweir.operators import extraction, interactions, retweeters
from postweir.plans import adapters as A
from postweir.plans.catalog.text import sql_normalize
from postweir.plans.extract_stream import run_extraction
from postweir.schema import USER_COLUMNS
from postweir.session import scratch_path, stage
from postweir.sources import posts as post_files
from postweir.sources import raw, shards
from postweir.streaming import ingest

_K = "CAST(props->>'$.k' AS BIGINT)"
_KEYWORDS = ["corona", "Event", "original", "#corona", "corona"]
_STOP = ["of", "in"]


def interaction_counts(spark: SparkSession, sf: str) -> DataFrame:
    posts = A.posts(spark, sf)
    counted = interactions.with_counts(posts.select("id"), interactions.interaction_counts(posts))
    return counted.select("id", "num_replies", "num_quotes", "num_retweets")


def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    posts = A.posts(spark, sf)
    flags = [F.col("is_retweet"), F.col("has_quote")]
    return posts.select(
        "id", "is_reply",
        retained(*flags).alias("kept_default"),
        retained(*flags, extract_retweets=True).alias("kept_retweets"),
        retained(*flags, extract_quotes=False).alias("kept_originals"),
    ).filter("kept_default or kept_retweets or kept_originals")


def _capture(spark: SparkSession, sf: str) -> str:
    """The noisy capture as files: two slots a day, even days gzipped."""
    root = scratch_path(spark, "raw")
    slot = F.when(F.col("hh") < "12", "00").otherwise("12")
    lines = A.noisy_lines(A.raw_json(spark, sf)).select(
        F.substring("day", 1, 4).alias("y"), F.substring("day", 6, 2).alias("m"), F.substring("day", 9, 2).alias("d"),
        slot.alias("h"), "event_id", "n", "value",
    )
    placed = lines.hint("rebalance", "y", "m", "d", "h").sortWithinPartitions("y", "m", "d", "h", "event_id", "n")
    even = F.col("d").cast("int") % 2 == 0
    out = placed.select("y", "m", "d", "h", "value")
    out.filter(even).write.partitionBy("y", "m", "d", "h").option("compression", "gzip").text(root)
    out.filter(~even).write.partitionBy("y", "m", "d", "h").mode("append").text(root)
    return root


def parse_lenient(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = raw.parse_lines(raw.read_raw(spark, _capture(spark, sf)))
    post = F.col("post")
    fine = good.select(
        post["id_str"].alias("id"), post["user"]["id_str"].alias("user_id"),
        F.date_format(parse_created_at(post["created_at"]), "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.coalesce(post["retweeted_status"]["id_str"], post["quoted_status"]["id_str"], post["in_reply_to_status_id_str"]).alias("target"),
    )
    return fine.unionByName(bad.select(F.lit("bad").alias("id"), F.col("value").alias("target")), allowMissingColumns=True)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = raw.parse_lines(A.placed_lines(A.noisy_lines(A.raw_json(spark, sf))))
    return good


def extract_with_nested(spark: SparkSession, sf: str) -> DataFrame:
    # parsed once: both branches read the staged copies
    posts = extraction.extract_posts(_parsed(spark, sf), _KEYWORDS, _STOP, stage=scratch_path(spark, "copies"))
    return _shape(posts)


def _shape(posts: DataFrame) -> DataFrame:
    return posts.select(
        "id", "text", "user_id", "user_description", "user_is_verified", "is_retweet", "has_quote", "is_reply",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.array_join("user_mentions", ",").alias("mentions"), "token_count",
        F.array_join("matched_keywords", ",").alias("keywords"), "num_replies", "num_quotes", "num_retweets",
    )


def _append_capture(lines: DataFrame, root: str) -> None:
    """Lines as further files of their intervals. An interval of very many lines is dealt to several tasks, whose files are numbered in the order of the lines."""
    order = ["y", "m", "d", "h", "event_id", "n"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("y", "m", "d", "h", "value").write.mode("append").partitionBy("y", "m", "d", "h").text(root)


def extract_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs with a ledger: the first half of the capture, the second half, then replies that came late into intervals of the first."""
    root, out, ledger = (scratch_path(spark, name) for name in ("raw", "posts", "ledger"))
    lines = A.noisy_lines(A.raw_json(spark, sf)).select(
        F.substring("day", 1, 4).alias("y"), F.substring("day", 6, 2).alias("m"), F.substring("day", 9, 2).alias("d"),
        F.when(F.col("hh") < "12", "00").otherwise("12").alias("h"), "event_id", "n", "value",
    )
    reply = F.get_json_object("value", "$.in_reply_to_status_id_str").isNotNull()
    late = reply & (F.col("event_id") % 10 == 0) & F.col("d").between("03", "06")
    second = ~late & (F.col("d") >= "16")
    # rendered once
    lines = stage(lines.withColumns({"late": late, "second": second}), "lines")
    late, second = F.col("late"), F.col("second")
    for part in (~late & (F.col("d") < "16"), second, late):
        _append_capture(lines.filter(part), root)
        run_extraction(spark, root, out, _KEYWORDS, _STOP, ledger=ledger, start=None, buckets=2)  # an interval holds some hundred lines
    return _shape(post_files.read_posts(spark, out))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    post = F.col("post")
    return _parsed(spark, sf).select(
        post["id_str"].alias("id"), F.array_join(user_mentions(post), ",").alias("mentioned")
    ).distinct()


def created_at(spark: SparkSession, sf: str) -> DataFrame:
    orders = A.table(spark, sf, "orders")
    parsed = parse_created_at(A.stream_time(F.col("o_orderdate")))
    return orders.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def _hour_files(spark: SparkSession, sf: str) -> DataFrame:
    """(interval day, file) pairs as a capture would list them, one file per hour."""
    hours = A.events(spark, sf).select("day", "hh").distinct()
    path = F.concat(F.lit("/raw/"), F.replace(F.col("day"), F.lit("-"), F.lit("/")), F.lit("/"), F.col("hh"), F.lit("/posts.gz"))
    return hours.select(raw.path_interval(path, raw.DAY).alias("interval"), path.alias("file"))


def interval_prune(spark: SparkSession, sf: str) -> DataFrame:
    files = _hour_files(spark, sf)
    kept = files.filter(raw.in_interval_range(F.col("interval"), "2024-01-07", "2024-01-14"))
    return kept.groupBy("interval").agg(F.count(F.lit(1)).alias("files"))


def pending_intervals(spark: SparkSession, sf: str) -> DataFrame:
    files = _hour_files(spark, sf)
    # the ledger misses the 6 o'clock file of even days and knows one that is gone on the 9th
    ledger = files.filter(~(F.col("file").contains("/06/posts") & (F.substring("interval", -2, 2).cast("int") % 2 == 0)))
    gone = files.filter(F.col("interval").endswith("_09")).select("interval", F.concat("file", F.lit(".old")).alias("file"))
    return raw.pending_intervals(files, ledger.unionByName(gone))


def _written(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "posts")
    post_files.write_posts(A.posts(spark, sf).select("id", "created_at", "user_id", "is_retweet"), path)
    return path


def write_posts_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    back = post_files.read_posts(spark, _written(spark, sf))
    return back.select("id", F.date_format("dt", "yyyy-MM-dd").alias("day"), F.col("hour").cast("bigint").alias("hour"), "user_id", "is_retweet")


def read_range_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    back = post_files.read_posts(
        spark, _written(spark, sf), ["id", "hour"], datetime(2024, 1, 5), datetime(2024, 1, 9, 12),
        transform=lambda df: df.filter(F.col("id") != ""),
    )
    return back.select("id", F.col("hour").cast("bigint").alias("hour"))


def sharded_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from postweir.functions.text import normalize_text

    path = scratch_path(spark, "shards")
    docs = A.texts(spark, sf).select("doc_id", normalize_text(F.col("text")).alias("bio"))
    shards.write_sharded(docs, path, "bio", max_rows=200)
    rows = shards.read_shards(spark, path).select(F.lit("parquet").alias("side"), F.md5("bio").alias("digest"))
    return rows.unionByName(spark.read.text(f"{path}/txt").select(F.lit("txt").alias("side"), F.md5("value").alias("digest")))


def retweet_user_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Post 0 goes viral: each of its retweets counts six hundred times. Users lack most fields, some their location too."""
    customers = A.table(spark, sf, "customer")
    wanted = A.events(spark, sf).filter(F.col("target").cast("int") % 2 == 0).select(F.col("target").alias("id"))
    retweets = A.posts(spark, sf).filter("is_retweet").select("id", "retweeted_status_id", "user_id")
    times = F.when(F.col("retweeted_status_id") == "0", 600).otherwise(1)
    viral = retweets.withColumn("n", F.explode(F.sequence(F.lit(1), times))).withColumn("id", F.concat_ws("-", "id", "n")).drop("n")
    # the stream captures some posts twice
    twice = viral.unionByName(viral.filter(F.col("user_id").cast("int") < 40))
    rows = retweeters.retweeters(twice, wanted, ["user_id"])
    place = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    have = {"user_id": F.col("user_id"), "user_name": F.col("c_name"), "user_location": place}
    user = F.struct(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in USER_COLUMNS])
    users = rows.join(customers, F.col("user_id") == F.col("c_custkey").cast("string"))
    path = scratch_path(spark, "dump")
    retweeters.write_grouped_json(retweeters.dump_pieces(users, user), path)
    return retweeters.read_grouped_json(spark, path)


def _run(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    out = scratch_path(spark, name)
    ingest.write_stream(df, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    posts = ingest.stream_posts(ingest.stream_raw(spark, _capture(spark, sf), max_files=60))
    slim = posts.select("id", "user_id", "is_retweet", "retweeted_status_id")
    return _run(spark, slim, "ingested")


def stream_table(spark: SparkSession, sf: str) -> DataFrame:
    """The capture as a stream in several triggers, with the columns of the batch table."""
    lines = ingest.stream_raw(spark, _capture(spark, sf), max_files=25)
    out = scratch_path(spark, "streamed")
    posts = ingest.stream_table(lines, _KEYWORDS, _STOP)
    ingest.write_stream(posts, out, f"{out}-checkpoint", ["dt", "hour"]).awaitTermination()
    return spark.read.schema(posts.schema).parquet(out).select(
        "id", "text", "user_id", "user_description", "has_quote", "is_reply", F.array_join("user_mentions", ",").alias("mentions"), "token_count",
        F.array_join("matched_keywords", ",").alias("keywords"), F.date_format("dt", "yyyy-MM-dd").alias("day"), F.col("hour").cast("bigint").alias("hour"),
    )


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    posts = ingest.stream_posts(ingest.stream_raw(spark, _capture(spark, sf)))
    return _run(spark, ingest.dedup_stream(posts).select("id", "user_id"), "distinct")


def stream_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level and nested copies in several triggers; nested ones often come before the post itself."""
    good, _ = raw.parse_lines(ingest.stream_raw(spark, _capture(spark, sf), max_files=20))
    copies = extraction.post_copies(good).select("id", "user_id", "created_at", *extraction.LINE_ORDER)
    out = scratch_path(spark, "winners")
    ingest.write_winners(ingest.winning_copies(copies, delay="40 days"), out, f"{out}-checkpoint").awaitTermination()
    return ingest.read_winners(spark, out).select("id", "user_id", "nested")


def stream_hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    target = F.coalesce("retweeted_status_id", "quoted_status_id", "in_reply_to_status_id")
    # files hold days in any order, some a trigger: most edges come weeks behind the latest time seen
    path = scratch_path(spark, "edges")
    events = A.posts(spark, sf).select("created_at", target.alias("target")).filter(F.col("target").isNotNull())
    events.repartition(12, F.xxhash64("created_at")).write.parquet(path)
    edges = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = scratch_path(spark, "hourly")
    ingest.count_hours(edges, out, f"{out}-checkpoint").awaitTermination()
    counts = ingest.hour_totals(spark, out)
    return counts.select(F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "target", "n")


QUERIES = {
    "interaction_counts": interaction_counts,
    "retention_filter": retention_filter,
    "parse_lenient": parse_lenient,
    "extract_with_nested": extract_with_nested,
    "extract_incremental": extract_incremental,
    "mentions": mentions,
    "parse_created_at": created_at,
    "interval_prune": interval_prune,
    "pending_intervals": pending_intervals,
    "write_posts_roundtrip": write_posts_roundtrip,
    "read_range_exclusive": read_range_exclusive,
    "sharded_roundtrip": sharded_roundtrip,
    "retweet_user_dump": retweet_user_dump,
    "stream_ingest": stream_ingest,
    "stream_table": stream_table,
    "stream_dedup": stream_dedup,
    "stream_winners": stream_winners,
    "stream_hourly_counts": stream_hourly_counts,
}

_EV = """ev AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, ts, event_type AS et, CAST(user_id AS VARCHAR) AS uid,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created, props->>'$.k' AS k,
         CASE WHEN CAST(props->>'$.k' AS INTEGER) < 50 THEN props->>'$.k' ELSE 'n' || (props->>'$.k') END AS nid
  FROM events)"""
_LINES = "lines AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE et = 'signup')"
_HOURS = """hours AS (
  SELECT DISTINCT strftime(ts, '%Y_%m_%d') AS interval, strftime(ts, '%H') AS hh FROM events)"""

ORACLES = {
    "interaction_counts": f"""
WITH c AS (
  SELECT {_K} AS k, count(*) FILTER (WHERE event_type = 'click') AS r,
         count(*) FILTER (WHERE event_type = 'purchase') AS q, count(*) FILTER (WHERE event_type = 'view') AS v
  FROM events GROUP BY 1)
SELECT CAST(event_id AS VARCHAR) AS id, coalesce(r, 0) AS num_replies, coalesce(q, 0) AS num_quotes,
       coalesce(v, 0) AS num_retweets
FROM events LEFT JOIN c ON event_id = k""",
    "retention_filter": """
SELECT CAST(event_id AS VARCHAR) AS id, event_type = 'click' AS is_reply, event_type <> 'view' AS kept_default,
       true AS kept_retweets, event_type NOT IN ('view', 'purchase') AS kept_originals
FROM events""",
    "parse_lenient": f"""
WITH {_EV}, {_LINES}
SELECT id, uid AS user_id, created,
       CASE et WHEN 'view' THEN nid WHEN 'purchase' THEN nid WHEN 'click' THEN k END AS target
FROM lines
UNION ALL
SELECT 'bad', NULL, NULL, '{{"id": broken' FROM ev WHERE et = 'signup'""",
    "extract_with_nested": f"""
WITH {_EV},
top AS (
  SELECT id, CASE WHEN et = 'error' THEN 'full text of ' || id
                  ELSE 'Event & ' || et || ' value https://ex.org/' || id || ' corona' END AS text,
         uid AS user_id, et = 'purchase' AS has_quote, et = 'click' AS is_reply, created,
         CASE et WHEN 'click' THEN uid WHEN 'purchase' THEN uid || ',' || k WHEN 'error' THEN k END AS mentions,
         CASE WHEN et = 'error' THEN 2 ELSE 4 END AS token_count,
         CASE WHEN et = 'error' THEN '' ELSE '0,4' END AS keywords
  FROM ev WHERE et <> 'view'),
inner_posts AS (
  SELECT nid, min(event_id) AS first_id FROM ev WHERE et IN ('view', 'purchase') GROUP BY nid),
nested AS (
  SELECT e.nid AS id, 'original © ' || e.nid || ' in ' || e.id AS text, '9' || k AS user_id, false AS has_quote,
         false AS is_reply, created, NULL AS mentions, 1 AS token_count, '2' AS keywords
  FROM inner_posts i JOIN ev e ON e.event_id = i.first_id
  WHERE i.nid NOT IN (SELECT id FROM ev)),
posts AS (SELECT * FROM top UNION ALL SELECT * FROM nested),
edges AS (
  SELECT CASE WHEN et = 'click' THEN k ELSE nid END AS target, et FROM ev WHERE et IN ('view', 'purchase', 'click')),
c AS (
  SELECT target, count(*) FILTER (WHERE et = 'click') AS r, count(*) FILTER (WHERE et = 'purchase') AS q,
         count(*) FILTER (WHERE et = 'view') AS v
  FROM edges GROUP BY target)
SELECT id, text, user_id, 'Bio of & ' || user_id AS user_description, length(user_id) % 2 = 0 AS user_is_verified,
       false AS is_retweet, has_quote, is_reply, created, mentions, CAST(token_count AS BIGINT) AS token_count, keywords,
       coalesce(r, 0) AS num_replies, coalesce(q, 0) AS num_quotes, coalesce(v, 0) AS num_retweets
FROM posts LEFT JOIN c ON id = target""",
    "mentions": f"""
WITH {_EV}
SELECT id, CASE et WHEN 'click' THEN uid WHEN 'purchase' THEN uid || ',' || k WHEN 'error' THEN k END AS mentioned FROM ev""",
    "parse_created_at": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders",
    "interval_prune": f"""
WITH {_HOURS}
SELECT interval, count(*) AS files FROM hours WHERE interval >= '2024_01_07' AND interval < '2024_01_14' GROUP BY interval""",
    "pending_intervals": f"""
WITH {_HOURS},
files AS (SELECT interval, hh AS file FROM hours),
ledger AS (
  SELECT * FROM files WHERE NOT (file = '06' AND CAST(right(interval, 2) AS INTEGER) % 2 = 0)
  UNION ALL SELECT interval, file || '.old' FROM files WHERE right(interval, 3) = '_09'),
f AS (SELECT interval, list(DISTINCT file ORDER BY file) AS s FROM files GROUP BY interval),
l AS (SELECT interval, list(DISTINCT file ORDER BY file) AS s FROM ledger GROUP BY interval)
SELECT f.interval FROM f LEFT JOIN l ON f.interval = l.interval WHERE l.s IS NULL OR f.s <> l.s""",
    "write_posts_roundtrip": """
SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS BIGINT) AS hour,
       CAST(user_id AS VARCHAR) AS user_id, event_type = 'view' AS is_retweet
FROM events""",
    "read_range_exclusive": """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(hour(ts) AS BIGINT) AS hour FROM events
WHERE date_trunc('hour', ts) > TIMESTAMP '2024-01-05 00:00:00' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-09 12:00:00'""",
    "sharded_roundtrip": f"""
WITH n AS (SELECT md5({sql_normalize('text')}) AS digest FROM documents)
SELECT 'parquet' AS side, digest FROM n UNION ALL SELECT 'txt', digest FROM n""",
    "retweet_user_dump": f"""
WITH r AS (
  SELECT CAST(event_id AS VARCHAR) || '-' || n AS id, props->>'$.k' AS t, CAST(user_id AS VARCHAR) AS uid, user_id
  FROM events, LATERAL (SELECT unnest(range(1, CASE WHEN {_K} = 0 THEN 601 ELSE 2 END)) AS n)
  WHERE event_type = 'view' AND {_K} % 2 = 0),
p AS (
  SELECT *, '{{"user_id":"' || uid || '","user_screen_name":null,"user_name":"' || c_name || '","user_description":null,"user_timezone":null,"user_location":'
         || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END
         || ',"user_num_followers":null,"user_num_following":null,"user_created_at":null,"user_statuses_count":null,"user_is_verified":null}}' AS u
  FROM r JOIN customer ON user_id = c_custkey)
SELECT '{{"' || t || '":[' || string_agg(u, ' ,' ORDER BY uid, id) || ']}}' AS value
FROM p GROUP BY t""",
    "stream_ingest": f"""
WITH {_EV}, {_LINES}
SELECT id, uid AS user_id, et = 'view' AS is_retweet, CASE WHEN et = 'view' THEN nid END AS retweeted_status_id FROM lines""",
    "stream_table": f"""
WITH {_EV}, {_LINES}
SELECT id, CASE WHEN et = 'error' THEN 'full text of ' || id ELSE 'Event & ' || et || ' value https://ex.org/' || id || ' corona' END AS text,
       uid AS user_id, 'Bio of & ' || uid AS user_description, et = 'purchase' AS has_quote, et = 'click' AS is_reply,
       CASE et WHEN 'click' THEN uid WHEN 'purchase' THEN uid || ',' || k WHEN 'error' THEN k END AS mentions,
       CAST(CASE WHEN et = 'error' THEN 2 ELSE 4 END AS BIGINT) AS token_count, CASE WHEN et = 'error' THEN '' ELSE '0,4' END AS keywords,
       strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS BIGINT) AS hour
FROM lines WHERE et <> 'view'""",
    "stream_dedup": f"WITH {_EV} SELECT id, uid AS user_id FROM ev",
    "stream_winners": f"""
WITH {_EV}
SELECT id, uid AS user_id, false AS nested FROM ev
UNION ALL
SELECT DISTINCT nid, '9' || k, true FROM ev WHERE et IN ('view', 'purchase') AND nid NOT IN (SELECT id FROM ev)""",
    "stream_hourly_counts": """
WITH e AS (SELECT ts, props->>'$.k' AS target FROM events WHERE event_type IN ('view', 'purchase', 'click'))
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, target, count(*) AS n FROM e
GROUP BY 1, 2""",
}
ORACLES["extract_incremental"] = ORACLES["extract_with_nested"]
