"""Views of the driver tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts."""
    return table(spark, sf_dir, name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a string id, a plain timestamp and the integer `k` of their properties as `target`."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "HH").alias("hh"),
        "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").alias("target"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat posts: views are retweets, purchases quotes, clicks replies, the rest originals."""
    kind, target = F.col("event_type"), F.col("target")
    return events(spark, sf_dir).select(
        "id", "created_at", "day", "hh", F.col("user_id").cast("string").alias("user_id"),
        (kind == "view").alias("is_retweet"),
        (kind == "purchase").alias("has_quote"),
        (kind == "click").alias("is_reply"),
        F.when(kind == "view", target).alias("retweeted_status_id"),
        F.when(kind == "purchase", target).alias("quoted_status_id"),
        F.when(kind == "click", target).alias("in_reply_to_status_id"),
    )


def stream_time(c: Column) -> Column:
    """A time as the capture writes it."""
    return F.concat(F.date_format(c, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(c, "yyyy"))


def nested_id(target: Column) -> Column:
    """Targets below 50 are ids of other events, the rest exist only inside other posts."""
    return F.when(target.cast("int") < 50, target).otherwise(F.concat(F.lit("n"), target))


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, day, hh, event_type, line): one raw JSON post per event, originals nested in it."""
    kind, target = F.col("event_type"), F.col("target")

    def user(uid: Column) -> Column:
        return F.struct(
            uid.alias("id_str"), F.concat(F.lit("screen_"), uid).alias("screen_name"),
            F.concat(F.lit("User &amp; "), uid).alias("name"),
            F.concat(F.lit("  Bio\tof &amp; "), uid, F.lit("&#10; ")).alias("description"),
            F.length(uid).cast("bigint").alias("followers_count"), F.lit(7).alias("friends_count"),
            F.lit("Mon Jan 01 00:00:00 +0000 2018").alias("created_at"),
            (F.length(uid) % 2 == 0).alias("verified"),
        )

    def inner(wanted: str) -> Column:
        nid = nested_id(target)
        return F.when(kind == wanted, F.struct(
            F.lit(1).alias("id"), nid.alias("id_str"), stream_time(F.col("created_at")).alias("created_at"),
            F.concat(F.lit("short "), nid).alias("text"),
            F.struct(F.concat(F.lit("original &copy; "), nid, F.lit(" in "), F.col("id")).alias("full_text")).alias("extended_tweet"),
            user(F.concat(F.lit("9"), target)).alias("user"), F.lit("en").alias("lang"),
        ))

    mentions = F.when(kind == "click", F.array(F.struct(F.col("user_id").cast("string").alias("id_str")))).when(
        kind == "purchase",
        F.array(F.struct(F.col("user_id").cast("string").alias("id_str")), F.struct(target.alias("id_str"))),
    ).when(kind == "signup", F.array().cast("array<struct<id_str:string>>"))
    extended = F.when(kind == "error", F.struct(
        F.concat(F.lit("full text of "), F.col("id")).alias("full_text"),
        F.struct(F.array(F.struct(target.alias("id_str"))).alias("user_mentions")).alias("entities"),
    ))
    post = F.struct(
        F.col("event_id").alias("id"), F.col("id").alias("id_str"),
        stream_time(F.col("created_at")).alias("created_at"),
        F.concat(F.lit("Event &amp; "), kind, F.lit("\n value https://ex.org/"), F.col("id"), F.lit(" corona")).alias("text"),
        F.lit("en").alias("lang"),
        F.when(kind == "click", target).alias("in_reply_to_status_id_str"),
        F.when(kind == "click", F.concat(F.lit("9"), target)).alias("in_reply_to_user_id_str"),
        F.struct(mentions.alias("user_mentions")).alias("entities"),
        extended.alias("extended_tweet"),
        user(F.col("user_id").cast("string")).alias("user"),
        inner("purchase").alias("quoted_status"),
        inner("view").alias("retweeted_status"),
    )
    return events(spark, sf_dir).select("event_id", "day", "hh", "event_type", F.to_json(post).alias("line"))


def noisy_lines(raw: DataFrame) -> DataFrame:
    """(event_id, day, hh, value): errors become Python literals, some blank, broken and log lines are put between."""
    literal = F.regexp_replace(F.replace(F.col("line"), F.lit('"'), F.lit("'")), "^\\{", "{'truncated': None, 'seen': True, ")
    literal = F.replace(F.replace(literal, F.lit(":false"), F.lit(":False")), F.lit(":true"), F.lit(":True"))
    line = F.when(F.col("event_type") == "error", literal).otherwise(F.col("line"))
    noise = F.when(F.col("event_type") == "signup", F.array(
        F.lit(""), F.lit('{"id": broken'), F.lit('{"limit": {"track": 5}}'), line, line
    )).otherwise(F.array(line))
    return raw.select("event_id", "day", "hh", F.posexplode(noise).alias("n", "value"))


def placed_lines(lines: DataFrame) -> DataFrame:
    """Lines with a position in the capture, without files."""
    return lines.select(
        "value", F.concat(F.lit("/raw/"), F.replace(F.col("day"), F.lit("-"), F.lit("/")), F.lit("/"), F.col("hh"), F.lit("/f")).alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"), (F.col("event_id") * 10 + F.col("n")).alias("line_no"),
    )


def bios(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two bio sources: documents, and conversations whose users overlap with them."""
    docs = texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("user_id"), F.concat(F.lit("doc"), F.col("doc_id")).alias("user_screen_name"),
        F.when(F.col("source") != "src3", F.col("text")).alias("user_description"), "lang",
        F.lit(0).cast("bigint").alias("seq"),
    )
    talks = texts(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("user_id"),
        F.when(F.col("role") != "assistant", F.concat(F.lit("conv"), F.col("conv_id"))).alias("user_screen_name"),
        F.col("text").alias("user_description"), F.lit("en").alias("lang"), F.col("turn").alias("seq"),
    )
    return [docs, talks]


def wide_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, a1..a4): four annotators' labels per order."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(*[
        F.min(F.when(F.col("l_linenumber") == i, F.col("l_returnflag"))).alias(f"a{i}") for i in range(1, 5)
    ])


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, iso_a2, rings): a box or a hexagon per nation, on a 5 x 5 grid with gaps between them."""
    n = F.col("n_nationkey")
    x, y = (n % 5) * 20.0 - 50.0, F.floor(n / 5) * 16.0 - 40.0

    def ring(*pairs: tuple[float, float]) -> Column:
        return F.array(*[F.array((x + dx).cast("double"), (y + dy).cast("double")) for dx, dy in pairs])

    box = ring((0, 0), (14, 0), (14, 10), (0, 10))
    hexagon = ring((4, 0), (12, 0), (16, 5), (12, 10), (4, 10), (0, 5))
    return table(spark, sf_dir, "nation").select(
        n.alias("ord"), F.upper(F.substring("n_name", 1, 2)).alias("_"), F.format_string("C%02d", n).alias("iso_a2"),
        F.array(F.when(n % 2 == 0, box).otherwise(hexagon)).alias("rings"),
    ).drop("_")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, iso_a2, iso_a3, name_en, region, subregion) from nation and region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("ord"), F.format_string("C%02d", "n_nationkey").alias("iso_a2"),
        F.format_string("C%03d", "n_nationkey").alias("iso_a3"), F.col("n_name").alias("name_en"),
        F.col("r_name").alias("region"), F.concat(F.col("r_name"), F.lit("/"), F.col("n_name")).alias("subregion"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, lon, lat): spread over and around the shapes."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k, ((k * 37) % 1301 / 10.0 - 62.35).alias("lon"), ((k * 53) % 1009 / 10.0 - 51.15).alias("lat")
    )
