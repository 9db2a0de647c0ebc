"""Users who retweeted the posts of a list within a range of days."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postweir.functions.text import normalize_text
from postweir.operators import extraction, retweeters
from postweir.session import ship_package, use_utc
from postweir.sources import raw, tables

DAYS = ("2020-05-07", "2020-05-14")  # fixed value: half-open range of the study


def run_dump(spark: SparkSession, root: str, id_list: str, out: str, start: str = DAYS[0], end: str = DAYS[1]) -> None:
    """Write one JSON object a line: {"post": [user, …]} for each retweeted post of the list."""
    ship_package(spark)
    use_utc(spark)
    good, _ = raw.parse_lines(raw.read_raw(spark, root, start, end, by=raw.DAY))
    retweets = extraction.post_copies(good, emit_nested=False).filter("is_retweet")
    rows = retweeters.retweeters(retweets, tables.read_id_list(spark, id_list), extraction.LINE_ORDER)
    users = rows.withColumn("user_description", normalize_text(F.col("user_description")))
    retweeters.write_grouped_json(retweeters.dump_pieces(users), out)
