"""Columns over raw post structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the stream's time format after its three-letter weekday.
CREATED_AT_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def parse_created_at(c: Column) -> Column:
    """'Thu May 07 10:11:12 +0000 2020' to a timestamp; anything else is tried as ISO, else NULL."""
    return F.coalesce(F.try_to_timestamp(F.substring(c, 5, 30), F.lit(CREATED_AT_FORMAT)), F.try_to_timestamp(c))


def is_retweet(post: Column) -> Column:
    return post["retweeted_status"].isNotNull()


def has_quote(post: Column) -> Column:
    return post["quoted_status"].isNotNull()


def is_reply(post: Column) -> Column:
    return post["in_reply_to_status_id_str"].isNotNull()


def is_verified(post: Column) -> Column:
    return F.coalesce(post["user"]["verified"], F.lit(False))


def has_coordinates(post: Column) -> Column:
    return post["coordinates"].isNotNull()


def has_place(post: Column) -> Column:
    return post["place"].isNotNull()


def has_place_bounding_box(post: Column) -> Column:
    return F.coalesce(F.size(post["place"]["bounding_box"]["coordinates"]) > 0, F.lit(False))


def _own_text(post: Column) -> Column:
    return F.when(post["extended_tweet"].isNotNull(), post["extended_tweet"]["full_text"]).otherwise(post["text"])


def raw_text(post: Column) -> Column:
    """Untruncated text; a retweet takes it from the post it repeats."""
    return F.when(is_retweet(post), _own_text(post["retweeted_status"])).otherwise(_own_text(post))


def user_mentions(post: Column) -> Column:
    """Ids of mentioned users in order, NULL when there are none."""
    mentions = F.when(
        post["extended_tweet"].isNotNull(), post["extended_tweet"]["entities"]["user_mentions"]
    ).otherwise(post["entities"]["user_mentions"])
    return F.when(F.size(mentions) > 0, F.transform(mentions, lambda m: m["id_str"]))


def user_fields(post: Column) -> list[Column]:
    """The 11 author columns; the description is still raw."""
    user = post["user"]
    return [
        user["id_str"].alias("user_id"),
        user["screen_name"].alias("user_screen_name"),
        user["name"].alias("user_name"),
        user["description"].alias("user_description"),
        user["timezone"].alias("user_timezone"),
        user["location"].alias("user_location"),
        user["followers_count"].alias("user_num_followers"),
        user["friends_count"].alias("user_num_following"),
        parse_created_at(user["created_at"]).alias("user_created_at"),
        user["statuses_count"].alias("user_statuses_count"),
        is_verified(post).alias("user_is_verified"),
    ]


def post_fields(post: Column) -> list[Column]:
    """Flat columns that need no text work."""
    return [
        post["id_str"].alias("id"),
        raw_text(post).alias("text"),
        post["in_reply_to_status_id_str"].alias("in_reply_to_status_id"),
        post["in_reply_to_user_id_str"].alias("in_reply_to_user_id"),
        post["quoted_status"]["user"]["id_str"].alias("quoted_user_id"),
        post["quoted_status"]["id_str"].alias("quoted_status_id"),
        post["retweeted_status"]["user"]["id_str"].alias("retweeted_user_id"),
        post["retweeted_status"]["id_str"].alias("retweeted_status_id"),
        parse_created_at(post["created_at"]).alias("created_at"),
        user_mentions(post).alias("user_mentions"),
        *user_fields(post),
        post["lang"].alias("lang"),
        is_retweet(post).alias("is_retweet"),
        has_quote(post).alias("has_quote"),
        is_reply(post).alias("is_reply"),
    ]


def retained(is_rt: Column, quote: Column, extract_retweets: bool = False, extract_quotes: bool = True) -> Column:
    """Which top-level posts are kept: originals always, quotes and retweets on request."""
    keep = ~is_rt & ~quote
    if extract_quotes:
        keep = keep | (quote & ~is_rt)
    if extract_retweets:
        keep = keep | is_rt
    return keep
