"""From parsed lines to one flat row per distinct post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweir.functions import posts as P
from postweir.functions.text import match_keywords, normalize_text, token_count
from postweir.operators.interactions import interaction_counts, with_counts
from postweir.operators.keyed import first_per_key
from postweir.schema import COUNT_COLUMNS, NESTED_POST, POST_COLUMNS

# position of a line in the capture; `nested` copies come after top-level ones
LINE_ORDER = ["nested", "file_path", "block_start", "line_no"]


def post_copies(parsed: DataFrame, emit_nested: bool = True, bad: str | None = None) -> DataFrame:
    """One row per copy of a post: the line's own and the quoted and retweeted ones inside.

    `parsed` has the struct `post` and the line position of `parse_lines`. With `bad`, the name of a column, rows without a post stay
    if they have that one, which comes along.
    """
    outer = F.struct(*[F.col(f"post.{f.name}") for f in NESTED_POST.fields[:-2]],
                     _stub("quoted_status").alias("quoted_status"), _stub("retweeted_status").alias("retweeted_status"))
    copies = [F.struct(F.lit(False).alias("nested"), outer.cast(NESTED_POST).alias("post"))]
    if emit_nested:
        copies += [
            F.struct(F.lit(True).alias("nested"), F.col(f"post.{name}").alias("post"))
            for name in ("quoted_status", "retweeted_status")
        ]
    more = [bad] if bad else []
    none = F.array(F.struct(F.lit(False).alias("nested"), F.lit(None).cast(NESTED_POST).alias("post")))
    exploded = parsed.select("file_path", "block_start", "line_no", *more, F.explode(F.when(F.col("post").isNull(), none).otherwise(F.array(*copies))).alias("copy"))
    exploded = exploded.filter(F.col("copy.post").isNotNull() | (F.col(bad).isNotNull() if bad else F.lit(False)))
    post = F.col("copy.post")
    return exploded.select("copy.nested", "file_path", "block_start", "line_no", *more, *P.post_fields(post))


def _stub(name: str):
    inner = F.col(f"post.{name}")
    return F.when(
        inner.isNotNull(),
        F.struct(
            inner["id_str"].alias("id_str"),
            inner["text"].alias("text"),
            F.when(
                inner["extended_tweet"].isNotNull(),
                F.struct(inner["extended_tweet"]["full_text"].alias("full_text")),
            ).alias("extended_tweet"),
            F.struct(inner["user"]["id_str"].alias("id_str")).alias("user"),
        ),
    )


def distinct_posts(copies: DataFrame) -> DataFrame:
    """The winning copy of each post id: top-level before nested, then the earliest line."""
    return first_per_key(copies, ["id"], [F.col(c) for c in LINE_ORDER])


def finish_posts(winners: DataFrame, keywords: list[str], stop_words: list[str],
                 extract_retweets: bool = False, extract_quotes: bool = True) -> DataFrame:
    """Drop top-level copies that are not wanted, then do the text work once per kept post."""
    keep = F.col("nested") | P.retained(F.col("is_retweet"), F.col("has_quote"), extract_retweets, extract_quotes)
    rest = [c for c in POST_COLUMNS if c not in ("text", "user_description", "token_count", "matched_keywords")]
    texts = winners.filter(keep).select(
        *rest, normalize_text(F.col("text")).alias("text"), normalize_text(F.col("user_description")).alias("user_description")
    )
    tagged = texts.withColumns({
        "token_count": token_count(F.col("text"), stop_words),
        "matched_keywords": match_keywords(F.col("text"), keywords),
    })
    return tagged.select(*POST_COLUMNS)


def touched_ids(copies: DataFrame) -> DataFrame:
    """(id): the posts whose winner or counts depend on these copies."""
    ids = F.array("id", "in_reply_to_status_id", "quoted_status_id", "retweeted_status_id")
    return copies.select(F.explode(ids).alias("id")).filter(F.col("id").isNotNull()).distinct()


def references(copies: DataFrame) -> DataFrame:
    """(target, id, …): each top-level copy once for each post it replies to, quotes or repeats; other columns of `copies` are left out but the interval."""
    targets = F.array_distinct(F.array("in_reply_to_status_id", "quoted_status_id", "retweeted_status_id"))
    return copies.filter(~F.col("nested")).select("id", "interval", F.explode(targets).alias("target")).filter(F.col("target").isNotNull())


def posts_of(own: DataFrame, referring: DataFrame, ids: DataFrame, keywords: list[str], stop_words: list[str], *, extract_retweets: bool = False,
             extract_quotes: bool = True, dedup: bool = True, count_replies: bool = True) -> DataFrame:
    """Posts of the given ids with their counts, as one extraction of everything would give them.

    `own` holds all copies of the ids, `referring` all top-level copies of the posts that refer to one of them.
    """
    winners = distinct_posts(own.join(ids, "id", "left_semi"))
    counts = interaction_counts(distinct_posts(referring) if dedup else referring, count_replies)
    posts = finish_posts(winners, keywords, stop_words, extract_retweets, extract_quotes)
    return with_counts(posts, counts).select(*POST_COLUMNS, *COUNT_COLUMNS)


def extract_posts(parsed: DataFrame, keywords: list[str], stop_words: list[str], *, extract_retweets: bool = False,
                  extract_quotes: bool = True, dedup: bool = True, count_replies: bool = True,
                  emit_nested: bool = True, stage: str | None = None) -> DataFrame:
    """Flat posts with their interaction counts.

    With `stage`, the distinct copies are written there as parquet and read back, so that raw
    lines are parsed once although posts and counts are two branches. With `dedup=False`
    duplicate lines count as often as they occur and only the written posts are unique.
    """
    copies = post_copies(parsed, emit_nested)
    winners = distinct_posts(copies) if dedup else copies
    if stage:
        winners.write.mode("overwrite").parquet(stage)
        winners = parsed.sparkSession.read.parquet(stage)
    return posts_from(winners, keywords, stop_words, extract_retweets=extract_retweets, extract_quotes=extract_quotes, dedup=dedup, count_replies=count_replies)


def posts_from(winners: DataFrame, keywords: list[str], stop_words: list[str], *, extract_retweets: bool = False,
               extract_quotes: bool = True, dedup: bool = True, count_replies: bool = True) -> DataFrame:
    """Posts with counts from the distinct copies, or from all copies if `dedup` is off."""
    counts = interaction_counts(winners.filter(~F.col("nested")), count_replies)
    kept = winners if dedup else distinct_posts(winners)
    posts = finish_posts(kept, keywords, stop_words, extract_retweets, extract_quotes)
    return with_counts(posts, counts).select(*POST_COLUMNS, *COUNT_COLUMNS)
