from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from postweir.functions import posts as P
from postweir.operators import extraction, interactions, retweeters
from postweir.session import session_conf
from postweir.sources import raw


def user(uid: str) -> dict:
    return {"id_str": uid, "screen_name": f"s{uid}", "name": "N", "description": "a &amp; b", "location": None,
            "followers_count": 3, "friends_count": 4, "created_at": "Mon Jan 01 00:00:00 +0000 2018", "statuses_count": 9, "verified": True}


def post(pid: str, **more) -> dict:
    return {"id": int(pid), "id_str": pid, "created_at": "Thu May 07 10:11:12 +0000 2020", "text": f"text {pid}", "lang": "en",
            "in_reply_to_status_id_str": None, "in_reply_to_user_id_str": None, "entities": {"user_mentions": []}, "user": user("u" + pid), **more}


def lines_of(spark, values):
    rows = [(v if isinstance(v, str) else json.dumps(v), "/raw/2020/05/07/10/f", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "value string, file_path string, block_start long, line_no long")


def parsed(spark, values):
    return raw.parse_lines(lines_of(spark, values))


QUOTE = post("11", quoted_status=post("1"))
RT_OF_QUOTE = post("12", retweeted_status=post("13", text="short", extended_tweet={"full_text": "the full\ttext"}, quoted_status=post("2")), quoted_status=post("2"))
REPLY = post("14", in_reply_to_status_id_str="1", in_reply_to_user_id_str="u1")
STREAM = [QUOTE, RT_OF_QUOTE, REPLY, post("1", text="top level"), QUOTE, post("15", quoted_status=post("1", text="other copy"))]


def extract(spark, values, **flags):
    good, _ = parsed(spark, values)
    return {r["id"]: r for r in extraction.extract_posts(good, ["text"], [], **flags).collect()}


def test_lenient_parse(spark):
    literal = "{'id': 5, 'id_str': '5', 'text': 'it\\'s', 'user': None, 'truncated': True}"
    good, bad = parsed(spark, ["", "x", "{'id': 4}", literal, '{"id": 6, "text": "cut', '{"limit": 1}', "[1, 2]", '{"id": 7, "user": {"followers_count": "many"}}', "__import__('os')"])
    assert sorted(r["id"] for r in good.select("post.id").collect()) == [4, 5, 7]
    assert good.filter("post.id = 5").select("post.text").first()[0] == "it's"
    assert {r["value"] for r in bad.collect()} == {'{"id": 6, "text": "cut', "[1, 2]", "__import__('os')"}


def test_nested_posts_are_emitted_once_and_top_level_wins(spark):
    rows = extract(spark, STREAM)
    assert set(rows) == {"1", "2", "11", "13", "14", "15"}
    assert rows["1"]["text"] == "top level"
    assert rows["13"]["text"] == "the full text"
    assert rows["13"]["has_quote"] and rows["13"]["quoted_status_id"] == "2"
    assert rows["11"]["user_description"] == "a & b"


def test_counts(spark):
    rows = extract(spark, STREAM)
    counts = {k: (r["num_replies"], r["num_quotes"], r["num_retweets"]) for k, r in rows.items()}
    # the duplicate quote counts once, the retweet of a quote is no quote
    assert counts["1"] == (1, 2, 0)
    assert counts["2"] == (0, 0, 0)
    assert counts["13"] == (0, 0, 1)


def test_flags(spark):
    assert set(extract(spark, STREAM, extract_quotes=False)) == {"1", "2", "13", "14"}
    with_retweets = extract(spark, STREAM, extract_retweets=True)
    assert with_retweets["12"]["text"] == "the full text"
    plain = extract(spark, STREAM, dedup=False, count_replies=False, emit_nested=False)
    assert set(plain) == {"1", "11", "14", "15"}
    assert plain["1"]["num_quotes"] == 3 and plain["1"]["num_replies"] == 0


def test_stage_gives_the_same_posts(spark, tmp_path):
    assert extract(spark, STREAM, stage=str(tmp_path / "s")) == extract(spark, STREAM)


@pytest.mark.parametrize("parts", [1, 7])
def test_winner_does_not_depend_on_partitioning(spark, parts):
    values = [post(str(100 + i), quoted_status=post("1", text=f"copy {i}")) for i in range(40)]
    good, _ = raw.parse_lines(lines_of(spark, values).repartition(parts))
    winners = extraction.distinct_posts(extraction.post_copies(good))
    assert winners.filter("id = '1'").first()["text"] == "copy 0"
    assert "WindowGroupLimit" in winners._jdf.queryExecution().toString()


def test_times_and_mentions(spark):
    df = spark.createDataFrame([("Thu May 07 10:11:12 +0200 2020",), ("nonsense",), (None,)], "c string")
    got = [r[0] for r in df.select(F.date_format(P.parse_created_at(F.col("c")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2020-05-07 08:11:12", None, None]
    mention = {"user_mentions": [{"id_str": "7"}, {"id_str": "8"}]}
    good, _ = parsed(spark, [post("1", entities=mention), post("2", entities=mention, extended_tweet={"full_text": "x", "entities": {"user_mentions": []}}), post("3")])
    assert [r[0] for r in good.orderBy("line_no").select(P.user_mentions(F.col("post"))).collect()] == [["7", "8"], None, None]


def test_counts_absent_everywhere(spark):
    posts = spark.createDataFrame([("a", False, None, None, None)], "id string, is_retweet boolean, quoted_status_id string, retweeted_status_id string, in_reply_to_status_id string")
    row = interactions.with_counts(posts, interactions.interaction_counts(posts)).first()
    assert (row["num_replies"], row["num_quotes"], row["num_retweets"]) == (0, 0, 0)


def test_dump_streams_a_hot_post(spark, tmp_path):
    """One object a post, a post of 200 000 retweets included; rows are written as they come, nothing is collected."""
    rows = spark.range(200_300).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") < 200_000, "hot").otherwise(F.concat(F.lit('q"'), (F.col("id") % 3).cast("string"))).alias("retweeted_status_id"),
        F.format_string("u%07d", 300_000 - F.col("id")).alias("user_id"),
    )
    pieces = retweeters.dump_pieces(rows.repartition(5), F.struct("user_id", F.lit(None).cast("string").alias("user_location")))
    plan = pieces._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    retweeters.write_grouped_json(pieces, str(tmp_path / "dump"))
    lines = [json.loads(r["value"]) for r in retweeters.read_grouped_json(spark, str(tmp_path / "dump")).collect()]
    users = {name: found for line in lines for name, found in line.items()}
    assert len(lines) == 4 and {n: len(u) for n, u in users.items()} == {"hot": 200_000, 'q"0': 100, 'q"1': 100, 'q"2': 100}
    assert all(u == sorted(u, key=lambda x: x["user_id"]) for u in users.values())
    assert users['q"0'][0] == {"user_id": min(x["user_id"] for x in users['q"0']), "user_location": None}


def test_dump_lines_are_joined_from_blocks(spark, tmp_path):
    rng = random.Random(1)
    for i in range(4):
        ends = ["\n", "\n ", "\r\n", " \n", "\n\n"]
        lines = [" ".join(rng.choice(["", "a", "bb  c", " ", "{x", "é", "y y"]) for _ in range(rng.randint(0, 90))) + rng.choice(ends) for _ in range(rng.randint(1, 12))]
        (tmp_path / f"part-{i}.txt").write_bytes(("".join(lines) + "last" * (i % 2)).encode())
    texts = [p.read_bytes().decode() for p in sorted(tmp_path.iterdir())]
    expected = sorted(x.strip(" ") for t in texts for x in re.split("[\r\n]", t) if x.strip(" "))
    for block, rows in (("1g", "10000"), ("100", "10000"), ("500", "3")):
        with session_conf(spark, spark__sql__files__maxPartitionBytes=block, spark__sql__files__openCostInBytes="1", spark__sql__execution__arrow__maxRecordsPerBatch=rows):
            found = retweeters.read_grouped_json(spark, str(tmp_path))
            assert sorted(r["value"] for r in found.collect()) == expected
            # words are joined; no task reads on to the end of a line of other blocks
            assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
