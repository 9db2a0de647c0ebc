from __future__ import annotations

import gzip
import json
import random
import shutil
import time
from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postweir.plans import annotation_study, bios, extract_stream, retweeter_dump
from postweir.operators import language, predictions, retweeters
from postweir.plans.catalog.stream import _append_capture
from postweir.schema import USER_COLUMNS
from postweir.session import session_conf
from postweir.sources import posts as post_files
from postweir.sources import raw, shards, tables
from tests.test_posts import post, user


def put(root, hour, name, values):
    folder = root / "2020" / "05" / hour[:2] / hour[3:]
    folder.mkdir(parents=True, exist_ok=True)
    opener = gzip.open if name.endswith(".gz") else open
    with opener(folder / name, "wt", encoding="utf-8") as f:
        f.writelines((v if isinstance(v, str) else json.dumps(v)) + "\n" for v in values)


def at(pid, time, **more):
    return post(pid, **more) | {"created_at": f"{time} +0000 2020"}


def test_raw_files_are_pruned_by_path(spark, tmp_path):
    put(tmp_path, "06/23", "a", [post("1")])
    put(tmp_path, "07/00", "b.gz", [post("2"), "", "broken"])
    put(tmp_path, "07/01", "c", [post("3")])
    lines = raw.read_raw(spark, str(tmp_path), "2020-05-07")
    good, bad = raw.parse_lines(lines)
    assert {r[0] for r in good.select("post.id_str").collect()} == {"2", "3"} and bad.count() == 1
    scan = lines._jdf.queryExecution().executedPlan().collectLeaves().head()
    lines.collect()
    assert scan.metrics().apply("numFiles").value() == 2
    days = {r["interval"]: r["n"] for r in raw.list_files(spark, str(tmp_path), raw.DAY).groupBy("interval").agg(F.count("*").alias("n")).collect()}
    assert days == {"2020_05_06": 1, "2020_05_07": 2}
    one = raw.read_raw(spark, str(tmp_path), intervals=["2020_05_07_01"])
    assert one.count() == 1


def test_pending_intervals_compare_sets(spark):
    files = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("d", "1")], "interval string, file string")
    ledger = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", "1"), ("b", "2"), ("c", "1"), ("c", "2"), ("e", "1")], "interval string, file string")
    pending = raw.pending_intervals(files, ledger)
    assert {r[0] for r in pending.collect()} == {"b", "c", "d"}
    after = raw.updated_ledger(files, ledger, pending)
    assert raw.pending_intervals(files, after).count() == 0 and after.filter("interval = 'e'").count() == 1


def stored(spark, path, rows):
    df = spark.createDataFrame([(i, datetime.fromisoformat(t), v) for i, t, v in rows], "id string, created_at timestamp, v int")
    return post_files.write_posts(df, path)


def test_posts_by_hour_with_strict_bounds(spark, tmp_path):
    path = str(tmp_path / "posts")
    n = stored(spark, path, [("a", "2020-05-07 00:00:00", 1), ("b", "2020-05-07 00:59:59", 2), ("c", "2020-05-07 01:00:00", 3), ("d", "2020-05-08 05:00:00", 4), ("e", "2020-05-09 00:30:00", 5)])
    assert n == 5

    def ids(**kw):
        return {r["id"] for r in post_files.read_posts(spark, path, ["id"], **kw).collect()}

    assert ids() == set("abcde")
    assert ids(start="2020-05-07", end="2020-05-09") == {"c", "d"}
    assert ids(start=datetime(2020, 5, 7, 1)) == {"d", "e"}
    assert ids(num_files=1) == {"a", "b"} and ids(start="2030-01-01", num_files=3) == set()
    assert ids(transform=lambda df: df.filter("id > 'c'")) == {"d", "e"}
    plan = post_files.read_posts(spark, path, ["id"], start="2020-05-07")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(" in plan
    assert "v#" not in plan.split("ReadSchema")[1]


def test_merge_keeps_the_other_posts_of_an_hour(spark, tmp_path):
    path = str(tmp_path / "posts")
    stored(spark, path, [("a", "2020-05-07 00:00:00", 1), ("b", "2020-05-07 00:10:00", 2), ("c", "2020-05-07 03:00:00", 3)])
    new = spark.createDataFrame([("b", datetime(2020, 5, 7, 0, 10), 20), ("d", datetime(2020, 5, 7, 0, 20), 4)], "id string, created_at timestamp, v int")
    post_files.merge_posts(new, path)
    assert {(r["id"], r["v"]) for r in post_files.read_posts(spark, path).collect()} == {("a", 1), ("b", 20), ("c", 3), ("d", 4)}


def test_posts_as_sql_view(spark, tmp_path):
    stored(spark, str(tmp_path / "p"), [("a", "2020-05-07 00:00:00", 1)])
    post_files.register_posts(spark, str(tmp_path / "p"), "stored_posts")
    assert spark.sql("SELECT id, hour FROM stored_posts").first().asDict() == {"id": "a", "hour": 0}


def test_shards(spark, tmp_path):
    df = spark.range(95).select("id", F.concat(F.lit("t"), F.col("id")).alias("bio")).coalesce(1)
    shards.write_sharded(df, str(tmp_path), "bio", max_rows=10)
    texts = list((tmp_path / "txt").glob("*.txt"))
    assert len(list((tmp_path / "parquet").glob("*.parquet"))) == 10
    assert max(len(p.read_text().splitlines()) for p in texts) <= 10
    assert {line for p in texts for line in p.read_text().splitlines()} == {f"t{i}" for i in range(95)}


def test_small_tables(spark, tmp_path):
    (tmp_path / "k.txt").write_text("#a\nb c\n\n#a\n", encoding="utf-8")
    assert tables.read_keywords(spark, str(tmp_path / "k.txt")) == ["#a", "b c", "", "#a"]
    (tmp_path / "p.jsonl").write_text('{"label": "x", "label_probabilities": [0.9, 0.1]}\n')
    assert tables.read_predictions(spark, str(tmp_path / "p.jsonl"), "type").first().asDict() == {"type_label": "x", "type_probabilities": [0.9, 0.1]}
    df = spark.createDataFrame([('say "hi",\nyou', "l"), ("", "m")], "text string, label string")
    tables.write_labelled_csv(df, str(tmp_path / "csv"))
    assert tables.read_labelled_csv(spark, str(tmp_path / "csv")).filter("label = 'l'").first()["text"] == 'say "hi",\nyou'
    (tmp_path / "b.jsonl").write_text('{"user": {"id_str": "1"}, "cap": {"universal": 0.5}, "error": "x"}\n')
    assert tables.read_bot_scores(spark, str(tmp_path / "b.jsonl")).first()["cap"]["universal"] == 0.5


def test_extraction_runs_and_continues(spark, tmp_path):
    root, out, ledger = tmp_path / "raw", str(tmp_path / "posts"), str(tmp_path / "ledger")
    put(root, "06/10", "a", [at("9", "Wed May 06 10:00:00")])
    put(root, "07/10", "a.gz", [at("1", "Thu May 07 10:00:00"), at("2", "Thu May 07 10:30:00", quoted_status=at("0", "Tue May 05 08:00:00"))])
    run = lambda: extract_stream.run_extraction(spark, str(root), out, ["text"], ["the"], ledger=ledger, bad_lines=str(tmp_path / "bad"))
    assert run() == extract_stream.Extraction(1, 3)
    assert run() == extract_stream.Extraction(0, 0)
    put(root, "07/11", "a", [at("3", "Thu May 07 10:59:00", in_reply_to_status_id_str="1"), "nonsense"])
    assert run().intervals == 1
    rows = {r["id"]: r for r in post_files.read_posts(spark, out).collect()}
    assert set(rows) == {"0", "1", "2", "3"}
    assert rows["0"]["dt"].isoformat() == "2020-05-05" and rows["0"]["num_quotes"] == 1
    assert rows["3"]["matched_keywords"] == [0] and rows["3"]["token_count"] == 1
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["nonsense"]


COUNTS = ["num_replies", "num_quotes", "num_retweets"]


def test_several_runs_equal_one(spark, tmp_path):
    root = tmp_path / "raw"
    quoted = lambda pid, time, text="original": post(pid, text=text) | {"created_at": f"{time} +0000 2020"}
    hours = {
        "07/10": [at("1", "Thu May 07 10:00:00"), at("2", "Thu May 07 10:30:00", quoted_status=quoted("7", "Thu May 07 09:00:00")), at("90", "no time")],
        "07/11": [at("3", "Thu May 07 11:00:00", in_reply_to_status_id_str="1"), at("4", "Thu May 07 11:10:00", retweeted_status=quoted("1", "Thu May 07 10:00:00", "nested copy"))],
        "07/12": [at("5", "Thu May 07 12:00:00", in_reply_to_status_id_str="1"), at("7", "Thu May 07 09:00:00"), at("6", "Thu May 07 12:00:00", quoted_status=quoted("7", "Thu May 07 09:00:00")), at("91", "no time")],
    }
    run = lambda out, ledger=None: extract_stream.run_extraction(spark, str(root), str(tmp_path / out), ["text"], ["the"], ledger=ledger, extract_retweets=True)
    read = lambda out: sorted(tuple(r) for r in post_files.read_posts(spark, str(tmp_path / out), ["id", "text", "created_at", *COUNTS]).collect())
    for n, (hour, lines) in enumerate(hours.items()):
        put(root, hour, "a", lines)
        assert run("steps", str(tmp_path / "ledger")).intervals == 1
        run(f"whole{n}")
        assert read("steps") == read(f"whole{n}")
    # an old interval changes: a line goes, another one comes
    put(root, "07/11", "a", [hours["07/11"][1], at("8", "Thu May 07 11:20:00", retweeted_status=quoted("1", "Thu May 07 10:00:00"))])
    put(root, "07/11", "b", [""])
    assert run("steps", str(tmp_path / "ledger")).intervals == 1
    run("whole")
    assert read("steps") == read("whole")
    assert {r[0]: r[3:] for r in read("steps")}["1"] == (1, 0, 2)
    put(root, "07/11", "c", [""])
    (root / "2020/05/07/11/a").write_text("\n")
    run("steps", str(tmp_path / "ledger"))
    run("last")
    assert read("steps") == read("last") and "3" not in {r[0] for r in read("steps")}


def test_merge_reads_touched_folders_only(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame([(i, t) for i, t in pairs], "id string, created_at timestamp")
    path = str(tmp_path / "t")
    post_files.write_posts(rows(("a", None), ("b", datetime(2020, 5, 7, 10)), ("d", datetime(2020, 5, 8, 10))), path)
    post_files.merge_posts(rows(("c", None), ("b", datetime(2020, 5, 7, 11))), path)
    stored = spark.read.parquet(path)
    assert sorted(r["id"] for r in stored.collect()) == ["a", "b", "c", "d"]
    assert not (tmp_path / "t/dt=2020-05-07/hour=10").exists()
    plan = stored.withColumn("dt", F.date_format("dt", "yyyy-MM-dd")).filter(post_files._in_folders({("2020-05-08", 10), (None, None)}, "hour"))
    assert len(plan.inputFiles()) == 3 and "PartitionFilters: []" not in plan._jdf.queryExecution().toString()
    assert sorted(r["id"] for r in plan.collect()) == ["a", "c", "d"]


def test_nothing_is_left_behind(spark, tmp_path):
    import os

    from postweir.session import shared_root

    put(tmp_path / "raw", "07/10", "a", [at("1", "Thu May 07 10:00:00"), "nonsense"])
    scratch = os.path.join(shared_root(spark), "postweir")
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    for hour in ("07/10", "07/11"):
        put(tmp_path / "raw", hour, "b", [at("2", "Thu May 07 11:00:00", in_reply_to_status_id_str="1"), "more nonsense"])
        extract_stream.run_extraction(spark, str(tmp_path / "raw"), str(tmp_path / "out"), ["x"], [], ledger=str(tmp_path / "l"), bad_lines=str(tmp_path / "bad"))
    assert set(os.listdir(scratch)) == before
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["more nonsense", "more nonsense", "nonsense"]


def test_a_large_interval_is_written_by_several_tasks_in_line_order(spark, tmp_path):
    lines = spark.range(20_000).select(
        F.lit("2024").alias("y"), F.lit("01").alias("m"), F.lit("01").alias("d"), F.lit("00").alias("h"), ((F.col("id") * 7919) % 20_000).alias("event_id"), F.lit(0).alias("n"),
    ).withColumn("value", F.col("event_id").cast("string"))
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        _append_capture(lines, str(tmp_path / "raw"))
    files = sorted((tmp_path / "raw" / "y=2024" / "m=01" / "d=01" / "h=00").glob("part-*"))
    assert len(files) > 2 and [int(x) for f in files for x in f.read_text().split()] == list(range(20_000))


def test_retweeter_dump(spark, tmp_path):
    root = tmp_path / "raw"
    put(root, "07/10", "a", [at(str(i), "Thu May 07 10:00:00", retweeted_status=post("1" if i % 2 else "2"), user=user(f"u{i}")) for i in range(10, 20)] * 2)
    put(root, "14/10", "a", [at("30", "Thu May 14 10:00:00", retweeted_status=post("1"))])
    (tmp_path / "ids").write_text("1\n3\n")
    retweeter_dump.run_dump(spark, str(root), str(tmp_path / "ids"), str(tmp_path / "out"))
    lines = [json.loads(line) for p in (tmp_path / "out").glob("*.txt") for line in p.read_text().splitlines() if line.strip()]
    assert [list(line) for line in lines] == [["1"]]
    users = lines[0]["1"]
    assert sorted(u["user_id"] for u in users) == ["u11", "u13", "u15", "u17", "u19"]
    assert all(list(u) == USER_COLUMNS for u in users)


def docs(spark, n=60):
    rows = [(str(i), "the house is big and the water is cold" if i % 2 else "el agua está fría y la casa es grande", "en" if i % 2 else "es") for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, user_description string, lang string")


def test_languages(spark):
    df = docs(spark).union(spark.createDataFrame([("x", "123 !!", None), ("y", None, None)], "user_id string, user_description string, lang string"))
    profiles = language.train_profiles(df, "user_description")
    small = {r["user_id"]: r["detected"] for r in language.detect_lang(df, profiles, ["user_id"], "user_description").collect()}
    assert small["1"] == "en" and small["2"] == "es" and small["x"] is None and small["y"] is None


def test_gram_counts_of_long_texts(spark):
    """Every trigram is counted, and four times the text takes no more than some eight times the time."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    made = {n: " ".join(rng.choice(words) for _ in range(n))[:n] for n in (50_000, 200_000)}
    took = {}
    for n, text in {0: "ab 1 Cd\U00010400e", **made}.items():
        df = spark.createDataFrame([(text,)], "t string").select(language.gram_counts(F.col("t")).alias("g"))
        begin = time.perf_counter()
        got = {r["gram"]: r["times"] for r in df.first()["g"]}
        took[n] = time.perf_counter() - begin
        framed = " ab cd e " if n == 0 else f" {text.strip()} "
        assert got == Counter(language.gram_code(framed[i : i + 3]) for i in range(len(framed) - 2))
    assert took[200_000] < 8 * max(took[50_000], 0.5)


def test_counts_of_a_batch_go_out_in_slices():
    """A batch of long texts is counted slice by slice; what a task holds doesn't grow with the texts of a batch."""
    texts = [f"{chr(97 + i % 26)}bc " * 2500 for i in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(range(302))], ["id"]), pa.array(texts)], ["keys", "counts"])
    parts = list(language._count_rows(iter([batch])))
    assert sum(p.num_rows for p in parts) == 302 and max(p.num_rows for p in parts) * 10_000 <= language.SLICE_CHARS + 20_000
    rows = [r for p in parts for r in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)]
    assert [k["id"] for k, _ in rows] == list(range(302)) and rows[300][1] is None and rows[301][1] is None
    assert all({g["gram"]: g["times"] for g in counts} == Counter(language.gram_code(f" {t} "[i : i + 3]) for i in range(len(t))) for (_, counts), t in zip(rows[:2], texts, strict=False))


def test_bio_corpora(spark, tmp_path):
    sources = [docs(spark), docs(spark, 10).withColumn("user_description", F.lit("abc"))]
    totals = bios.write_prediction_corpus(sources, str(tmp_path / "p"), ["user_id"])
    assert totals == {"read": 70, "distinct": 60, "with bio": 60, "long enough": 60}
    assert shards.read_shards(spark, str(tmp_path / "p")).count() == 60
    profiles = language.train_profiles(docs(spark), "user_description")
    bios.write_languages(spark, str(tmp_path / "p"), profiles, str(tmp_path / "l"))
    labels = docs(spark).select("user_id", F.lit("x").alias("type_label"))
    bios.write_merged_predictions(spark, str(tmp_path / "p"), labels, labels.withColumnRenamed("type_label", "category_label"), spark.read.parquet(str(tmp_path / "l")), str(tmp_path / "m"))
    merged = spark.read.parquet(str(tmp_path / "m"))
    assert merged.columns == ["user_id", "type_label", "category_label", "userbio_lang"] and merged.filter("userbio_lang = 'es'").count() == 30
    named = [s.withColumn("user_screen_name", F.when(F.col("user_id") != "7", F.concat(F.lit("n"), "user_id"))) for s in sources]
    annotated = spark.createDataFrame([("n3",), ("n7",), (None,)], "user_screen_name string")
    bios.write_pretrain_corpus(named, annotated, str(tmp_path / "t"), ["user_id"])
    train, dev = (shards.read_shards(spark, str(tmp_path / "t" / part)) for part in ("train", "dev"))
    # 'abc' has three characters only, n3 is annotated, the nameless user stays
    assert (train.count(), dev.count()) == (47, 12)
    assert train.union(dev).filter("user_id = '7'").count() == 1
    assert bios.bot_check_names(named[0], n=5).count() == 5


def test_positional_merge(spark):
    users = spark.range(5).select(F.col("id").alias("u"))
    part = spark.range(5).select(F.col("id").alias("p"))
    rows = predictions.merge_by_position(users, ["u"], [(part, ["p"])]).collect()
    assert all(r["u"] == r["p"] for r in rows)


def test_annotation_study(spark, tmp_path):
    n = 30
    types, cats = ["Individual:Male", "Institution"], ["Art", "Business"]
    rows = [{
        "username": f"u{i}", "screenname": f"S {i}", "bio": f"the house number {'x' * (i + 1)} &amp; @bob",
        **{f"type{k}": types[i % 2] for k in range(1, 5)}, **{f"coarsetype{k}": types[i % 2] if k < 4 else "" for k in range(1, 5)},
        **{f"category{k}": [cats[i % 2]] for k in range(1, 5)}, **{f"coarsecat{k}": [cats[i % 2 if k < 3 else 0], ""] [:1] for k in range(1, 5)},
        "estimated_coarse_type": types[i % 2], "estimated_gender": None if i % 2 else "Individual:Male",
        "estimated_coarse_majority_category": cats[i % 2] if i else "",
    } for i in range(n)]
    lists = {f"{c}{k}": "array<string>" for c in ("category", "coarsecat") for k in range(1, 5)}
    schema = ", ".join(f"{c} {lists.get(c, 'string')}" for c in rows[0])
    annotated = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    crowd = spark.createDataFrame([tuple(v for f in annotation_study.CROWD_FIELDS for v in [f"{f}" if f == "bio" else f"u{k}" for k in range(10)])],
                                  ", ".join(f"{f}_{k} string" for f in annotation_study.CROWD_FIELDS for k in range(1, 11)))
    profiles = language.train_profiles(docs(spark), "user_description")
    full = annotation_study.with_original_bios(annotated, crowd, profiles, ["username"])
    assert full.filter("bio_original = 'bio'").count() == 10 and full.filter("bio_original_lang = 'en'").count() >= 20
    annotation_study.write_training_data(full, str(tmp_path / "sets"), ["username"])
    sets = spark.read.csv(str(tmp_path / "sets"), header=True)
    assert sets.select("dataset").distinct().count() == 12
    sizes = {r["split"]: r["count"] for r in sets.filter("dataset = 'type_merged'").groupBy("split").count().collect()}
    assert sizes == {"test": 6, "dev": 5, "train": 19}
    assert sets.filter("dataset = 'category_merged'").count() == n - 1
    assert sets.filter("dataset = 'category_merged_unambiguous'").count() == n // 2 - 1
    assert sets.filter("dataset = 'type_merged' and text like '%& @user'").count() == n
    predicted = sets.filter("dataset like 'type_merged%'").select(F.col("dataset").alias("run"), "text", "label", F.lit("individual").alias("prediction"))
    annotation_study.write_report(predicted, str(tmp_path / "report"))
    metrics = spark.read.json(str(tmp_path / "report" / "metrics"))
    assert metrics.filter("run = 'type_merged' and metric = 'accuracy'").first()["value"] == pytest.approx(0.5)
    langs = full.select(F.col("username"), F.col("bio_original_lang").alias("detected")).distinct()
    keyed = annotated.select("username", F.col("bio").alias("text"), F.col("type1").alias("label"), F.lit("Institution").alias("prediction"))
    effects = annotation_study.language_effects(keyed, langs, ["username"])
    assert effects.agg(F.sum("trials")).first()[0] <= n


class Cut(Exception):
    """A run that ends in the middle."""


def test_a_run_that_is_cut_off_is_completed_or_forgotten(spark, tmp_path, monkeypatch):
    """A run is ended after each of its writes in turn; the next one gives what one run over everything gives, and leaves nothing behind."""
    from pyspark.sql.readwriter import DataFrameWriter

    first = {"07/10": [at("1", "Thu May 07 10:00:00"), at("2", "Thu May 07 10:30:00", in_reply_to_status_id_str="1"), "nonsense"], "07/11": [at("3", "Thu May 07 11:00:00", in_reply_to_status_id_str="1")]}
    second = {"07/10": [at("1", "Thu May 07 10:00:00"), "more nonsense"], "07/12": [at("4", "Thu May 07 12:00:00", in_reply_to_status_id_str="1"), at("1", "Thu May 07 10:00:00")]}
    write, left = DataFrameWriter.parquet, [None]

    def parquet(self, *args, **kwargs):
        write(self, *args, **kwargs)
        if left[0] is not None:
            left[0] -= 1
            if left[0] <= 0:
                raise Cut

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)

    def run(name, ledger=True):
        more = {"ledger": str(tmp_path / name / "ledger")} if ledger else {}
        return extract_stream.run_extraction(spark, str(tmp_path / "raw"), str(tmp_path / name / "out"), ["text"], [], bad_lines=str(tmp_path / name / "bad"), buckets=2, **more)

    def content(name):
        posts = post_files.read_posts(spark, str(tmp_path / name / "out"), ["id", "text", "created_at", *COUNTS]).collect()
        return sorted(map(tuple, posts)), sorted(r["value"] for r in spark.read.parquet(str(tmp_path / name / "bad")).collect())

    for hour, lines in first.items():
        put(tmp_path / "raw", hour, "a", lines)
    run("base")
    shutil.copytree(tmp_path / "base", tmp_path / "spare")
    for hour, lines in second.items():
        put(tmp_path / "raw", hour, "a" if hour == "07/12" else "b", lines)
    (tmp_path / "raw/2020/05/07/10/a").unlink()
    run("whole", ledger=False)
    want, n = content("whole"), 0
    while True:
        n += 1
        name = f"cut{n}"
        shutil.copytree(tmp_path / "spare", tmp_path / name)
        left[0] = n
        try:
            run(name)
            ended = True
        except Cut:
            ended = False
        left[0] = None
        run(name)
        assert content(name) == want, n
        assert sorted(p.name for p in (tmp_path / name).iterdir()) == ["bad", "ledger", "out", "out-copies"]
        if ended:
            break
    assert n > 10 and run(name) == extract_stream.Extraction(0, 0)


def test_a_later_run_reads_the_buckets_it_touches(spark, tmp_path):
    """Of the stored copies and references, only the folders of the buckets of touched posts, and none of the pending intervals."""
    put(tmp_path / "raw", "07/10", "a", [at(str(i), "Thu May 07 10:00:00", in_reply_to_status_id_str=str(i + 1)) for i in range(400)])
    put(tmp_path / "raw", "07/11", "a", [at(str(i), "Thu May 07 11:00:00", in_reply_to_status_id_str=str(i - 1)) for i in range(400, 600)])
    extract_stream.run_extraction(spark, str(tmp_path / "raw"), str(tmp_path / "out"), ["text"], [], ledger=str(tmp_path / "ledger"))
    store = extract_stream.Store(spark, str(tmp_path / "out"), extract_stream.BUCKETS)
    ids = spark.createDataFrame([("7",), ("450",), ("450",)], "id string")
    assert [store.copies(ids, x).count() for x in ([], ["2020_05_07_11"])] == [2, 1] and store.references(ids, []).count() == 2
    for path in (store.copies_path, store.references_path):
        opened = store._of(path, ids, []).select(F.input_file_name()).distinct().count()
        assert 0 < opened <= len(spark.read.parquet(path).inputFiles()) / 10
    plan = store.copies(ids, ["2020_05_07_11"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
