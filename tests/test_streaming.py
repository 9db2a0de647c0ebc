from __future__ import annotations

import shutil
from datetime import datetime

from pyspark.sql import functions as F

from postweir.operators.extraction import distinct_posts
from postweir.streaming import ingest

EDGES = "created_at timestamp, target string"


def test_late_edges_correct_hours_already_counted(spark, tmp_path):
    source, out = str(tmp_path / "edges"), str(tmp_path / "hours")
    at = lambda day, hour, minute=0: datetime(2024, 1, day, hour, minute)

    def run(*rows):
        spark.createDataFrame(list(rows), EDGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EDGES).parquet(source)
        ingest.count_hours(stream, out, str(tmp_path / "checkpoint")).awaitTermination()

    totals = lambda: sorted((r["hour_start"], r["target"], r["n"]) for r in ingest.hour_totals(spark, out).collect())
    run((at(20, 5, 10), "a"), (at(20, 5, 50), "a"), (at(20, 6), "b"))
    run((at(20, 5, 59), "a"), (at(1, 0), "late"))
    want = [(at(1, 0), "late", 1), (at(20, 5), "a", 3), (at(20, 6), "b", 1)]
    assert totals() == want
    # a trigger that is done again replaces its folder
    batch = spark.read.parquet(f"{out}/batch=1")
    rows = [tuple(r) for r in batch.collect()]
    spark.createDataFrame(rows, batch.schema).write.mode("overwrite").parquet(f"{out}/batch=1")
    assert totals() == want
    shutil.copytree(f"{out}/batch=0", str(tmp_path / "kept"))
    ingest.compact_hours(spark, out)
    assert totals() == want and [p.name for p in (tmp_path / "hours").glob("batch=*")] == ["batch=-2"]
    # a compaction that ended before it removed a folder
    shutil.copytree(str(tmp_path / "kept"), f"{out}/batch=0")
    assert totals() == want
    run((at(1, 0, 30), "late"))
    want = [(at(1, 0), "late", 2), *want[1:]]
    assert totals() == want
    ingest.compact_hours(spark, out)
    assert totals() == want and [p.name for p in (tmp_path / "hours").glob("batch=*")] == ["batch=-3"]


COPIES = "id string, user_id string, created_at timestamp, nested boolean, file_path string, block_start long, line_no long"


def test_a_later_top_level_copy_beats_a_nested_one(spark, tmp_path):
    source, out = str(tmp_path / "copies"), str(tmp_path / "winners")
    noon = datetime(2024, 1, 20, 12)

    def run(*rows):
        spark.createDataFrame([(i, u, t, n, f, 0, line) for i, u, t, n, f, line in rows], COPIES).coalesce(1).write.mode("append").parquet(source)
        copies = ingest.winning_copies(spark.readStream.schema(COPIES).parquet(source), delay="1 hour", keep_hours=2)
        ingest.write_winners(copies, out, str(tmp_path / "checkpoint")).awaitTermination()

    emitted = lambda: sorted((r["id"], r["user_id"]) for r in spark.read.parquet(out).collect())
    winners = lambda: {r["id"]: r["user_id"] for r in ingest.read_winners(spark, out).collect()}
    run(("1", "second line", noon, True, "a", 2), ("1", "first line", noon, True, "a", 1), ("2", "top", noon, False, "a", 3), ("3", "no time", None, False, "a", 4))
    assert emitted() == [("1", "first line"), ("2", "top")]
    run(("2", "nested later", noon, True, "0", 1), ("1", "top later", noon, False, "b", 1))
    assert emitted() == [("1", "first line"), ("1", "top later"), ("2", "top")] and winners() == {"1": "top later", "2": "top"}
    # the watermark passes noon by more than two hours: the state of both is dropped
    run(("4", "much later", datetime(2024, 1, 21, 12), False, "c", 1))
    run(("5", "later still", datetime(2024, 1, 22, 12), False, "d", 1))
    assert winners() == {"1": "top later", "2": "top", "4": "much later", "5": "later still"}


def test_winners_are_ranked_without_a_python_call_for_each_post(spark, tmp_path):
    """Spark ranks a trigger's copies and joins them with the places before, so no Python worker sees a post."""
    source, out = str(tmp_path / "copies"), str(tmp_path / "winners")
    rows = spark.range(20_000).select(
        (F.col("id") % 5000).cast("string").alias("id"), F.col("id").cast("string").alias("user_id"), F.lit(datetime(2024, 1, 20)).alias("created_at"),
        (F.col("id") % 3 > 0).alias("nested"), F.format_string("f%02d", 9 - F.col("id") % 10).alias("file_path"), F.lit(0).cast("bigint").alias("block_start"), F.col("id").alias("line_no"),
    )
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    winners = ingest.winning_copies(stream)
    assert "Python" not in winners._jdf.queryExecution().toString() and "Pandas" not in winners._jdf.queryExecution().toString()
    ingest.write_winners(winners, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = ingest.read_winners(spark, out)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, distinct_posts(rows).collect()))
    assert spark.read.parquet(out).select("batch").distinct().count() == 4
