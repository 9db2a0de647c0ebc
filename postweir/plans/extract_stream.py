"""Capture to extracted posts: pending intervals, extraction, partitioned parquet, ledger.

With a ledger, a run keeps beside the output what later runs need: the copies of all posts in buckets by a hash of their id, and who refers to whom in buckets by the
post referred to. A later run reads the buckets of the posts its lines touch. It changes no table before everything is staged and a
commit record says so; the next run completes a commit that was cut off, and drops what a run without one left behind.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postweir.operators import extraction
from postweir.operators.keyed import first_per_key
from postweir.session import path_exists, read_record, remove_path, scratch_path, ship_package, use_utc, write_record
from postweir.sources import posts as post_files
from postweir.sources import raw

FIRST_DAY = "2020-05-07"  # fixed value: earliest captured day that is processed
#: Buckets of the copies: one hour of capture is written as so many files.
BUCKETS = 32


@dataclass(frozen=True)
class Extraction:
    intervals: int
    posts: int


def bucket_of(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


class Store:
    """The copies of all posts and the references between them, each partitioned by bucket and capture interval."""

    def __init__(self, spark: SparkSession, out: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.schemas: dict[str, StructType] = {}  # of tables that may hold no file yet
        root = f"{out.rstrip('/')}-copies/{buckets}"
        self.copies_path, self.references_path = f"{root}/copies", f"{root}/references"

    def exists(self) -> bool:
        return path_exists(self.spark, self.copies_path) and path_exists(self.spark, self.references_path)

    def _read(self, path: str) -> DataFrame:
        return _table(self.spark, path, self.schemas.get(path))

    def _of(self, path: str, ids: DataFrame, intervals: list[str]) -> DataFrame:
        """Rows outside the given intervals, in the buckets of the ids: both conditions are on partition columns, so other folders are not opened."""
        wanted = sorted(r["b"] for r in ids.select(bucket_of(F.col("id"), self.buckets).alias("b")).distinct().collect())  # at most `buckets` numbers
        return self._read(path).where(F.col("bucket").isin(wanted) & ~F.col("interval").isin(intervals)).drop("bucket")

    def copies(self, ids: DataFrame, without: list[str]) -> DataFrame:
        return self._of(self.copies_path, ids, without).join(ids.select("id"), "id", "left_semi")

    def references(self, targets: DataFrame, without: list[str]) -> DataFrame:
        return self._of(self.references_path, targets, without).join(targets.select(F.col("id").alias("target")), "target", "left_semi")

    def in_intervals(self, intervals: list[str]) -> DataFrame:
        return self._read(self.copies_path).where(F.col("interval").isin(intervals)).drop("bucket")


def _table(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _replacement(spark: SparkSession, rows: DataFrame, staged: str, path: str, intervals: list[str], by: list[str]) -> dict:
    """Stage the rows that are to replace the given intervals of a partitioned table: a step of a commit. Folders that get no rows are listed."""
    rows.write.parquet(staged)
    folders = lambda table: {tuple(r) for r in table.where(F.col("interval").isin(intervals)).select(*by).distinct().collect()}  # noqa: E731 - some per interval
    before = folders(_table(spark, path, rows.schema)) if path_exists(spark, path) else set()
    emptied = sorted(before - folders(spark.read.parquet(staged)), key=str)
    names = ["/".join(f"{c}={v}" for c, v in zip(by, folder, strict=True)) for folder in emptied]
    return {"kind": "intervals", "from": staged, "to": path, "by": by, "emptied": [f"{path}/{name}" for name in names]}


def _apply(spark: SparkSession, step: dict) -> int:
    """One step of a commit. Its rows stay staged, so it can be done again after a failure at any point."""
    rows = spark.read.parquet(step["from"])
    if step["kind"] == "posts":
        return post_files.apply_merge(spark, step["from"], step["to"], step["emptied"], step["by"])
    if step["kind"] == "all posts":
        return post_files.write_posts(rows, step["to"], by=step["by"])
    if step["kind"] == "ledger":
        rows.write.mode("overwrite").parquet(step["to"])
        return 0
    together = rows.hint("rebalance", *step["by"])  # one file a folder, unless it is large
    together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*step["by"]).parquet(step["to"])
    for folder in step["emptied"]:
        remove_path(spark, folder)
    return 0


def _commit(spark: SparkSession, record: str, stage: str) -> int:
    """Carry out the steps of the record; the posts written. Without a record nothing is to be done but to drop a stage."""
    text = read_record(spark, record)
    written = sum(_apply(spark, step) for step in json.loads(text)) if text else 0
    remove_path(spark, record)
    remove_path(spark, stage)
    return written


def run_extraction(spark: SparkSession, root: str, out: str, keywords: list[str], stop_words: list[str], *,
                   ledger: str | None = None, bad_lines: str | None = None, start: str | None = FIRST_DAY,
                   end: str | None = None, by: str = raw.HOUR, buckets: int = BUCKETS, **flags: bool) -> Extraction:
    """Extract all capture files, or with a ledger the intervals whose files have changed.

    With a ledger, a later run computes anew the posts that the old or new lines of the pending intervals hold or refer to, over all copies: several runs give
    what one would have given, also if one of them is cut off anywhere. One run at a time. `buckets` stays the same for a table; with another number, all is extracted anew.
    The interval keys are collected: one short string per hour of capture. Lines are parsed once, for posts and bad lines; bad lines are kept per
    interval. `flags` go to `extract_posts`.
    """
    ship_package(spark)
    use_utc(spark)
    stage = f"{ledger.rstrip('/')}-stage" if ledger else scratch_path(spark, "extraction")
    record = f"{ledger.rstrip('/')}-commit" if ledger else f"{stage}-commit"
    _commit(spark, record, stage)
    files = raw.list_files(spark, root, by).filter(raw.in_interval_range(F.col("interval"), start, end))
    store = Store(spark, out, buckets)
    later = bool(ledger) and store.exists() and path_exists(spark, out)
    known = spark.read.parquet(ledger) if later and path_exists(spark, ledger) else None
    pending = files.select("interval").distinct() if known is None else raw.pending_intervals(files, known)
    intervals = sorted(row["interval"] for row in pending.collect())
    if not intervals:
        return Extraction(0, 0)
    emit_nested, dedup = flags.pop("emit_nested", True), flags.get("dedup", True)
    parsed = raw.parse_all(raw.read_raw(spark, root, start, end, None if known is None else intervals, by))
    placed = extraction.post_copies(parsed, emit_nested, bad="bad").withColumn("interval", raw.path_interval(F.col("file_path"), by))
    placed.write.parquet(f"{stage}/lines")
    lines = spark.read.parquet(f"{stage}/lines")
    found = lines.filter(F.col("id").isNotNull()).drop("bad")
    if dedup:
        found = first_per_key(found, ["interval", "id"], extraction.LINE_ORDER)
    steps = []
    if ledger:
        pieces = {"copies": (found, F.col("id"), store.copies_path), "references": (extraction.references(found), F.col("target"), store.references_path)}
        for name, (rows, key, path) in pieces.items():
            bucketed = rows.withColumn("bucket", bucket_of(key, buckets))
            store.schemas[path] = bucketed.schema
            steps.append(_replacement(spark, bucketed, f"{stage}/{name}", path, intervals, ["bucket", "interval"]))
        found = spark.read.parquet(f"{stage}/copies").drop("bucket")
    if later:
        steps.append(_stage_changes(spark, store, found, stage, out, intervals, keywords, stop_words, by, flags))
    else:
        winners = extraction.distinct_posts(found) if dedup else found
        extraction.posts_from(winners, keywords, stop_words, **flags).write.parquet(f"{stage}/posts")
        steps.append({"kind": "all posts", "from": f"{stage}/posts", "to": out, "by": by})
    if bad_lines:
        bad = lines.filter(F.col("bad").isNotNull()).select(F.col("bad").alias("value"), *extraction.LINE_ORDER[1:], "interval")
        steps.append(_replacement(spark, bad, f"{stage}/bad", bad_lines, intervals, ["interval"]))
    if ledger:
        done = spark.createDataFrame([(i,) for i in intervals], "interval string")
        empty = spark.createDataFrame([], "interval string, file string")
        raw.updated_ledger(files, empty if known is None else known, done).write.parquet(f"{stage}/ledger")
        steps.append({"kind": "ledger", "from": f"{stage}/ledger", "to": ledger})
    write_record(spark, record, json.dumps(steps))
    return Extraction(len(intervals), _commit(spark, record, stage))


def _stage_changes(spark: SparkSession, store: Store, found: DataFrame, stage: str, out: str, intervals: list[str], keywords: list[str], stop_words: list[str], by: str,
                   flags: dict[str, bool]) -> dict:
    """The posts that the old and new lines of the pending intervals touch, merged with the folders that hold them: a step of a commit."""
    columns = found.columns
    extraction.touched_ids(store.in_intervals(intervals).select(columns).unionByName(found)).write.parquet(f"{stage}/touched")
    ids = spark.read.parquet(f"{stage}/touched")
    new_references = spark.read.parquet(f"{stage}/references").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    sources = store.references(ids, intervals).select("id").unionByName(new_references.select("id")).distinct()
    sources.write.parquet(f"{stage}/sources")
    sources = spark.read.parquet(f"{stage}/sources")
    own = store.copies(ids, intervals).select(columns).unionByName(found.join(ids, "id", "left_semi"))
    top = store.copies(sources, intervals).select(columns).unionByName(found.join(sources, "id", "left_semi")).filter(~F.col("nested"))
    posts = extraction.posts_of(own, top, ids, keywords, stop_words, **flags)
    emptied = post_files.stage_merge(posts, out, f"{stage}/new-posts", f"{stage}/posts", by, ids)
    return {"kind": "posts", "from": f"{stage}/posts", "to": out, "by": by, "emptied": emptied}
