"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "postweir", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings every job here assumes: UTC, AQE with skew handling.

    The number of shuffle partitions is left to the cluster (AQE coalesces it); only a
    local master gets a small one.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's `spark.checkpoint.dir`.

    Only a local master (one process) may fall back to a temporary folder: one for each session, removed at its end.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if not getattr(context, "_postweir_root", None):
        context._postweir_root = tempfile.mkdtemp(prefix="postweir-")
        atexit.register(shutil.rmtree, context._postweir_root, ignore_errors=True)
    return context._postweir_root


def use_utc(spark: SparkSession) -> None:
    """Days and hours of posts are those of UTC, whatever session a job is given."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path below the shared root."""
    return os.path.join(shared_root(spark), "postweir", f"{name}-{uuid.uuid4().hex}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table or folder in any file system that Spark knows."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a written table below the shared root: computed once, of a size that Spark knows, safe from lost executors. The folder stays."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_record(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(paths(f"{path}.part"), True)
    stream.write(text.encode())
    stream.close()
    if not system.rename(paths(f"{path}.part"), paths(path)):
        raise OSError(f"cannot write {path}")


def read_record(spark: SparkSession, path: str) -> str | None:
    """The content of a file of `write_record`, or None without one."""
    return spark.read.option("wholetext", "true").text(path).first()["value"] if path_exists(spark, path) else None


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let an Arrow batch hold about `size` bytes (and one row more), so that a task's memory doesn't grow with the length of texts.

    A setting of the application stays; else the session keeps this one, as frames are computed after the operator that returns them.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(size))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_postweir_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="postweir-zip-"), package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._postweir_shipped = True


@contextmanager
def session_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings for one action; dots are written as double underscores."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
