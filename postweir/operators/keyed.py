"""Keyed row selection: one row per key, distributed row numbers, seeded samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweir.session import ensure_checkpoint_dir

_OFFSET_BITS = 33  # monotonically_increasing_id keeps the row offset in its lower 33 bits


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key that comes first in `order`.

    Spark limits every map task to one row per key before the shuffle (WindowGroupLimit), so a
    key held by a third of all rows reaches its reducer once per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def content_hash(df: DataFrame) -> Column:
    """A number from 0 that depends on the values of a row only; maps, which Spark does not hash, are left out."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.shiftrightunsigned(F.xxhash64(*hashed), 1) if hashed else F.lit(0).cast("bigint")


def spread_join(df: DataFrame, lookup: DataFrame, keys: list[str], asks: Column, how: str = "left") -> DataFrame:
    """Join in which only the rows that `asks` selects can find a partner; the others pass through.

    Rows that ask nothing (most posts have no position, many users no name) would all hash to one
    partition under a NULL key. They carry a hash of their own content as a further key instead, which spreads them and
    stays the same when a task is run again.
    """
    asks = F.coalesce(asks, F.lit(False))
    turn = F.when(asks, F.lit(-1)).otherwise(content_hash(df))
    left = df.withColumn("_turn", turn)
    return left.join(lookup.withColumn("_turn", F.lit(-1).cast("bigint")), [*keys, "_turn"], how).drop("_turn")


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Consecutive numbers from 0 in the given order, which must identify a row.

    A range-partitioned sort is checkpointed to shared storage, so partition numbers stay fixed
    when an executor is lost; each row then adds its offset in the partition to the number
    of rows in the partitions before. The joined table has one row per partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).checkpoint()
    located = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_offset", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        located.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    numbered = located.join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_offset")).drop("_part", "_offset", "_start")


def zip_rows(frames: list[DataFrame], orders: list[list[str]], strict: bool = True) -> DataFrame:
    """Glue tables side by side by row number; column names must not clash.

    Unequal lengths fail the job when `strict`, else the shorter tables are padded with NULL.
    """
    joined = None
    for i, (frame, order) in enumerate(zip(frames, orders, strict=True)):
        numbered = with_row_index(frame, order).withColumn(f"_has_{i}", F.lit(True))
        joined = numbered if joined is None else joined.join(numbered, "row_index", "full")
    flags = [F.col(f"_has_{i}") for i in range(len(frames))]
    if strict:
        complete = F.lit(True)
        for flag in flags:
            complete = complete & flag.isNotNull()
        checked = F.when(complete, F.col("row_index")).otherwise(
            F.raise_error(F.lit("tables have different lengths")).cast("bigint")
        )
        joined = joined.withColumn("row_index", checked)
    return joined.drop(*[f"_has_{i}" for i in range(len(frames))])


def seeded_hash(keys: list[str], seed: int) -> Column:
    """32 hex digits that depend on the key values and the seed only."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n distinct non-NULL keys (all when there are fewer), uniform and reproducible."""
    names = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return names.orderBy(seeded_hash([key], seed), key).limit(n)


def split_by_hash(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a threshold on the hash: no shuffle, sizes only approximately right."""
    part = F.conv(F.substring(seeded_hash(keys, seed), 1, 8), 16, 10).cast("bigint")
    cut = int(round(test_size * (1 << 32)))
    return df.filter(part >= cut), df.filter(part < cut)


def with_exact_split(
    df: DataFrame,
    keys: list[str],
    test_size: float = 0.2,
    seed: int = 42,
    by: list[str] | None = None,
    few_groups: bool = False,
    digits: int = 4,
    name: str = "is_test",
    stage: bool = True,
) -> DataFrame:
    """Flag ceil(test_size * n) rows as test, per group of `by`; the keys must identify a row of the group.

    The rows are read several times, so they are checkpointed first; a caller whose rows are cheap to read again sets `stage` to false.

    The cut is found by counting leading hash digits (at most 16**digits cells per group) and
    ranking only the rows of the one cell in which the cut falls. Without `by` the table is
    neither sorted nor shuffled. With `by` it is joined with one cut per group; set
    `few_groups` only where the groups are a fixed short list, so that table can be broadcast.
    """
    by = by or []
    if stage:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint()
    small = F.broadcast if few_groups else (lambda table: table)
    hashed = df.withColumn("_hash", seeded_hash(keys, seed)).withColumn("_cell", F.substring("_hash", 1, digits))
    cells = hashed.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    all_rows = Window.partitionBy(*by)
    so_far = all_rows.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(
        *by,
        "_cell",
        F.sum("_rows").over(so_far).alias("_upto"),
        "_rows",
        F.ceil(F.lit(test_size) * F.sum("_rows").over(all_rows)).alias("_wanted"),
    )
    # the cell in which the last test row lies, and how many of its rows are test rows
    edge = cells.filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_rows") < F.col("_wanted"))).select(
        *by, "_cell", (F.col("_wanted") - F.col("_upto") + F.col("_rows")).alias("_take")
    )
    keyed = hashed.select(*by, "_cell", "_hash")
    if by:
        near = keyed.join(small(edge), [*by, "_cell"])
    else:
        near = keyed.filter(F.col("_cell") == edge.select("_cell").scalar()).withColumn(
            "_take", edge.select("_take").scalar()
        )
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_hash")))
    cuts = ranked.filter(F.col("_rank") == F.col("_take")).select(*by, F.col("_hash").alias("_cut"))
    if by:
        flagged = hashed.join(small(cuts), by, "left").withColumn(name, F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False)))
        return flagged.drop("_hash", "_cell", "_cut")
    cut = cuts.select("_cut").scalar()
    return hashed.withColumn(name, F.coalesce(F.col("_hash") <= cut, F.lit(False))).drop("_hash", "_cell")


def train_dev_test(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Column `split`: 20 % test, then 20 % of the rest dev, the remainder train."""
    outer = with_exact_split(df, keys, 0.2, seed)
    inner = with_exact_split(outer, keys, 0.2, seed + 1, ["is_test"], few_groups=True, name="_dev", stage=False)
    split = F.when(F.col("is_test"), "test").when(F.col("_dev"), "dev").otherwise("train")
    return inner.withColumn("split", split).drop("is_test", "_dev")


def positional_split(
    df: DataFrame, order: list[str], train_share: float = 0.8, max_dev: int = 200_000
) -> DataFrame:
    """Column `split` along the order, which must identify a row: the last rows are dev, at most `max_dev` of them.

    The first dev row is selected, the table is not sorted: the order columns alone are dealt into ranges, each range is counted, and only
    the one that holds the cut is ranked. Rows are then compared with the cut where they are. `df` is read twice.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names = [f"k{i}" for i in range(len(order))]
    keys = df.select(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
    ranges = keys.repartitionByRange(*names).checkpoint()
    sizes = {r["part"]: r["count"] for r in ranges.groupBy(F.spark_partition_id().alias("part")).count().collect()}  # one row per partition
    total = sum(sizes.values())
    n_train, before = max(math.floor(train_share * total), total - max_dev), 0
    for part in sorted(sizes):
        if before + sizes[part] > n_train:
            cut = ranges.filter(F.spark_partition_id() == part).orderBy(*names).offset(n_train - before).first()
            first = F.struct(*[F.lit(cut[n]).cast(keys.schema[n].dataType).alias(n) for n in names])
            here = F.struct(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
            return df.withColumn("split", F.when(here < first, "train").otherwise("dev"))
        before += sizes[part]
    return df.withColumn("split", F.lit("train"))
