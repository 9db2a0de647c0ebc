"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

The sources' targets are shares of a total by weight, none above MOST times its source's size. The documents of a source lie in the order of a seeded hash,
so any run of them is a random sample; the run is gone through as often as the target asks for, and the part up to the target is cut into blocks of about equal size.
How many blocks of each source go to each output shard is drawn top down: a node of the tree holds the blocks of a range of shards and gives its left half as many of each source as
drawing without replacement would, by the hypergeometric distribution, source after source. Sums stay exact at every node. A shard then takes its number of
blocks from each source's permuted blocks, disjoint from those of all others, and its rows are shuffled by a hash within the shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweir.operators.keyed import with_row_index
from postweir.session import ensure_checkpoint_dir, scratch_path

#: Weights by the place of the source in code-point order, repeating; the share of all sizes that is mixed; the most times a source is used.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block and of an output shard.
BLOCK_WORDS, SHARD_WORDS = 1 << 16, 1 << 24
SEED = 42

#: A prime above any number of blocks of a source, so that multiplying by it permutes them.
_PRIME = (1 << 31) - 1


def word_count(text: Column) -> Column:
    """Runs of `[^\\x20\\x09-\\x0D]` in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("bigint")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: inside a lambda Spark computes an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fraction(*of: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` from `total` are among the `good` ones: the value of a uniform u in [0, 1), whole numbers throughout.

    The distribution is summed from its mode outwards by the ratios of neighbouring terms, 14 standard deviations far; what lies beyond has
    a chance below 1e-40. The result never leaves its possible range.
    """
    def with_mode(p: Column) -> Column:
        n_total, n_good, n_drawn = p["total"], p["good"], p["drawn"]
        least = F.greatest(F.lit(0).cast("bigint"), n_drawn - (n_total - n_good))
        most = F.least(n_drawn, n_good)
        share = F.try_divide(n_good.cast("double"), n_total)
        spread = F.sqrt(n_drawn * share * (1 - share) * F.coalesce(F.try_divide((n_total - n_drawn).cast("double"), n_total - 1), F.lit(0.0)))
        mode = F.floor((n_drawn + 1).cast("double") * (n_good + 1) / (n_total + 2))
        reach = F.coalesce(F.ceil(14 * spread), F.lit(0)) + 14
        return _let(F.struct(least.alias("least"), most.alias("most"), F.least(F.greatest(mode, least), most).alias("mode"), reach.alias("reach")), lambda m: with_terms(p, m))

    def with_terms(p: Column, m: Column) -> Column:
        low, high, none = F.greatest(m["least"], m["mode"] - m["reach"]), F.least(m["most"], m["mode"] + m["reach"]), F.array().cast("array<bigint>")
        bad = p["total"] - p["good"] - p["drawn"]  # may be negative

        def above(x: Column) -> Column:  # the term of x over that of x - 1
            return (p["good"] - x + 1).cast("double") * (p["drawn"] - x + 1) / (x.cast("double") * (bad + x))

        def below(x: Column) -> Column:  # the term of x over that of x + 1
            return (x + 1).cast("double") * (bad + x + 1) / ((p["good"] - x).cast("double") * (p["drawn"] - x))

        up = F.when(high > m["mode"], F.sequence(m["mode"] + 1, high)).otherwise(none)
        down = F.when(low < m["mode"], F.sequence(m["mode"] - 1, low)).otherwise(none)
        return _let(F.struct(up.alias("up"), down.alias("down")), lambda s: F.coalesce(search(p, m, s, above, below), m["mode"]))

    def search(p: Column, m: Column, s: Column, above: Callable, below: Callable) -> Column:
        def weigh(ratio: Callable) -> Callable:
            return lambda acc, x: _let(acc["term"] * ratio(x), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))

        def walk(ratio: Callable) -> Callable:
            return lambda acc, x: _let(acc["term"] * ratio(x), lambda t: F.struct(
                t.alias("term"), (acc["left"] - t).alias("left"), F.coalesce(acc["x"], F.when(acc["left"] < t, x)).alias("x")
            ))

        one, no = F.lit(1.0), F.lit(None).cast("bigint")
        both = F.aggregate(s["up"], F.struct(one.alias("term"), one.alias("sum")), weigh(above))["sum"] + F.aggregate(
            s["down"], F.struct(one.alias("term"), F.lit(0.0).alias("sum")), weigh(below))["sum"]
        start = lambda left: F.struct(one.alias("term"), (left - 1.0).alias("left"), F.when(left < 1.0, m["mode"]).otherwise(no).alias("x"))
        return _let(p["u"] * both, lambda left: _let(F.aggregate(s["up"], start(left), walk(above)), lambda upper: F.aggregate(
            s["down"], F.struct(one.alias("term"), upper["left"].alias("left"), upper["x"].alias("x")), walk(below))["x"]))

    given = F.struct(total.cast("bigint").alias("total"), good.cast("bigint").alias("good"), drawn.cast("bigint").alias("drawn"), u.alias("u"))
    return _let(given, with_mode)


def split_quotas(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, source, blocks, first): how many blocks each shard takes from each source (sid, blocks), and the rank of its first one. Shards without any of a source have no row.

    Each shard holds the same number of blocks, give or take one. A node of the tree is a row with one entry for each source that still has blocks there, so
    the number of sources, some thousands, bounds it; nodes are dealt out over tasks once there are many.
    """
    root = sources.where("blocks > 0").select("sid", "blocks").agg(
        F.array_sort(F.collect_list(F.struct("sid", "blocks", F.lit(0).cast("bigint").alias("first")))).alias("quotas"), F.sum("blocks").alias("all")
    )
    nodes = root.where(F.col("all") > 0).select(F.lit(0).cast("bigint").alias("shard"), F.lit(shards).cast("bigint").alias("n"), "quotas", "all")
    for level in range(max(shards - 1, 0).bit_length()):
        if level % 8 == 7:
            nodes = nodes.repartition("shard")
        nodes = nodes.select("all", F.explode(F.when(F.col("n") > 1, _halves(shards, seed)).otherwise(F.array(F.struct("shard", "n", "quotas")))).alias("node")).select("node.*", "all")
    return nodes.select("shard", F.inline("quotas")).select("shard", "sid", "blocks", "first")


def _halves(shards: int, seed: int) -> Column:
    """The two halves of a node (shard, n, quotas, all): arrays of quotas whose blocks are drawn source after source."""
    shard, n, quotas = F.col("shard"), F.col("n"), F.col("quotas")
    half = F.floor(n / 2)
    upto = lambda k: F.floor(k.cast("decimal(38,0)") * F.col("all") / shards).cast("bigint")
    room = upto(shard + half) - upto(shard)
    entry = "array<struct<sid:bigint,blocks:bigint,first:bigint,left:bigint>>"
    start = F.struct(
        F.aggregate(quotas, F.lit(0).cast("bigint"), lambda total, q: total + q["blocks"]).alias("total"), room.alias("drawn"), F.array().cast(entry).alias("done")
    )

    def draw(acc: Column, q: Column) -> Column:
        u = _fraction(F.lit(seed), shard, n, q["sid"])
        return _let(hypergeometric(acc["total"], q["blocks"], acc["drawn"], u), lambda x: F.struct(
            (acc["total"] - q["blocks"]).alias("total"), (acc["drawn"] - x).alias("drawn"),
            F.concat(acc["done"], F.array(F.struct(q["sid"].alias("sid"), q["blocks"].alias("blocks"), q["first"].alias("first"), x.alias("left")))).alias("done"),
        ))

    def child(first: Column, size: Column, done: Column, blocks: Callable, begin: Callable) -> Column:
        some = F.filter(done, lambda e: blocks(e) > 0)
        kept = F.transform(some, lambda e: F.struct(e["sid"].alias("sid"), blocks(e).alias("blocks"), begin(e).alias("first")))
        return F.struct(first.alias("shard"), size.alias("n"), kept.alias("quotas"))

    return _let(F.aggregate(quotas, start, draw)["done"], lambda done: F.array(
        child(shard, half, done, lambda e: e["left"], lambda e: e["first"]),
        child(shard + half, n - half, done, lambda e: e["blocks"] - e["left"], lambda e: e["first"] + e["left"]),
    ))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, sid, weight, target) from (skey, source_size), keys in order.

    Targets share `share` of all sizes by weight. One that exceeds `most` times its source's size stops there, and the excess is shared anew among the
    others until none is above: two numbers of the driver and one pass over the sources each time.
    """
    spark = sizes.sparkSession
    path = scratch_path(spark, "sources")
    numbered = with_row_index(sizes, ["skey"], "sid")
    numbered.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))).write.parquet(path)
    sources = spark.read.parquet(path)
    cap = most * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, stopped = (share * whole["size"] / whole["weight"] if whole["weight"] else 0.0), -1
    while whole["weight"]:
        full = cap <= level * F.col("weight")
        seen = sources.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, cap).otherwise(0)).alias("capped"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if seen["n"] == stopped or not seen["weight"]:
            break
        stopped, level = seen["n"], (share * whole["size"] - seen["capped"]) / seen["weight"]
    return sources.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))


def plan_mix(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
             block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, copies) of each row; copies: array<struct<shard, turn>>, one for each time the mix takes the document.

    Size is the number of words; sources are ordered by code point, null last. A document is taken whole, at most `most` times; a source's words come as near
    its target as half a document at its cut allows. Null, empty and blank texts have size 0 and are never taken. Rows that share an id are rows of their own; the
    hash of id and text decides, so runs agree whatever the order of rows. `turn` orders the rows of a shard. An empty table gives an empty plan.

    Words before a document are summed over hash digits (256 cells of 256 cells a source), so no task sees a whole source.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    key = F.when(F.col(source).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source)))
    path = scratch_path(spark, "sizes")
    docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.col(text)).alias("text_hash"), key.alias("skey"), word_count(F.col(text)).alias("size")
    ).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"c1": F.shiftrightunsigned("text_hash", 56), "c2": F.shiftrightunsigned("text_hash", 48).bitwiseAND(255)})
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, share, most).withColumn("blocks", F.ceil(F.col("target") / block_words).cast("bigint"))
    facts = scratch_path(spark, "targets")
    sources.write.parquet(facts)
    sources = spark.read.parquet(facts)
    shards = max(int(-(-(sources.agg(F.sum("target")).first()[0] or 0) // shard_words)), 1)

    before = lambda order, *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("skey", "c1", "c2").agg(F.sum("size").alias("words"))
    large = cells.groupBy("skey", "c1").agg(F.sum("words").alias("words")).select("skey", "c1", F.coalesce(F.sum("words").over(before(["c1"], "skey")), F.lit(0)).alias("large_start"))
    small = cells.select("skey", "c1", "c2", F.coalesce(F.sum("words").over(before(["c2"], "skey", "c1")), F.lit(0)).alias("small_start"))
    starts = small.join(large, ["skey", "c1"]).select("skey", "c1", "c2", (F.col("large_start") + F.col("small_start")).alias("cell_start")).join(sources, "skey")
    order = ["text_hash", "doc_id", "size"]
    here = Window.partitionBy("skey", "c1", "c2").orderBy(*order)
    placed = rows.join(starts, ["skey", "c1", "c2"]).withColumns({
        "start": F.col("cell_start") + F.coalesce(F.sum("size").over(before(order, "skey", "c1", "c2")), F.lit(0)), "no": F.row_number().over(here),
    })
    return _placed(placed, split_quotas(sources, shards, seed), most, seed).select(
        "doc_id", "text_hash", F.when(F.col("skey") != "2", F.expr("substring(skey, 2)")).alias("source"), "size", "source_size", "target", "copies"
    )


def _placed(placed: DataFrame, quotas: DataFrame, most: int, seed: int) -> DataFrame:
    """The rows with their copies: each copy's block has a permuted rank in its source, and the shard whose quota holds that rank takes it."""
    copies = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(i.alias("copy"), (2 * (i * F.col("source_size") + F.col("start")) + F.col("size")).alias("twice")))
    taken = F.filter(copies, lambda c: (F.col("size") > 0) & (c["twice"] < 2 * F.col("target")))
    each = placed.withColumn("c", F.explode_outer(taken))
    block = F.least(F.floor(F.col("c.twice").cast("double") * F.col("blocks") / (2 * F.col("target"))), F.col("blocks") - 1)
    shift = F.pmod(F.xxhash64(F.lit(seed), "sid"), F.lit(_PRIME))
    rank = F.when(F.col("c").isNotNull(), (block * _PRIME + shift) % F.col("blocks"))
    # a copy that isn't taken asks nothing; it gets a rank below zero of its own
    ranked = each.withColumn("rank", F.coalesce(rank, -1 - F.shiftrightunsigned("text_hash", 1)))
    dealt = quotas.select("sid", "shard", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("rank"))
    joined = ranked.join(dealt, ["sid", "rank"], "left")
    copy = F.when(F.col("shard").isNotNull(), F.struct("shard", F.xxhash64(F.lit(seed), "text_hash", "c.copy", "no").alias("turn")))
    facts = ["doc_id", "text_hash", "skey", "size", "source_size", "target"]
    return joined.groupBy("sid", "c1", "c2", "no", *facts).agg(F.array_sort(F.collect_list(copy)).alias("copies"))


def write_mix(docs: DataFrame, plan: DataFrame, path: str, text: str = "text", seed: int = SEED) -> None:
    """The mixed rows as Parquet with their `shard` and `turn`, sorted by them: each shard's rows lie together, in shuffled order. `seed` is that of the plan."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.col(text))
    once = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
    rows = docs.withColumns({"_hash": key, "_id": F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))}).withColumn("_once", once).where("_once = 1").drop("_once")
    taken = plan.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_hash").alias("_hash"), F.inline("copies"))
    clean = rows.drop("shard", "turn").join(taken, ["_id", "_hash"]).drop("_id", "_hash")
    clean.repartitionByRange("shard", "turn").sortWithinPartitions("shard", "turn").write.parquet(path)
