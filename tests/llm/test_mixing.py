"""The mix against plain Python: targets, quotas, copies and shards."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postweir.llm import mixing
from tests.llm import cases


def plain_targets(sizes: dict[str | None, int]) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= full
    return target | {s: weight[s] * level for s in free}


def words(text: str | None) -> int:
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check_plan(rows, plan):
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        sizes[source] += words(text)
        largest[source] = max(largest[source], words(text))
    targets = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in plan) == Counter((d, s, words(t)) for d, s, t in rows)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-9, abs=1e-6)
        assert len(r.copies) <= 2 and (r["size"] or not r.copies)
        taken[r.source] += r["size"] * len(r.copies)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6, s
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_targets(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 8, 40):
        sizes = {f"s{i}" if i else None: rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(0, 9) for i in range(n)}
        rows = [("2" if s is None else f"1{s}", size) for s, size in sizes.items()]
        got = mixing.source_targets(spark.createDataFrame(rows, "skey string, source_size long")).collect()
        want = plain_targets(sizes) if n else {}
        assert {r.skey: r.target for r in got} == pytest.approx({"2" if s is None else f"1{s}": t for s, t in want.items()})


def test_hypergeometric(spark):
    """The share of an even grid of u at each value is the distribution's."""
    for total, good, drawn in ((10, 4, 5), (1, 1, 1), (7, 0, 3), (7, 7, 3), (50, 20, 49), (400, 130, 90), (6, 3, 0), (2, 1, 1)):
        n = 4000
        u = (F.col("id") + 0.5) / n
        got = spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), u).alias("x")).groupBy("x").count().collect()
        seen = {r.x: r["count"] / n for r in got}
        for x in range(max(0, drawn - total + good), min(good, drawn) + 1):
            chance = math.comb(good, x) * math.comb(total - good, drawn - x) / math.comb(total, drawn)
            assert seen.pop(x, 0) == pytest.approx(chance, abs=2 / n)
        assert not seen
    big = spark.range(300).select(mixing.hypergeometric(F.lit(10**9), F.lit(4 * 10**8), F.lit(10**6), (F.col("id") + 0.5) / 300).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert big[0] == pytest.approx(4e5, rel=1e-4) and big[1] == pytest.approx(math.sqrt(1e6 * 0.24), rel=0.05)


def test_quotas(spark):
    blocks = {0: 1000, 1: 1, 3: 77, 4: 0, 9: 333}
    sources = spark.createDataFrame(list(blocks.items()), "sid long, blocks long")
    for shards in (1, 2, 7, 64, 600):
        rows = mixing.split_quotas(sources, shards).collect()
        assert {s: n for s, n in blocks.items() if n} == dict(Counter(x for r in rows for x in [r.sid] * r.blocks))
        per_shard = Counter(x for r in rows for x in [r.shard] * r.blocks)
        total = sum(blocks.values())
        assert all(per_shard[k] == (k + 1) * total // shards - k * total // shards for k in range(shards))
        for s, n in blocks.items():
            ranks = sorted(x for r in rows if r.sid == s for x in range(r.first, r.first + r.blocks))
            assert ranks == list(range(n))
    assert rows == mixing.split_quotas(sources.repartition(3), 600).collect()
    # a source with 70 % of the blocks has about 70 % of each shard's
    share = [r.blocks for r in mixing.split_quotas(sources, 14).where("sid = 0").collect()]
    assert 55 < min(share) <= max(share) < 90 and len(set(share)) > 1


def test_plan_of_documents(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    plan = mixing.plan_mix(docs, block_words=500, shard_words=9000)
    first = sorted(plan.collect(), key=repr)
    check_plan(rows, first)
    again = mixing.plan_mix(docs.repartition(3).sortWithinPartitions(F.desc("doc_id")), block_words=500, shard_words=9000)
    assert sorted(again.collect(), key=repr) == first
    shards = Counter(c.shard for r in first for c in r.copies)
    per_shard = Counter()
    for r in first:
        for c in r.copies:
            per_shard[c.shard] += r["size"]
    assert len(shards) > 5 and max(Counter(c.shard for r in first if r.source == "src0" for c in r.copies).values()) < shards.total()


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, source string, size long, copies string, skey string, shard long, blocks int"
    empty = spark.createDataFrame([], schema)
    assert mixing.plan_mix(empty).count() == 0
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", None), (None, None, None), (2, "", "x"), (3, "z " * 40_000, ""), (4, "é é\x1c x", "é"), (5, "q r", "blank")]
    docs = spark.createDataFrame([(*r, 7, "c", "k", 4, 5) for r in rows], schema)
    plan = mixing.plan_mix(docs, block_words=3, shard_words=20_000)
    check_plan([(d, s, t) for d, t, s in rows], plan.collect())
    blank = mixing.plan_mix(docs.withColumn("text", F.lit(" ")))
    assert [(r["size"], r.target, r.copies) for r in blank.distinct().collect()] == [(0, 0.0, [])] * 6 or all(not r.copies and r.target == 0 for r in blank.collect())
    mixing.write_mix(docs, plan, str(tmp_path / "mix"))
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    got = Counter((r.doc_id, r.text, r.shard) for r in mixed.collect())
    want = Counter()
    texts = {(d, words(t), s): t for d, t, s in rows}
    for r in plan.collect():
        want.update((r.doc_id, texts[r.doc_id, r["size"], r.source], c.shard) for c in r.copies)
    assert got == want and {"size", "copies", "skey", "blocks"} <= set(mixed.columns)
