"""Ranked search against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from postweir.llm import ranking
from tests.llm import cases

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text: str | None) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def expected(docs: list[tuple], items: list[tuple], limit: int) -> Counter:
    """(item_id, rank, doc_id, score); rows that share an id are documents of their own."""
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out: Counter = Counter()
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 50 + (50 * c.total() * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out.update((item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:limit]))
    return out


def searched(spark, docs, items, path, limit=50) -> Counter:
    ranking.build_index(docs, str(path))
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.search(spark, str(path), items, limit).collect())


def check(spark, docs, items, path, limit=50):
    rows, asked = ([tuple(r) for r in df.select(c, "text").collect()] for df, c in ((docs, "doc_id"), (items, "item_id")))
    got = searched(spark, docs, items, path, limit)
    assert got == expected(rows, asked, limit)
    return got


def odd_items(spark):
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{cases.SF}/benchmark.parquet").collect()]
    odd = [(900, None), (901, ""), (902, "  -- !"), (903, "nowhere-known"), (None, "one more END é Ünï"), (900, "a b c d 1.2.3.4 \U0001f600"), (904, " ".join(t or "" for t in cases.odd_texts()))]
    return spark.createDataFrame([(*r, 3, 1) for r in rows + odd], "item_id long, text string, rank int, score int")


def test_documents(spark, tmp_path):
    docs = cases.documents(spark, ["one more end", "ONE more end", None])
    docs = docs.unionByName(spark.createDataFrame([(None, "one one two é", *[None] * 3, 1, 2), (100_003, "one other", *[None] * 3, 1, 2)], cases.COLUMNS))
    got = check(spark, docs, odd_items(spark), tmp_path / "index")
    assert max(got.values()) == 1 and any(r[2] is None for r in got)


def test_small_segments(spark, tmp_path, monkeypatch):
    """Many segments, several blocks of items, few ranges opened at once, many equal scores, a limit that cuts through them."""
    monkeypatch.setattr(ranking, "OPENED", 3)
    monkeypatch.setattr(ranking, "ITEM_TERMS", 40)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 20, 60])]) for _ in range(rng.choice([1, 4, 30]))) for _ in range(500)] + ["w1 w2"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id")
    items = spark.createDataFrame([(i, " ".join(rng.sample(words, rng.choice([1, 2, 12])))) for i in range(30)], "item_id long, text string")
    check(spark, docs, items, tmp_path / "a", 7)
    check(spark, docs, items, tmp_path / "b", 300)


def test_empty_tables(spark, tmp_path):
    assert not searched(spark, cases.empty(spark), odd_items(spark), tmp_path / "a")
    blank = spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string")
    assert not searched(spark, blank, odd_items(spark), tmp_path / "b")
    assert not searched(spark, cases.documents(spark), odd_items(spark).limit(0), tmp_path / "c")


def test_levels():
    """Each level's cells hold the largest entry below them, and no others are kept."""
    rng = np.random.default_rng(3)
    for n_rows, n_cols in ((1, 1), (5, 2), (300, 17), (40, 130)):
        dense = rng.integers(0, 50, (n_rows, n_cols)) * (rng.random((n_rows, n_cols)) < 0.2)
        dense[-1, -1] = 7
        rows, cols = np.nonzero(dense)
        col_bits = max(n_cols - 1, 1).bit_length()
        levels = ranking.levels_of(rows, cols, dense[rows, cols], col_bits)
        assert levels[-1][0] >= col_bits
        for level, keys, peaks in levels:
            bits, cells = max(col_bits - level, 0), {}
            for r, c in zip(rows, cols, strict=True):
                key = ((int(r) >> level) << bits) | (int(c) >> level)
                cells[key] = max(cells.get(key, 0), int(dense[r, c]))
            assert dict(zip(keys.tolist(), peaks.tolist(), strict=True)) == cells and (np.diff(keys) > 0).all()
