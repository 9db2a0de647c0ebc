"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from postweir.llm import partenum, repeats
from tests.llm import cases


def shingles(text: str | None) -> frozenset:
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def families(seed: int) -> list[str]:
    """Texts of 1 to 400 words in groups that differ in more and more words, some on the edge of being linked, and a passage in all of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    common, out = [word() for _ in range(60)], []
    for size in (1, 3, 5, 6, 8, 9, 12, 20, 30, 45, 60, 90, 130, 200, 400):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 14, 20):
            text = list(base)
            for _ in range(min(edits, size)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text).upper() if edits == 1 else " ".join(text))
            out.append(" ".join(text + common))
    return out


def expected_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in rows}
    owners, parent = defaultdict(list), {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    for d, s in sets.items():
        for other, both in Counter(o for x in s for o in owners[x] if o < d).items():
            if 100 * both >= 75 * (len(s) + len(sets[other]) - both):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_components(spark):
    docs = cases.documents(spark, families(1) + families(2))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.near_duplicates(docs).collect()}
    assert got == expected_components(rows)


def test_components_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 3)
    docs = cases.documents(spark, families(3), sf=False)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.near_duplicates(docs).collect()}
    assert got == expected_components(rows)


def test_components_of_odd_tables(spark):
    assert partenum.near_duplicates(cases.empty(spark)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None), (2, ""), (9, "z")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 2, 3), (2, 0, 2), (2, 0, 2), (3, 2, 3), (3, 2, 3), (9, 1, 9)]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for size in [*range(1, 80), 96, 127, 128, 170, 171, 255, 256, 340, 511, 700, 1500]:
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for other in {size, -(-size * 75 // 100), size * 100 // 75, max(size * 9 // 10, 1)}:
            both = -(-75 * (size + other) // 175)
            y = np.unique(np.concatenate([x[rng.permutation(size)[: min(both, size, other)]], rng.integers(0, 1 << 63, max(other - both, 0), dtype=np.uint64)]))
            same = len(np.intersect1d(x, y))
            (a, short_a), (b, short_b) = partenum.signatures(x), partenum.signatures(y)
            if 100 * same >= 75 * (len(x) + len(y) - same):
                assert not short_a and not short_b and len(np.intersect1d(a, b)), (size, other)
                members = []
                for s in (x, y):
                    sizes = sorted({partenum.cells(1 << k) for k in partenum.bands(len(s))})
                    members.append(partenum._Member(0, len(s), 0, 0, b"".join(partenum.bitmap(s, c).tobytes() for c in sizes)))
                assert members[0].may_match(members[1])


def test_common_passages_make_no_candidates(spark):
    """Texts that share a passage and nothing else have no signature in common, as common shingles come last; any ranks leave similar sets one."""
    rng = random.Random(3)
    passage = " ".join(f"all{i}" for i in range(60))
    texts = [" ".join(f"own{rng.randrange(1 << 40)}" for _ in range(160)) + " " + passage for _ in range(150)]
    texts += [texts[0] + " more", texts[1].replace("all", "ALL") + " at the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ranks = partenum.common_ranks(docs)
    assert partenum._members(partenum._signed(docs, 0, ranks * 0)).groupBy("signature").count().agg(F.max("count")).first()[0] > 50
    assert partenum._members(partenum._signed(docs, 0, ranks)).groupBy("signature").count().agg(F.max("count")).first()[0] == 2
    got = {r.doc_id: r.component_id for r in partenum.near_duplicates(docs).collect()}
    assert got == {i: i - 150 if i >= 150 else i for i in range(152)}
    table = np.random.default_rng(4).integers(0, partenum.LAST_RANK + 1, 1 << partenum.RANK_BITS).astype(np.uint8)
    x = np.random.default_rng(5).integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2)
    for size in (8, 40, 100, 300, 700):
        a, b = (partenum.signatures(s, 0, table)[0] for s in (x[:size], x[: -(-size * 75 // 100)]))
        assert len(np.intersect1d(a, b))


def expected_removals(texts: list[str | None]) -> list[tuple]:
    raws, count = [(t or "").encode() for t in texts], Counter()
    for raw in raws:
        count.update(raw[i : i + 200] for i in range(len(raw) - 199))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed: int) -> list[str]:
    """Texts that share passages of 150 to 600 bytes in other surroundings, some with small changes, and monotonous ones."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefg hé") for _ in range(n))
    shared = [text(n) for n in (150, 190, 198, 199, 200, 201, 230, 300, 420, 600)]
    out = []
    for p in shared:
        for _ in range(4):
            cut = rng.randrange(len(p))
            out.append(text(rng.randrange(300)) + p + text(rng.randrange(300)))
            out.append(text(rng.randrange(50)) + p[cut:] + text(5) + p[:cut] + p)
    return out + ["a" * 500, "a" * 199, "ab" * 200, "a" * 350 + "b" + "a" * 350, shared[-1], shared[-1], shared[-1][:200], "é" * 150]


def check_removals(spark, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    want = sorted((d, *x) for (d, _), x in zip(rows, expected_removals([t for _, t in rows]), strict=True))
    assert got == want


def test_removals(spark):
    check_removals(spark, cases.documents(spark, passages(1)))


def test_removals_of_common_passages(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LARGEST", 2)
    monkeypatch.setattr(repeats, "PIECE", 700)
    check_removals(spark, cases.documents(spark, passages(2), sf=False))


def test_removals_of_odd_tables(spark):
    assert repeats.remove_repeats(cases.empty(spark)).count() == 0
    rows = [(None, "x" * 100 + "y" * 150), (None, None), (4, "q" + "x" * 100 + "y" * 150), (4, "q" + "x" * 100 + "y" * 150), (4, "z" * 210)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in got) == [(-1, 0, 0), (-1, 250, 250), (4, 210, 210), (4, 251, 251), (4, 251, 251)]


def test_prefix_intervals():
    rng = random.Random(3)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(6)) for _ in range(rng.randint(2, 9))})
        lcp = [0] + [repeats.common(a.encode(), b.encode()) for a, b in zip(words, words[1:], strict=False)]
        want = {(first, last, min(lcp[first + 1 : last + 1])) for first in range(len(words)) for last in range(first + 1, len(words)) if min(lcp[first + 1 : last + 1]) > 0}
        want = {(f, x, d) for f, x, d in want if (f == 0 or lcp[f] < d) and (x + 1 == len(words) or lcp[x + 1] < d)}
        assert set(repeats.prefix_intervals(lcp)) == want
