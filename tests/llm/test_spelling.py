"""Spelling variants against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from postweir.llm import spelling
from tests.llm import cases


def plain_words(rows: list[tuple]) -> Counter:
    words: Counter[str] = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return Counter({w: n for w, n in words.items() if len(w) >= 6 and n >= 5})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words: Counter) -> list[tuple]:
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def found(words) -> list[tuple]:
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_spellings(words).collect())


def test_documents(spark):
    rng = random.Random(2)
    base = ["marvellous", "colour", "colours", "colouring", "straßen", "façades", "ñandúes", "mississippi", "aaaaaa", "aaaaaaa", "ÀÈÌÒÙÂ", "y" * 3000]
    texts = []
    for word in base:
        for n in (1, 5, 7, 30, 200):
            at = rng.randrange(len(word))
            variant = word[:at] + rng.choice("abcxyzé") * rng.randint(0, 2) + word[at + rng.randint(0, 1) :]
            texts.append(" ".join([variant if n < 200 else word.title()] * n) + "1" + word)
    docs = cases.documents(spark, texts).unionByName(spark.createDataFrame([(None, "colour " * 9, None, None, None, 1, 2)], cases.COLUMNS))
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    counted = spelling.count_words(docs)
    assert {r.word: r.n for r in counted.collect()} == words
    got = found(counted)
    assert got == expected(words) and sum(r[1] is not None for r in got) > 5


def test_pieces_and_chains(spark, monkeypatch):
    """Dense words over few letters, blocks of several pieces, several slices of a matrix, chains of forms."""
    monkeypatch.setattr(spelling, "PIECE", 7)
    monkeypatch.setattr(spelling, "CELLS", 20)
    rng = random.Random(6)
    words = Counter({"".join(rng.choice("abéz") for _ in range(rng.randint(6, 9))): 5 ** rng.randint(1, 9) for _ in range(700)})
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = found(df)
    assert got == expected(words) and max(r[4] for r in got) > 3 and any(r[1] and r[2] != r[1] for r in got)


def test_empty_tables(spark):
    assert spelling.group_spellings(spelling.count_words(cases.empty(spark))).count() == 0
    rows = [(1, None), (2, ""), (3, "1234 !!"), (3, "words " * 9)]
    assert spelling.group_spellings(spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"))).count() == 0


def test_distances():
    a = np.array([list(b"colour"), list(b"ruoloc")], np.uint8)
    for word, expect in ((b"colors", []), (b"colout", [0]), (b"ruolod", [1]), (b"colouur", [0]), (b"ccolour", [0]), (b"colourx", [0]), (b"cruoloc", [1])):
        p, _ = spelling.near_pairs(a, np.array([list(word)], np.uint8))
        assert p.tolist() == expect, word
