"""Page extraction, benchmark leaks, toxicity and personal data against plain Python, hand-made cases and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweir.llm import leaks, pages, pii, toxicity
from tests.llm import cases

PAGES = "page_id long, url string, html string, text string"


def extract(spark, rows):
    got = pages.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    return {r.page_id: r.text for r in got}


def test_pages_of_the_table(spark):
    rows = spark.read.parquet(f"{cases.SF}/pages.parquet").collect()
    got = {r.page_id: r for r in pages.extract_text(spark.read.parquet(f"{cases.SF}/pages.parquet")).collect()}
    import html

    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        article = re.sub(r"<[^>]*\Z", "", article)
        parts = (html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", article))
        want = " ".join(x for x in (re.sub(r"\s+", " ", x).strip() for x in parts) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_odd_pages(spark):
    got = extract(spark, [
        (1, "http://h/a", None, "x"), (2, None, "", "x"), (3, "http://h/b", "plain &amp; <b>bold</b>\n text", "x"),
        (4, "http://h/c", "<main><p>one<p>two<ul><li>a<li>b</ul></main><p>after", "x"),
        (5, "http://h/d", "<article><p>kept</p><div class='user comments'><p>reader</p></div><form>f</form><p>more <!-- no --> &#233;&lt;</p></article>", "x"),
        (6, "http://h/e", "<nav>menu<article><p>cut <a href='x'>off</a> te<b", "x"),
        (7, "http://h/f", "<body><script>if (a < b) x('</p>')</script><style>p</style><div id=cookie-notice>we use</div><article><header><h1>T</h1></header>x</article>", "x"),
        (8, "http://h/g", "<" * 3000 + "a" + "&" * 3000 + "<p title=\"" * 500, "x"),
        (9, "http://h/z", "dup", "x"), (9, "http://h/z", "dup", "x"),
    ])
    assert (got[1], got[2], got[3]) == ("", "", "plain & bold text")
    assert got[4] == "one two a b"
    assert got[5] == "kept more é<"
    assert got[6] == "" and got[7] == "T x"
    assert pages.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_neighbours_lose_shared_lines(spark):
    page = "<body><div>Site of news</div><div>{}</div><div>All rights kept</div></body>"
    got = extract(spark, [(i, f"http://h.example/en/1{i}?x={i}", page.format(f"story {i}"), "") for i in range(8)])
    assert got == {i: f"story {i}" for i in range(8)}


def test_neighbours_decide_inside_the_article(spark):
    """A line that both neighbours have goes; without one of them it stays, and so does the text of mirrors."""
    page = "<article><p>story {0} a</p><p>story {0} b</p><p>Read us daily</p><p>story {0} c</p></article>"
    rows = [(i, f"http://h.example/en/1{i}", page.format(i), "") for i in range(3)]
    assert extract(spark, rows)[1] == "story 1 a story 1 b story 1 c"
    assert extract(spark, rows[:2])[1] == "story 1 a story 1 b Read us daily story 1 c"
    mirrors = [(i, f"http://h.example/en/1{i}", page.format(0), "") for i in range(3)]
    assert set(extract(spark, mirrors).values()) == {"story 0 a story 0 b Read us daily story 0 c"}
    # n_shared counts the lines a neighbour shares, whether they go or stay
    assert {r.n_shared for r in pages.extract_text(spark.createDataFrame(mirrors, PAGES)).collect()} == {4}


def test_neighbours_are_those_of_the_whole_host(spark, monkeypatch):
    """Paths of a host that end or begin differently are neighbours too, in one range or in many, and pages of other hosts are not."""
    page = "<body><div>Site of news</div><div>{}</div><div>All rights kept</div></body>"
    paths = ["", "/a", "/about/us", "/blog/2020/first", "/contact", "/en/1", "/en/100", "/en/100", "/fr/7", "/index.php?id=3", "/index.php?id=4", "/z"]
    rows = [(i, f"http://h.example{p}", page.format(f"story {i}"), "") for i, p in enumerate(paths)]
    rows += [(100, "http://a.example/a", page.format("alone"), ""), (101, "http://z.example/z", page.format("alone"), ""), (None, None, page.format("no name"), "")]
    lonely = "Site of news {} All rights kept"
    want = {i: f"story {i}" for i in range(len(paths))} | {100: lonely.format("alone"), 101: lonely.format("alone"), None: lonely.format("no name")}
    assert extract(spark, rows) == want
    for ranges in (1, 40):
        monkeypatch.setattr(pages, "RANGES", ranges)
        assert extract(spark, rows) == want


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, s in zip(a, pages.shared_lines(a, b), strict=True) if s]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def edit_distance(a, b, free=False):
    row = [0] * (len(b) + 1) if free else list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1] + [min(row[j] + (x != y), row[j + 1] + 1) for j, y in enumerate(b)]
        for j in range(len(b)):
            row[j + 1] = min(row[j + 1], row[j] + 1)
    return min(row) if free else row[-1]


def test_best_match():
    rng = random.Random(6)
    for _ in range(300):
        pattern, text = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        want = edit_distance(pattern, text, True)
        start, end, edits = leaks.best_match(pattern, text, len(pattern))
        assert edits == want == edit_distance(pattern, text[start:end])


def test_leaks(spark):
    items = spark.read.parquet(f"{cases.SF}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    some = texts[3]
    extra = [f"é before {some.upper()} after", "x " + some.replace("\n", " \n\t ") + " y", "pre " + some[:80] + "zz" + some[83:] + " post", some, some + some, some[: len(some) // 2]]
    docs = cases.documents(spark, extra)
    got = {(r.doc_id, r.l.item_id): r.l for r in leaks.find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).collect()}
    flat = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t.lower()).strip()
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    exact = {(d, i) for d, x in rows.items() for i, t in texts.items() if flat(t) in flat(x)}
    assert exact <= set(got) and all(got[k].edits == 0 for k in exact)
    first = 100_000 + len(cases.odd_texts())
    assert {d for d, i in got if i == 3 and d >= first} == {first + k for k in range(5)} and got[first + 2, 3].edits > 0
    for (d, i), m in got.items():
        assert edit_distance(flat(rows[d][m.start : m.end]), flat(texts[i])) <= 0.1 * len(texts[i]) + 1
    odd = spark.createDataFrame([(None, "a" * 50), (1, None), (2, "short"), (3, some), (3, some)], "item_id long, text string")
    assert {r.doc_id for r in leaks.find_leaks(docs, odd).where(F.size("leaks") > 0).collect()} >= {first, first + 3}
    assert leaks.find_leaks(docs, items.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert leaks.find_leaks(cases.empty(spark), items).count() == 0


def test_looking_for_leaks_takes_memory_by_slices():
    """The hashes of a long text and the walks of its windows are held a slice at a time; what is found doesn't depend on the slices."""
    items = [f"item {i} " + "abcdefghij klmnop "[i % 7 :] * 12 for i in range(20)]
    block = leaks.Items(list(range(20)), items)
    rng = np.random.default_rng(1)
    noise = rng.integers(97, 123, 1 << 21, dtype=np.uint8).tobytes()
    text = b"".join(noise[i << 16 : (i + 1) << 16] + items[i % 20].encode().strip() + b" " for i in range(32))
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    tracemalloc.start()
    found = block.find(data, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {k for _, k, *_ in found} == set(range(20)) and all(m[-1] == 0 for m in found)
    assert peak < 40 << 20 and block.moves.itemsize == 1


def test_leak_recall_with_many_edits():
    import duckdb

    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.1/benchmark.parquet'").fetchall()
    block, rng = leaks.Items([i for i, _ in items], [t for _, t in items]), random.Random(2)
    found = 0
    for k, text in enumerate(block.texts):
        noisy = bytearray(text)
        for _ in range(int(0.08 * len(text))):
            noisy[rng.randrange(len(noisy))] = rng.choice(b"abcdef ")
        data = np.frombuffer(b"some words before " + bytes(noisy) + b" and after", np.uint8)
        found += any(m[1] == k for m in block.find(data, np.array([0, len(data)])))
    assert found >= 0.9 * len(block.texts)


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~held), ["quality", "toxic"])
    got = toxicity.score(docs, model, ["quality", "toxic"], ["doc_id"]).join(labels.where(held), "doc_id")
    counts = {(r.toxic, r.hit): r["count"] for r in got.groupBy("toxic", (F.col("p_toxic") > 0.5).alias("hit")).count().collect()}
    assert counts[1, True] >= 0.9 * (counts[1, True] + counts[1, False])
    assert counts.get((0, True), 0) <= 0.01 * counts[0, False]


def test_toxicity_odd_rows(spark):
    docs = cases.documents(spark)
    labels = spark.read.parquet(f"{cases.SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (100_000, 1, 0), (100_000, 1, 0)], "doc_id long, quality int, toxic int"))
    model = toxicity.fit(docs, labels, ["quality", "toxic"])
    got = toxicity.score(docs, model, ["quality", "toxic"])
    assert got.count() == docs.count() and got.columns == [*docs.columns, "p_quality", "p_toxic"]
    assert got.where("p_toxic IS NULL OR p_toxic NOT BETWEEN 0 AND 1").count() == 0
    nothing = toxicity.fit(docs, labels.limit(0), ["quality", "toxic"])
    assert toxicity.score(docs, nothing, ["quality", "toxic"]).where("p_toxic <> 0.5").count() == 0
    assert toxicity.score(cases.empty(spark), model, ["quality", "toxic"]).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_personal_data(spark):
    rng = random.Random(8)
    pieces = ["a.b+c@d-e.fg", "@", "x@y", "1.2.3.4", "300.2.3.4", "001.2.3.4", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", " ", "-", "é", "\U0001f600",
              "+1 (212) 555-0123", "+49 30.1234-5678", "+", "7", "\n", "..", "@q.r", "%", "()", "word"]
    extra = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    extra += ["a" * 60_000 + "@b.c", "1" * 50_000, "1.2.3.4" * 3000, "a@b" + ".c" * 30_000, "+1" + " 2" * 20_000]
    docs = cases.documents(spark, extra)
    found = pii.find_personal_data(docs)
    got = {r.doc_id: r for r in found.withColumn("masked", pii.mask(F.coalesce("text", F.lit("")), F.col("spans"))).collect()}
    for r in docs.collect():
        g, want = got[r.doc_id], plain_spans(r.text or "")
        assert [tuple(s) for s in g.base] == want, (r.doc_id, (r.text or "")[:80])
        assert set(want) <= {tuple(s) for s in g.spans}
        text, at, out = r.text or "", 0, []
        for start, _, end, kind in sorted(tuple(s) for s in g.spans):
            out += [text[at:start], f"[{kind.upper()}]" if end > at else ""]
            at = max(at, end)
        assert g.masked == "".join(out) + text[at:]
    assert found.columns == [*docs.columns, "base", "spans"]
    assert pii.find_personal_data(cases.empty(spark)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    emails = [(100 + i, f"text number please write to user{i}x@mail{i}.org soon") for i in range(30)]
    unseen = [(500, "so please write to user7(at)mail7 now"), (501, "version is at 2.0 now"), (502, "please call to user8 now")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(emails + unseen, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[500].spans] == [(19, 0, 33, "email")]
    assert not got[501].spans and not got[502].spans
    digest = hashlib.sha256(b"email:28:44").hexdigest()
    row = spark.createDataFrame([got[100]]).select(F.sha2(pii.span_list(F.col("base")), 256).alias("d")).first()
    assert row.d == digest


@pytest.mark.parametrize("kind", BASE)
def test_hints_lose_nothing(spark, kind):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("1.+-() @a") for _ in range(30))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, t string")
    dropped = df.where(~F.col("t").rlike(pii.HINTS[kind])).collect()
    assert not [r.t for r in dropped if any(s[3] == kind for s in plain_spans(r.t))]
