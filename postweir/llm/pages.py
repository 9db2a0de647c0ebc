"""Main text of web pages: what a page shares with its nearest page of the same host is no content of its own.

Pages are cut into lines (blocks of text). Each page meets the pages before and after it in the order of paths within its whole host; their lines are aligned
by longest common subsequence and shared lines are deleted: outside an article or main element those that one neighbour shares, inside those that both share, unless
one of the two is a mirror, a page that shares at least MIRROR of the lines inside. Structure bounds this: parts that say what they are (navigation, footers, adverts, forms,
comments, ...) go in any case, and so does what lies outside such an element of a page that has one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweir.session import session_conf

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label".split())
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MAIN = frozenset(["article", "main"])
ASIDE = frozenset("nav header footer aside form menu dialog button head".split())
#: Words in a class, id or role that name something beside the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary cookie cookies footer header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted related search share sharing sidebar social sponsor sponsored subscribe widget".split()
)
IN_MAIN, OUTSIDE = 1, 0
#: Share of a page's lines in its main element from which on a neighbour that has them is a mirror of the article, and no witness of a frame around it.
MIRROR = 0.5
#: Ranges of pages in the order of host and path, for each shuffle partition of the session, and the keys that Spark's range partitioning looks at to place the end of one.
RANGES, RANGE_KEYS = 8, 6


def _aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE and not (name == "header" and in_main):
        return True
    if "=" not in attributes:
        return False
    words = re.findall(r"[a-z]+", " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower())
    return not ASIDE_WORDS.isdisjoint(words) and name not in ("html", "body", *MAIN)


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The blocks of text outside the parts that name themselves as other than the article, and whether each is in a main element.

    Open elements are closed as browsers do; what a cut-off page leaves open ends with it, and a tag that is cut off is no text.
    """
    lines, zones, run = [], [], []
    stack: list[tuple[str, bool, bool]] = []  # element, left out, in the main element
    skip = main = False
    at = 0

    def close_block() -> None:
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if text:
                lines.append(text)
                zones.append(IN_MAIN if main else OUTSIDE)

    for tag in _TOKEN.finditer(page):
        if tag.start() < at:
            continue
        if not skip and tag.start() > at:
            run.append(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name not in INLINE:
            close_block()
        if tag[1]:
            here = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if here is not None:
                _, skip, main = stack[here]
                del stack[here:]
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        while name in IMPLIED and stack and stack[-1][0] in IMPLIED[name]:
            _, skip, main = stack.pop()
        stack.append((name, skip, main))
        left_out = skip or _aside(name, tag[3], main)
        if left_out != skip or (name in MAIN and not main):
            close_block()
        skip, main = left_out, main or (name in MAIN and not left_out)
    if at < len(page) and not skip:
        run.append(page[at:])
    close_block()
    return lines, zones


def shared_lines(own: list[int], other: list[int]) -> list[bool]:
    """Which of `own` lie on a longest common subsequence with `other`, by bit vectors (a row of the table is one number)."""
    shared, first, n, m = [False] * len(own), 0, len(own), len(other)
    while first < min(n, m) and own[first] == other[first]:
        shared[first] = True
        first += 1
    while n > first and m > first and own[n - 1] == other[m - 1]:
        n, m = n - 1, m - 1
        shared[n] = True
    a, b = own[first:n], other[first:m]
    if not a or not b:
        return shared
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    rows = [row]
    for x in a:
        here = row & places.get(x, 0)
        row = ((row + here) | (row - here)) & full
        rows.append(row)
    j = len(b)
    for i in range(len(a), 0, -1):
        # a zero bit at j is a step of the common length; it began in the row above if it is there too
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if not j:
            break
        if rows[i - 1] >> (j - 1) & 1:
            shared[first + i - 1] = True
            j -= 1
    return shared


def template_lines(own: list[int], zones: list[int], before: list[int] | None, after: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Which lines belong to the frame of the page's site and not to the page, as its neighbours in the order of paths tell; and which lines any neighbour shares."""
    main = np.array(zones, np.int8) == IN_MAIN
    shared = [np.array(shared_lines(own, other), bool) if other else np.zeros(len(own), bool) for other in (before, after)]
    mirrored = any(s[main].sum() >= MIRROR * main.sum() for s in shared)
    either = shared[0] | shared[1]
    return np.where(main, shared[0] & shared[1] & (not mirrored), either), either


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def _ranges(keys: DataFrame) -> list[tuple[tuple, tuple]]:
    """The first and the last key (host, path, id) of each range of pages, in their order; equal keys lie in one range."""
    spark = keys.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, *keys.columns).withColumn("part", F.spark_partition_id())
    key = F.struct(*keys.columns)
    with session_conf(spark, spark__sql__execution__rangeExchange__sampleSizePerPartition=str(RANGE_KEYS)):
        ends = dealt.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    return sorted(tuple((k[0].encode(), k[1].encode(), k[2]) for k in (r["first"], r["last"])) for r in ends)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of each row's whole html.

    Only (page_id, url, html) are read; null html counts as empty, a null url as a host of its own. Rows may repeat. The neighbours of a page are those
    before and after it among all pages of its host. The order is cut into ranges, so that a host with many pages is spread over many tasks; the hashes of the first
    and the last page of a range go to the ranges beside it too. Only hashes of the lines go to the neighbours, and the ends of the ranges to the driver.
    """
    url = F.coalesce(F.col("url"), F.concat(F.lit("//#"), F.xxhash64("page_id").cast("string")))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.select("*", _host(url).alias("_host"), F.regexp_replace(_path(url), "/+$", "").alias("_path"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("_id"))
    ends = _ranges(keyed.select("_host", "_path", "_id"))
    firsts = [first for first, _ in ends]

    def places(host: str, path: str, id_: int) -> list[tuple[int, bool]]:
        """The range of a page, and the ones beside it if it is at an end and they have its host, as a guest there."""
        key = (host.encode(), path.encode(), id_)
        at = max(bisect_right(firsts, key) - 1, 0)
        before = at > 0 and key == ends[at][0] and ends[at - 1][1][0] == key[0]
        after = at + 1 < len(ends) and key == ends[at][1] and ends[at + 1][0][0] == key[0]
        return [(at, False), *[(at - 1, True)] * before, *[(at + 1, True)] * after]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                out = []
                for text, *key in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True):
                    lines, zones = page_lines(text)
                    hashes = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in lines]
                    out.append([(None if guest else lines, None if guest else zones, hashes, at, guest) for at, guest in places(*key)])
                rows = part.take(pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out])))
                lines, zones, hashes, at, guest = zip(*(x for one in out for x in one), strict=True)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array(lines, pa.list_(pa.string())), pa.array(zones, pa.list_(pa.int8())), pa.array(hashes, pa.list_(pa.int64())),
                    rows.column(3), rows.column(4), rows.column(5), pa.array(at, pa.int32()), pa.array(guest, pa.bool_()),
                ], ["page_id", "url", "lines", "zones", "hashes", "_host", "_path", "_id", "_range", "_guest"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for lines, zones, own, before, after in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                gone, shared = template_lines(own, zones, before, after)
                has_main = IN_MAIN in zones
                kept = [t for t, z, g in zip(lines, zones, gone, strict=True) if not g and (z == IN_MAIN or not has_main)]
                texts.append(" ".join(kept))
                removed.append(int(shared.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_shared"],
            )

    cut_rows = keyed.mapInArrow(
        cut, "page_id long, url string, lines array<string>, zones array<byte>, hashes array<long>, _host string, _path string, _id long, _range int, _guest boolean"
    )
    near = Window.partitionBy("_range").orderBy("_host", "_path", "_id", "_order")
    beside = {name: F.when(f("_host").over(near) == F.col("_host"), f("hashes").over(near)) for name, f in (("before", F.lag), ("after", F.lead))}
    paired = cut_rows.withColumn("_order", F.xxhash64("hashes")).withColumns(beside).where("NOT _guest")
    return paired.select("page_id", "url", "lines", "zones", "hashes", "before", "after").mapInArrow(
        join, "page_id long, url string, text string, n_chars long, n_shared long"
    )
