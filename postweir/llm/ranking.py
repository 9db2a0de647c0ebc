"""Ranked lexical search over K2-treaps: compressed quadtrees on the term-document grid whose cells hold the largest impact below them.

The index is a table of segments, each of some thousands of documents. A segment's grid has a row for each of its terms, frequent ones first, and a column for each
document; its entries are impacts, the part of a score that does not depend on the query. A cell of level j covers 2**j rows and 2**j columns; only cells that
hold an entry are kept, sorted by row and column, with the largest impact in them. From a level to the next, cells grow FAN times in both directions.

A query is a set of rows. Its terms' paths through the levels are descended jointly, best first: a range of documents is bounded by the sum of weight times
the largest impact of the cell of each term, and ranges that cannot reach the best scores found so far are never opened. Ranges of one
document are exact. Each task keeps the best documents of each item over all its segments; Spark ranks those of all tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweir.session import remove_path, scratch_path

#: A segment is closed once it has so many documents or entries; a file holds so many segments.
SEGMENT_DOCS, SEGMENT_ENTRIES, FILE_SEGMENTS = 2048, 1 << 19, 2
#: Rows and columns of a cell that form one of the next level, as a power of two.
FAN_BITS = 2
#: Ranges opened at once, and terms of the items searched in one job.
OPENED, ITEM_TERMS = 256, 50_000
LIMIT = 50

#: What each byte of UTF-8 counts as: figures, letters and all of non-ASCII characters themselves, A-Z in lower case, the rest a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))

#: Stands for a null doc_id, after all others.
_LAST = -(1 << 64)

_POSTINGS = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms binary, dfs binary, rows binary, cols binary, tfs binary"
_TREAP = "doc_ids array<long>, terms binary, row_bits int, col_bits int, levels array<struct<level:int,keys:binary,peaks:binary>>"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split() if text else []


class _Postings:
    """Documents of a segment that is still open."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.sizes: list[int] = []
        self.place: dict[bytes, int] = {}
        self.rows: list[int] = []
        self.tfs: list[int] = []

    def add(self, doc: int | None, terms: list[bytes]) -> None:
        counts, place = Counter(terms), self.place
        self.docs.append(doc)
        self.lengths.append(len(terms))
        self.sizes.append(len(counts))
        self.rows += [place.setdefault(t, len(place)) for t in counts]
        self.tfs += counts.values()

    def full(self) -> bool:
        return len(self.docs) >= SEGMENT_DOCS or len(self.rows) >= SEGMENT_ENTRIES

    def record(self) -> pa.RecordBatch:
        rows = np.array(self.rows, np.int64)
        dfs = np.bincount(rows, minlength=len(self.place))
        order = np.argsort(-dfs, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cols = np.repeat(np.arange(len(self.docs)), self.sizes)
        keys = rank[rows] * len(self.docs) + cols
        by = np.argsort(keys)
        terms = list(self.place)
        columns = [
            pa.array([len(self.docs)], pa.int64()), pa.array([sum(self.lengths)], pa.int64()), pa.array([self.docs], pa.list_(pa.int64())), pa.array([self.lengths], pa.list_(pa.int64())),
            pa.array([b" ".join([terms[i] for i in order.tolist()])], pa.binary()), pa.array([dfs[order].astype(np.int32).tobytes()], pa.binary()),
            pa.array([rank[rows][by].astype(np.int32).tobytes()], pa.binary()), pa.array([cols[by].astype(np.int32).tobytes()], pa.binary()),
            pa.array([np.array(self.tfs, np.int64)[by].tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _POSTINGS.split(", ")])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = _Postings()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            terms = terms_of(text.as_py())
            if terms:
                segment.add(doc, terms)
                if segment.full():
                    yield segment.record()
                    segment = _Postings()
    if segment.docs:
        yield segment.record()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, dfs in zip(batch.column(0), batch.column(1), strict=True):
            counts = np.frombuffer(dfs.as_py(), np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms.as_py().split(b" "), pa.binary()), pa.array(counts)], ["term", "df"])


def impacts(tfs: np.ndarray, lengths: np.ndarray, cols: np.ndarray, n: int, total: int) -> np.ndarray:
    """The part of a score that a term's weight multiplies: of entries with `tfs` occurrences in the documents `cols`, of `lengths` terms each, among n documents with `total` terms."""
    m = 100 - 50 + np.array([(50 * x * n) // total for x in lengths.tolist()], np.int64)
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[cols])


def levels_of(rows: np.ndarray, cols: np.ndarray, peaks: np.ndarray, col_bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(level, keys, peaks) from the entries, sorted by row and column, up to the level whose cells hold all columns. A key is row block and column block."""
    found, level = [], 0
    while True:
        bits = max(col_bits - level, 0)
        keys = ((rows >> level) << bits) | (cols >> level)
        if level:
            order = np.argsort(keys, kind="stable")
            keys, peaks = keys[order], peaks[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, peaks = keys[first], np.maximum.reduceat(peaks, first)
            rows, cols = (keys >> bits) << level, (keys & ((1 << bits) - 1)) << level
        found.append((level, keys, peaks))
        if bits == 0:
            return found
        level += FAN_BITS


def _treaps(n: int, total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, terms, dfs, rows, cols, tfs in zip(*batch.columns, strict=True):
                row, col = (np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in (rows, cols))
                lengths = lengths.values.to_numpy()
                peaks = impacts(np.frombuffer(tfs.as_py(), np.int64), lengths, col, n, total)
                row_bits, col_bits = max(len(dfs.as_py()) // 4 - 1, 1).bit_length(), max(len(lengths) - 1, 1).bit_length()
                kept = [
                    {"level": level, "keys": np.diff(keys, prepend=0).astype(np.uint32 if row_bits + col_bits <= 32 else np.uint64).tobytes(), "peaks": top.astype(np.int32).tobytes()}
                    for level, keys, top in levels_of(row, col, peaks, col_bits)
                ]
                kind = pa.list_(pa.struct([("level", pa.int32()), ("keys", pa.binary()), ("peaks", pa.binary())]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_ids.as_py()], pa.list_(pa.int64())), pa.array([terms.as_py()], pa.binary()), pa.array([row_bits], pa.int32()), pa.array([col_bits], pa.int32()), pa.array([kept], kind),
                ], [c.split()[0] for c in ("doc_ids", "terms", "row_bits", "col_bits", "levels")])

    return build


def build_index(docs: DataFrame, path: str) -> None:
    """Write the index of all rows of `docs` (doc_id, text): `path`/treaps (segments), `path`/vocabulary (term, df), `path`/totals (n, total).

    Every whole text counts; rows without a term (null, empty, blank) are not documents of it, rows that share an id are documents of their own. Postings
    are staged until the totals are known, which the impacts depend on, and removed.
    """
    spark = docs.sparkSession
    staged = scratch_path(spark, "postings")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows.mapInArrow(_post, _POSTINGS).write.option("compression", "zstd").option("maxRecordsPerFile", FILE_SEGMENTS).parquet(staged)
    postings = spark.read.parquet(staged)
    postings.select("terms", "dfs").mapInArrow(_vocabulary, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/vocabulary")
    postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals").first()
    made = postings.select("doc_ids", "lengths", "terms", "dfs", "rows", "cols", "tfs").mapInArrow(_treaps(totals["n"], totals["total"]), _TREAP)
    made.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_SEGMENTS).parquet(f"{path}/treaps")
    remove_path(spark, staged)


class _Treap:
    """A segment in memory, with the paths of the rows that any item asks for."""

    def __init__(self, doc_ids: list[int | None], terms: bytes, col_bits: int, row_bits: int, levels: list[dict], wanted: set[bytes]):
        self.doc_ids, self.col_bits = doc_ids, col_bits
        self.row = {t: i for i, t in enumerate(terms.split(b" ")) if t in wanted}
        self.levels = []
        kind = np.uint32 if row_bits + col_bits <= 32 else np.uint64
        for x in levels:
            bits = max(col_bits - x["level"], 0)
            keys = np.cumsum(np.frombuffer(x["keys"], kind).astype(np.int64))
            self.levels.append((x["level"], bits, keys, np.frombuffer(x["peaks"], np.int32)))
        self.paths: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def path(self, row: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(column blocks, peaks) of the cells along a row, level by level."""
        if row not in self.paths:
            found = []
            for level, bits, keys, peaks in self.levels:
                block = row >> level
                first, last = np.searchsorted(keys, (block << bits, (block + 1) << bits))
                found.append((keys[first:last] - (block << bits), peaks[first:last]))
            self.paths[row] = found
        return self.paths[row]

    def search(self, item: list[tuple[bytes, int]], best: list[tuple[int, int]], limit: int) -> None:
        """Put documents of the segment among the best ones: a heap of (score, -doc_id, or _LAST for a null one)."""
        known = [(self.path(self.row[t]), w) for t, w in item if w and t in self.row]
        if not known:
            return
        weights = np.array([w for _, w in known], np.int64)
        grids: dict[int, np.ndarray] = {}

        def grid(at: int) -> np.ndarray:
            if at not in grids:
                grids[at] = dense = np.zeros((len(known), 1 << self.levels[at][1]), np.int64)
                for line, (path, _) in zip(dense, known, strict=True):
                    line[path[at][0]] = path[at][1]
            return grids[at]

        top = len(self.levels) - 1
        frontier = [(-int(weights @ grid(top)[:, 0]), top, 0)]
        width = np.arange(1 << FAN_BITS)
        while frontier and (len(best) < limit or -frontier[0][0] >= best[0][0]):
            opened: dict[int, list[int]] = {}
            for _ in range(OPENED):
                if not frontier or (len(best) == limit and -frontier[0][0] < best[0][0]):
                    break
                _, at, block = heapq.heappop(frontier)
                opened.setdefault(at, []).append(block)
            for at, blocks in opened.items():
                step = self.levels[at - 1][1] - self.levels[at][1] if at else 0
                below = ((np.array(blocks)[:, None] << step) + width[: 1 << step]).ravel() if at else np.array(blocks)
                bounds = weights @ grid(max(at - 1, 0))[:, below]
                floor = best[0][0] if len(best) == limit else 1
                for k in np.flatnonzero(bounds >= max(floor, 1)).tolist():
                    bound, block = int(bounds[k]), int(below[k])
                    if at > 1:
                        heapq.heappush(frontier, (-bound, at - 1, block))
                    else:
                        doc = self.doc_ids[block]
                        entry = (bound, _LAST if doc is None else -doc)
                        if len(best) < limit:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)


def _searcher(items: list[list[tuple[bytes, int]]], limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t for item in items for t, _ in item}
        best: list[list] = [[] for _ in items]
        for batch in batches:
            for doc_ids, terms, row_bits, col_bits, levels in zip(*batch.columns, strict=True):
                treap = _Treap(doc_ids.as_py(), terms.as_py(), col_bits.as_py(), row_bits.as_py(), levels.as_py(), wanted)
                for item, heap in zip(items, best, strict=True):
                    treap.search(item, heap, limit)
        flat = [(i, score, None if key == _LAST else -key) for i, heap in enumerate(best) for score, key in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)] if flat else [pa.array([], pa.int64())] * 3, ["item", "score", "doc_id"])

    return search


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items (item_id, text) with their distinct terms, some thousand terms at a time."""
    held: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator():
        terms = list(dict.fromkeys(terms_of(row["text"])))
        if held and size + len(terms) > ITEM_TERMS:
            yield held
            held, size = [], 0
        held.append((row["item_id"], terms))
        size += len(terms)
    if held:
        yield held


def weight_of(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(spark: SparkSession, path: str, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_id, rank, doc_id, score): the `limit` best documents of the index for each row of `items` (item_id, text), those with a score above 0.

    Equal scores rank by ascending doc_id, null last; of documents that also share the id any order, as their rows are alike. Items are taken in blocks of ITEM_TERMS terms (a larger one alone): their weights, from
    the vocabulary, go to every task, and each block is searched in all segments. Items without a known term have no rows; rows that share an item_id are items of their own.
    """
    out = scratch_path(spark, "ranked")
    totals = spark.read.parquet(f"{path}/totals").first()
    vocabulary, treaps = spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/treaps")
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    empty.write.parquet(out)
    for block in _blocks(items):
        asked = spark.createDataFrame([(bytearray(t),) for t in sorted({t for _, terms in block for t in terms})], "term binary")
        dfs = {bytes(r["term"]): r["df"] for r in vocabulary.join(asked, "term").collect()}
        weighted = [[(t, weight_of(dfs[t], totals["n"])) for t in terms if t in dfs] for _, terms in block]
        found = treaps.mapInArrow(_searcher(weighted, limit), "item long, score long, doc_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id long")
        ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
    return spark.read.parquet(out)
