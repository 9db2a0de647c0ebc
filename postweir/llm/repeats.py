"""Removal of byte strings of a given length that occur more than once anywhere, by a sparse enhanced suffix array.

Of each string of LENGTH bytes the SEED-byte string with the least hash is its anchor, so equal strings have equal anchors, and only the suffixes
that begin at anchors need to be sorted. Anchors are grouped by their seed. Those whose whole surroundings are equal form a class: of
two or more, all strings about them repeat. Classes of a seed are put in the order of their suffixes; a scan with a stack over the common prefixes of
neighbours gives the tree of prefix intervals. Within an interval the members are put in the order of what lies before them: where it differs, the
interval's string can't be extended to the left for all of them, and neighbours in that order tell how far each member shares it with another one.
Left and right extents that add up to LENGTH are repeats, with all their occurrences. As all of them hold the anchor, the bytes that the repeats
about an anchor cover are one run, from the furthest left extent to the furthest right one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweir.llm.buffers import BASE, BYTE_CODES, mix, text_bytes
from postweir.llm.partenum import release
from postweir.session import remove_path, scratch_path

LENGTH, SEED = 200, 32
#: Bytes before an anchor that a string with this anchor may have.
BEFORE = LENGTH - SEED
#: Classes of one seed that are sorted in one task. Those of more common seeds compare all their strings about the anchor by hash instead, over all tasks.
LARGEST = 20_000
#: Bytes handled at once; longer texts are handled in pieces that overlap by LENGTH - 1.
PIECE = 1 << 21


def seed_hashes(data: np.ndarray) -> np.ndarray:
    value, size = BYTE_CODES[data], 1
    while size < SEED:
        value = value[:-size] * np.uint64(pow(int(BASE), size, 1 << 64)) + value[size:]
        size *= 2
    return mix(value)


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed hash) of the anchors of all strings of LENGTH bytes that lie in one text."""
    window = LENGTH - SEED + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = seed_hashes(data)
    low = np.uint64((1 << 24) - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the first
    blocks = -(-len(ranked) // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    square = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(len(data) - LENGTH + 1)
    least = np.minimum(behind[starts], ahead[starts + window - 1])
    owner = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + LENGTH <= bounds[owner + 1]
    found = np.unique((least[inside] & low).astype(np.int64))
    return found, hashes[found]


def _pieces(bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, from byte, to byte): runs of texts, or overlapping pieces of a long one."""
    i, n = 0, len(bounds) - 1
    while i < n:
        if bounds[i + 1] - bounds[i] > PIECE:
            for at in range(int(bounds[i]), int(bounds[i + 1]), PIECE):
                yield i, i + 1, at, min(at + PIECE + LENGTH - 1, int(bounds[i + 1]))
            i += 1
            continue
        j = min(max(int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1, i + 1), n)
        yield i, j, int(bounds[i]), int(bounds[j])
        i = j


def _anchored(docs: DataFrame) -> DataFrame:
    """(doc_id, code, place, seed, context) of all anchors; context is a hash of the bytes about the anchor and of how many lie before it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            for i, j, start, end in _pieces(bounds):
                part = data[start:end]
                cuts = np.clip(bounds[i : j + 1] - start, 0, end - start)
                place, seed = anchors(part, cuts)
                place += start
                owner = np.searchsorted(bounds, place, "right") - 1
                left, right = np.maximum(place - BEFORE, bounds[owner]), np.minimum(place + LENGTH, bounds[owner + 1])
                first = int(left.min(initial=start))
                raw = data[first : int(right.max(initial=first))].tobytes()
                context = [digest(raw[a:b], c) for a, b, c in zip((left - first).tolist(), (right - first).tolist(), (place - left).tolist(), strict=True)]
                owners = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(owners), batch.column(1).take(owners), pa.array((place - bounds[owner]).astype(np.int64)),
                    pa.array(seed.view(np.int64)), pa.array(np.array(context, np.uint64).view(np.int64)),
                ], ["doc_id", "code", "place", "seed", "context"])

    return _texts(docs).mapInArrow(cut, "doc_id long, code long, place long, seed long, context long")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("code"), text.alias("text"))


def _with_text(docs: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """Texts with the columns of a table that is unique by (doc_id, code)."""
    named = small.withColumnsRenamed({"doc_id": "_d", "code": "_c"})
    texts = _texts(docs)
    return texts.join(named, (texts["code"] == named["_c"]) & texts["doc_id"].eqNullSafe(named["_d"]), how).drop("_d", "_c")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seed, context, classes, left, right) of the anchors in `wanted`, one of each class; `left` is reversed.

    Rows that repeat a text give a class twice. Such a class has two members and is a repeat in any case.
    """
    by_text = wanted.groupBy("doc_id", "code").agg(F.collect_list(F.struct("place", "seed", "context", "classes")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                rows = []
                for text, at in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    raw = text.as_py().encode()
                    for x in at:
                        p = x["place"]
                        rows.append((x["seed"], x["context"], x["classes"], raw[max(p - BEFORE, 0) : p][::-1], raw[p : p + LENGTH]))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seed", "context", "classes", "left", "right"])

    return _with_text(docs, by_text, "inner").select("text", "at").mapInArrow(cut, "seed long, context long, classes long, left binary, right binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the nodes of the tree of common prefixes; lcp[i] is that of the suffixes i - 1 and i (lcp[0]: any)."""
    stack: list[tuple[int, int]] = []  # first suffix, depth
    n = len(lcp)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, top = stack.pop()
            yield first, i - 1, top
        if depth and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def repeated_extents(lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int] | None]:
    """For each member (in the order of its right side) how far the strings of LENGTH bytes or more that it shares reach (before, after its anchor)."""
    n = len(rights)
    lcp = [0] + [common(rights[i - 1], rights[i]) for i in range(1, n)]
    found: list[tuple[int, int] | None] = [None] * n
    for first, last, depth in prefix_intervals(lcp):
        if depth < SEED:
            continue
        order = sorted(range(first, last + 1), key=lefts.__getitem__)
        shared = [common(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)]
        for k, member in enumerate(order):
            before = max(shared[k - 1] if k else 0, shared[k] if k < len(shared) else 0)
            if before + depth >= LENGTH:
                known = found[member] or (0, 0)
                found[member] = max(known[0], before), max(known[1], depth)
    return found


def _sorted_extents(classes: DataFrame) -> DataFrame:
    """(seed, context, before, after) for classes of seeds with at most LARGEST classes."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != seed:
                    out += _extents_of(seed, group)
                    seed, group = row[0], []
                group.append(row[1:])
            yield _extent_batch(out)
        yield _extent_batch(_extents_of(seed, group))

    dealt = classes.select("seed", "context", "left", "right").repartition("seed").sortWithinPartitions("seed", "right")
    return dealt.mapInArrow(scan, "seed long, context long, before long, after long")


def _extents_of(seed: int | None, group: list[tuple]) -> list[tuple]:
    found = repeated_extents([g[1] for g in group], [g[2] for g in group])
    return [(seed, g[0], *extent) for g, extent in zip(group, found, strict=True) if extent]


def _extent_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seed", "context", "before", "after"])


def _hashed_extents(classes: DataFrame) -> DataFrame:
    """The same for classes of common seeds: every string of LENGTH bytes about the anchor is counted by hash."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                seeds, contexts, befores, codes = [], [], [], []
                for seed, context, left, right in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    whole, at = left[::-1] + right, len(left)
                    for start in range(len(whole) - LENGTH + 1):
                        codes.append(xxhash.xxh64_intdigest(whole[start : start + LENGTH]))
                        befores.append(at - start)
                    seeds += [seed] * (len(befores) - len(seeds))
                    contexts += [context] * (len(befores) - len(contexts))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in (seeds, contexts, befores)), pa.array(np.array(codes, np.uint64).view(np.int64))],
                    ["seed", "context", "before", "string"],
                )

    strings = classes.select("seed", "context", "left", "right").mapInArrow(cut, "seed long, context long, before long, string long")
    # equal strings have the seed at the same place; a string that holds it twice is still one
    same = ["seed", "before", "string"]
    hits = strings.join(strings.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*same), same, "left_semi")
    return hits.select("seed", "context", "before", (LENGTH - F.col("before")).alias("after"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, spans) of each row's whole text as UTF-8 bytes (null: empty).

    Every byte that a string of LENGTH bytes covers which also begins elsewhere, in any row or in the same one, is removed; `spans` are the runs
    removed (start, end), `kept` the other bytes. Rows that repeat are occurrences of their own. Texts shorter than LENGTH stay as they are.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "repeats")
    _anchored(docs).write.parquet(f"{root}/anchors")
    found = spark.read.parquet(f"{root}/anchors")
    classes = found.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("size"))
    classes = classes.withColumn("classes", F.count(F.lit(1)).over(Window.partitionBy("seed"))).where("size > 1 OR classes > 1")
    classes.write.parquet(f"{root}/classes")
    release(spark)
    found.join(spark.read.parquet(f"{root}/classes"), ["seed", "context"]).write.parquet(f"{root}/hits")
    remove_path(spark, f"{root}/anchors")
    release(spark)

    hits = spark.read.parquet(f"{root}/hits")
    one_each = hits.where("classes > 1").groupBy("seed", "context").agg(F.min(F.struct("doc_id", "code", "place")).alias("one"), F.first("classes").alias("classes"))
    _contexts(docs, one_each.select("seed", "context", "classes", "one.*")).write.option("compression", "zstd").parquet(f"{root}/contexts")
    release(spark)
    contexts = spark.read.parquet(f"{root}/contexts")
    extents = _sorted_extents(contexts.where(F.col("classes") <= LARGEST)).unionByName(_hashed_extents(contexts.where(F.col("classes") > LARGEST)))
    whole = spark.read.parquet(f"{root}/classes").where("size > 1")
    whole = whole.select("seed", "context", F.lit(BEFORE).cast("bigint").alias("before"), F.lit(LENGTH).cast("bigint").alias("after"))
    extents = extents.unionByName(whole).groupBy("seed", "context").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    extents.write.parquet(f"{root}/extents")
    remove_path(spark, f"{root}/contexts")
    release(spark)
    spans = hits.join(spark.read.parquet(f"{root}/extents"), ["seed", "context"]).groupBy("doc_id", "code").agg(
        F.collect_set(F.struct((F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("end"))).alias("at")
    )
    spans.write.parquet(f"{root}/spans")
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                kept, runs = [], []
                sides = part.column(2).flatten()
                starts, ends_of = sides.field(0).to_numpy(zero_copy_only=False), sides.field(1).to_numpy(zero_copy_only=False)
                last = np.cumsum([n or 0 for n in part.column(2).value_lengths().to_pylist()]).tolist()
                for text, a, b in zip(part.column(1), [0, *last], last, strict=False):
                    raw = text.as_py().encode()
                    runs.append(covered(starts[a:b], ends_of[a:b], len(raw)))
                    ends = [0, *(e for _, e in runs[-1])]
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in runs[-1]), len(raw)], strict=True)))
                sizes = [sum(e - s for s, e in r) for r in runs]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(k) + s for k, s in zip(kept, sizes, strict=True)], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([len(r) for r in runs], pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], kind),
                ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    rows = _with_text(docs, spark.read.parquet(f"{root}/spans"), "left")
    return rows.select("doc_id", "text", "at").mapInArrow(cut, schema)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the intervals cover, within a text of this size."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(np.maximum(starts, 0).tolist(), np.minimum(ends, size).tolist(), strict=True)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out
