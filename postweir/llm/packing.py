"""Packing of token pieces into sequences of a fixed capacity, by patterns fitted to the histogram of lengths.

Lengths are at most the capacity, so the histogram has that many bins whatever the input; the plan is made from it on the driver.
Patterns of two or three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what remains is packed best fit decreasing, still on the histogram. A piece
then finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweir.llm.tokens import encoder
from postweir.session import scratch_path

CAPACITY = 4096
#: Second lengths tried for each first length of a pattern of three.
SECOND_LENGTHS = 16
FIT_STEPS = 300

PIECES = "chunk int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of each whole text (null: empty) with `end` after it.

    `local_rank` counts the pieces of the same length in the same task (`chunk`), so the result must be written before it is used.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                ids, doc_id = words.encode(text.as_py(), end), doc_id.as_py()
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((chunk, doc_id, n, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)]))
                    seen[len(part)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["chunk", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def exact_patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none), descending, that add up to the capacity and occur in the histogram."""
    here = np.flatnonzero(counts[:capacity])
    here = here[here > 0]
    found = [np.stack([here, capacity - here, np.zeros_like(here)], 1)[2 * here >= capacity]]
    for first in here[here >= -(-capacity // 3)]:
        rest = capacity - first
        seconds = here[(here <= first) & (here < rest) & (2 * here >= rest)]
        seconds = seconds[counts[rest - seconds] > 0]
        if len(seconds) > SECOND_LENGTHS:
            seconds = seconds[np.linspace(0, len(seconds) - 1, SECOND_LENGTHS).astype(int)]
        found.append(np.stack([np.full_like(seconds, first), seconds, rest - seconds], 1))
    patterns = np.concatenate(found)
    return patterns[np.all((patterns == 0) | (counts[patterns] > 0), axis=1)]


def fit_repeats(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts with least squared error against the histogram, by multiplicative steps."""
    if not len(patterns):
        return np.zeros(0)
    wanted = counts.astype(float)
    wanted[0] = 0.0
    live = patterns > 0
    target = np.where(live, wanted[patterns], 0).sum(1)
    repeats = np.full(len(patterns), counts.sum() / (3.0 * len(patterns)) + 1e-9)
    for _ in range(FIT_STEPS):
        made = np.bincount(patterns[live], np.broadcast_to(repeats[:, None], patterns.shape)[live], len(counts))
        repeats *= target / np.maximum(np.where(live, made[patterns], 0).sum(1), 1e-12)
    return repeats


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of sequences, best fit decreasing; like sequences are handled together."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, repeats: int, lengths: tuple[int, ...]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((repeats, lengths))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left)
                put(capacity - each * length, left // each, (length,) * each)
                left %= each
                continue
            room = rooms[at]
            repeats, lengths = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // length, left)
            used = min(repeats, left // each)
            if repeats > used:
                put(room, repeats - used, lengths)
            put(room - each * length, used, lengths + (length,) * each)
            left -= used * each
    return [x for groups in open_.values() for x in groups]


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """(length, rank, sequence_id, offset) by length and rank: the pieces of that length from that rank on, up to the next row's,
    go to sequences numbered upwards from `sequence_id`, at `offset`."""
    left = counts.copy()
    left[0] = 0
    groups: list[tuple[int, tuple[int, ...]]] = []
    if left[capacity]:
        groups.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    patterns = exact_patterns(left, capacity)
    repeats = np.floor(fit_repeats(patterns, left)).astype(np.int64)
    for at in np.argsort(-repeats, kind="stable"):
        if not repeats[at]:
            break
        lengths = [int(x) for x in patterns[at] if x]
        used = min(int(repeats[at]), *(int(left[x]) // lengths.count(x) for x in lengths))
        if used:
            groups.append((used, tuple(lengths)))
            for x in lengths:
                left[x] -= used
    groups += best_fit(left, capacity)
    rank, rows, first = np.zeros(capacity + 1, np.int64), [], 0
    for used, lengths in groups:
        offset = 0
        for length in lengths:
            rows.append((length, int(rank[length]), first, offset))
            rank[length] += used
            offset += length
        first += used
    return pd.DataFrame(rows, columns=["length", "rank", "sequence_id", "offset"]).astype("int64").sort_values(["length", "rank"], ignore_index=True)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces with `sequence_id` and `offset`. The pieces may have further columns; an empty table gives no rows.

    Ranks add up the counts of each length in each task, so no length meets in one place, however common it is.
    """
    counts = np.zeros(capacity + 1, np.int64)
    by_length = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    for row in by_length:
        counts[row["length"]] = row["count"]
    plan = plan_sequences(counts, capacity)
    by_chunk = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = by_chunk.select("chunk", "length", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    ranked = pieces.join(before, ["chunk", "length"]).withColumn("_rank", F.col("_before") + F.col("local_rank"))
    span = np.int64(int(counts.max(initial=0)) + 1)
    keys = (plan["length"].to_numpy() * span + plan["rank"].to_numpy()).astype(np.int64)
    ranks, firsts, offsets = (plan[c].to_numpy() for c in ("rank", "sequence_id", "offset"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = frame["_rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, frame["length"].to_numpy(np.int64) * span + rank, "right") - 1
            frame = frame.drop(columns="_rank")
            frame["sequence_id"], frame["offset"] = firsts[at] + rank - ranks[at], offsets[at]
            yield frame

    kept = ranked.drop("_before", "local_rank", "chunk")
    schema = ", ".join([f"`{n}` {t}" for n, t in kept.drop("_rank").dtypes] + ["sequence_id long", "offset long"])
    return kept.mapInPandas(find, schema)


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all whole texts."""
    path = scratch_path(docs.sparkSession, "pieces")
    cut_pieces(docs, tokenizer, end, capacity).write.parquet(path)
    placed = place_pieces(docs.sparkSession.read.parquet(path), capacity)
    return placed.select("doc_id", "piece", "start", F.col("length"), "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for documents whose ids are unique. A sequence has at most `capacity` ids."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for doc_id, text in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                ids = words.encode(text.as_py(), end)
                parts = [ids[i : i + capacity].tolist() for i in range(0, len(ids), capacity)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_id.as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int32())),
                ], ["doc_id", "piece", "ids"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.mapInArrow(encode, "doc_id long, piece int, ids array<int>")
    parts = placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"))
