"""Benchmark items inside documents, up to a share of edits.

A walk over a text that stands still or moves on by shared random bits turns edit distance into Hamming distance: after an edit, two walks
soon run together again. Windows of an item's size are taken where a document has 14 bytes of it, walked with the item's bits, and compared
with the walked item at sampled steps; a window that agrees in all samples of any of several tables is a candidate, whose edit
distance is then computed exactly. An exact copy always agrees. Items are read in blocks of bounded size, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweir.llm.buffers import BASE, BYTE_CODES, kept_columns, mix, slices, text_bytes, unkept_columns
from postweir.session import bound_batches

SEED_BYTES = 14
#: Edits allowed, as a share of the item's length; items shorter than LEAST_BYTES say too little and are left out.
EDIT_SHARE, LEAST_BYTES = 0.1, 32
#: Walks, tables for each walk, and samples for each table.
WALKS, TABLES, SAMPLES = 2, 40, 3
#: Starts of windows of the same item closer than this are one window.
START_STEP = 16
BLOCK_BYTES = 1 << 22
#: Bytes of texts searched and hashed at once, and windows walked at once; they bound a task's memory, not what is found.
SEARCHED, SEED_SLICE, WALKED = 1 << 21, 1 << 18, 1 << 12

LEAKS = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


def normalize(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case (ASCII and Latin-1) with one space for each run of white space: bytes, bounds, and each byte's place before."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    if len(data):
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low = np.where(latin, low + np.uint8(32), low)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    low = np.where(space, np.uint8(32), low)
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    keep = ~space
    if len(data):
        keep[1:] |= space[1:] & ~space[:-1]
        keep |= first[:-1] & space
    kept = np.flatnonzero(keep)
    return low[kept], np.searchsorted(kept, bounds), kept


def seeds(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED_BYTES bytes from each place on (the last places have none)."""
    out = np.zeros(max(len(data) - SEED_BYTES + 1, 0), np.uint64)
    value, size, done = BYTE_CODES[data], 1, 0
    while done < SEED_BYTES:
        power = np.uint64(pow(int(BASE), size, 1 << 64))
        if SEED_BYTES & size:  # the bits of the length say which runs of 1, 2, 4, ... bytes make it up
            out = out * power + value[done : done + len(out)]
            done += size
        if 2 * size > SEED_BYTES:
            break
        value = value[:-size] * power + value[size:]
        size *= 2
    return mix(out)


class Items:
    """A block of items: their bytes, the places of all seeds, and their walked samples."""

    def __init__(self, ids: list[int], texts: list[str]):
        rng = np.random.default_rng(77)
        found = []
        for item, text in zip(ids, texts, strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            flat = normalize(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if len(flat) >= LEAST_BYTES:
                found.append((item, flat))
        self.ids = [x[0] for x in found]
        self.texts = [x[1] for x in found]
        self.lengths = np.array([len(x) for x in self.texts], np.int64)
        hashes = [seeds(np.frombuffer(t, np.uint8)) for t in self.texts]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        offset = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.seed_items, self.seed_offsets = flat[order], item[order], offset[order]
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        longest = int(self.lengths.max(initial=1))
        self.moves = rng.integers(0, 2, (WALKS, 2 * longest + 1, 256), dtype=np.int64).astype(np.int8)
        # sampled steps as shares of an item's walk, so that items of all lengths use them
        self.steps = rng.random((WALKS, TABLES, SAMPLES))
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        starts = np.cumsum(self.lengths) - self.lengths
        self.codes = self.walk(data, starts, np.arange(len(self.ids)))

    def walk(self, data: np.ndarray, starts: np.ndarray, item: np.ndarray) -> np.ndarray:
        """(windows, WALKS * TABLES): a hash of the bytes at the sampled steps of each table, for windows as long as their items."""
        order = np.argsort(self.lengths[item], kind="stable")[::-1]
        starts, item = starts[order], item[order]
        lengths = self.lengths[item]
        codes = np.zeros((len(item), WALKS * TABLES), np.uint64)
        for w in range(WALKS):
            steps = (self.steps[w].reshape(-1)[None, :] * (1.6 * lengths)[:, None]).astype(np.int64)
            seen = np.zeros((len(item), TABLES * SAMPLES), np.uint8)
            last = int(steps.max(initial=-1)) + 1
            at = np.zeros(len(item), np.int64)
            rows, columns = np.nonzero(steps >= 0)
            by_step = np.argsort(steps[rows, columns], kind="stable")
            rows, columns = rows[by_step], columns[by_step]
            cuts = np.searchsorted(steps[rows, columns], np.arange(last + 1))
            for j in range(last):
                here = at < lengths
                byte = np.where(here, data[np.minimum(starts + np.minimum(at, lengths - 1), len(data) - 1)], 0)
                a, b = cuts[j], cuts[j + 1]
                seen[rows[a:b], columns[a:b]] = byte[rows[a:b]]
                at += self.moves[w, j][byte] & here
            tables = BYTE_CODES[seen].reshape(len(item), TABLES, SAMPLES)
            total = np.zeros((len(item), TABLES), np.uint64)
            for s in range(SAMPLES):
                total = mix(total * BASE + tables[:, :, s])
            codes[:, w * TABLES : (w + 1) * TABLES] = total
        back = np.empty_like(codes)
        back[order] = codes
        return back

    def windows(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, start, item) of the windows to walk."""
        found = []
        for i in range(0, len(data), SEED_SLICE):
            hashes = seeds(data[i : i + SEED_SLICE + SEED_BYTES - 1])
            place = np.flatnonzero(self.gate[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            first = np.searchsorted(self.seeds, hashes[place])
            count = np.searchsorted(self.seeds, hashes[place], "right") - first
            some = count > 0
            found.append((place[some] + i, first[some], count[some]))
        place, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(place, count)
        owner = np.searchsorted(bounds, place, "right") - 1
        inside = place + SEED_BYTES <= bounds[owner + 1]
        owner, at, place = owner[inside], at[inside], place[inside]
        item = self.seed_items[at]
        room = bounds[owner + 1] - bounds[owner]
        start = place - self.seed_offsets[at] - bounds[owner]
        start = np.clip(start, 0, np.maximum(room - self.lengths[item], 0)) + bounds[owner]
        fits = room >= self.lengths[item] * (1 - EDIT_SHARE)
        key = np.stack([owner[fits], item[fits], start[fits] // START_STEP, start[fits]])
        key = key[:, np.lexsort(key[::-1])]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:3, 1:] != key[:3, :-1]).any(0)
        return key[0, new], key[3, new], key[1, new]

    def find(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(owner, item, start, end, edits) of the best match of each item in each text."""
        if not self.ids or not len(data):
            return []
        owner, start, item = self.windows(data, bounds)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in range(0, len(owner), WALKED):
            part = slice(i, i + WALKED)
            likely = np.flatnonzero((self.walk(data, start[part], item[part]) == self.codes[item[part]]).any(1)) + i
            for w in likely.tolist():
                d, k = int(owner[w]), int(item[w])
                allowed = int(EDIT_SHARE * self.lengths[k])
                known = best.get((d, k))
                if known and known[2] == 0:
                    continue
                low = max(int(start[w]) - allowed, int(bounds[d]))
                high = min(int(start[w] + self.lengths[k]) + allowed, int(bounds[d + 1]))
                found = best_match(self.texts[k], data[low:high].tobytes(), allowed)
                if found and (known is None or found[2] < known[2]):
                    best[d, k] = (low + found[0], low + found[1], found[2])
        return [(d, k, *m) for (d, k), m in sorted(best.items())]


def best_match(pattern: bytes, text: bytes, allowed: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the part of a text with the least edit distance from the pattern, if that is allowed; the first such end."""
    exact = text.find(pattern)
    if exact >= 0:
        return exact, exact + len(pattern), 0
    distances = _distances(pattern, text, True)
    edits = min(distances)
    if edits > allowed:
        return None
    end = distances.index(edits)
    back = _distances(pattern[::-1], text[:end][::-1], False)
    return end - back.index(min(back)), end, edits


def _distances(pattern: bytes, text: bytes, free: bool) -> list[int]:
    """Edit distance of the pattern from the text up to each place, from its beginning or (free) from anywhere; a column is one number."""
    n = len(pattern)
    if not n:
        return [0] * (len(text) + 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    out = [n]
    for c in text:
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        out.append(score)
        right_up = right_up << 1 | (0 if free else 1)
        right_down <<= 1
        up = (right_down | (full & ~(diagonal | right_up))) & full
        down = right_up & diagonal & full
    return out


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """Items by id, in blocks of at most BLOCK_BYTES of text (or one longer item). Null texts and ids are left out."""
    ids, texts, size = [], [], 0
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        if texts and size + len(text) > BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text)
    if texts:
        yield Items(ids, texts)


def find_leaks(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of each row and `leaks`: (item_id, start, end, edits) of each benchmark item found in its whole text.

    start and end count code points. A null or empty text has no leaks; without items no row has any. Rows may repeat, each has its own list; a column
    `leaks` of `docs` is replaced. Of equally good matches of an item the first counts. Each block of items is one more pass over the
    rows in the same tasks; nothing is shuffled.
    """
    keep = [c for c in keep or docs.columns if c != "leaks"]
    rows = docs.select("text", kept_columns(keep), F.array().cast(LEAKS).alias("leaks"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    spark = docs.sparkSession
    bound_batches(spark)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text and its index

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                data, bounds = text_bytes(batch.column(0).fill_null(""))
                before = batch.column(batch.num_columns - 1)
                for i, j in slices(bounds, SEARCHED):
                    raw, cuts = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                    flat, flat_cuts, places = normalize(raw, cuts)
                    found = block.find(flat, flat_cuts)
                    leaks = before.slice(i, j - i)
                    if found:
                        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        lists = leaks.to_pylist()
                        for d, k, start, end, edits in found:
                            first, last = places[start], places[end - 1] + 1
                            lists[d] = [*lists[d], {
                                "item_id": block.ids[k], "start": int(points[first] - points[cuts[d]]),
                                "end": int(points[last] - points[cuts[d]]), "edits": edits,
                            }]
                        leaks = pa.array(lists, kind)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)), leaks.cast(kind)], batch.schema.names
                    )

        rows = rows.mapInArrow(search, rows.schema)
    return rows.select(*unkept_columns(keep), "leaks")
