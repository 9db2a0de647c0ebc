"""Exact Jaccard join of sets of word shingles by partition signatures.

Two sets x and y with Jaccard similarity of at least s differ in at most (1 - s) / (1 + s) * (|x| + |y|) elements, and their sizes in the ratio s at most. For
each band of sizes the domain is dealt by a hash into numbered parts. A set's content of a part is a token; tokens are ordered by how common their
rarest element is, rare ones first, then by the number of their elements, largest first, then by a hash. As similar sets differ in no more tokens than elements, each
one's first k + 1 tokens, with k the most elements in which a partner can differ, hold a common one: their signature. This holds for any order that depends on the tokens
alone; that of rare ones first keeps a line that many texts have from making all of them candidates. Sets at the edge of a band take part in the next one too.

Sets that share a signature are candidates. The parity of the number of elements in each cell of a bitmap bounds the difference from below and rules
out most of them; the others are compared exactly. First only a forest of candidates is compared, then, inside the tasks, the sets of
each signature that this left apart; only proven links leave a task, fewer than there are sets.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweir.llm.buffers import gram_hashes, lower_ascii, mix, slices, text_bytes, word_hashes, words
from postweir.session import bound_batches, remove_path, scratch_path

SHINGLE = 5
#: Similarity as a percentage, so that all bounds are whole numbers.
PERCENT = 75
#: In bands that begin up to this size each element is a part of its own.
ELEMENT_PARTS = 48
#: Parts of a band, as a multiple of its least size; enough for more tokens than differences (else the signatures are made anew with other hashes).
PARTS = 1.5
#: Members of a signature that are compared in one task; larger ones are dealt into pairs of blocks.
BLOCK = 1500
#: Shingles that a task counts together, and how often one must come among them to be counted on.
CHUNK, REPEATED = 1 << 22, 3
#: The ranks of common shingles lie in a table of 2 ** RANK_BITS cells, by their first bits; a rank goes from 0 (rare) to LAST_RANK.
RANK_BITS, LAST_RANK = 22, 15

_GOLDEN = 0x9E3779B97F4A7C15


@cache
def _seed(*numbers: int) -> np.uint64:
    value = 1
    for n in numbers:
        value = (value * 0xD1342543DE82EF95 + n + 1) * _GOLDEN % (1 << 64)
    return np.uint64(value)


def most_differences(size: int) -> int:
    """Elements in which a similar set can differ: its size is at most size * 100 / PERCENT."""
    return (100 - PERCENT) * (size + size * 100 // PERCENT) // (100 + PERCENT)


def band_of(size: int) -> int:
    """Sizes 2 ** band up to 2 ** (band + 1) - 1."""
    return size.bit_length() - 1


def bands(size: int) -> list[int]:
    """The bands a set takes part in: its own, and the one below if a similar set may lie there."""
    own = band_of(size)
    least = -(-size * PERCENT // 100)
    return [own] if least >= 1 << own else [own - 1, own]


def cells(size: int) -> int:
    """Cells of the bitmaps in the band of a size: a power of two."""
    return max(64, 1 << (most_differences(1 << band_of(size)) * 8).bit_length())


def signatures(elements: np.ndarray, round_: int = 0, ranks: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Signatures of a set (distinct 64-bit elements), and whether a band gave it too few tokens for them to be sure. `ranks` is a table of common_ranks."""
    size, found, short = len(elements), [], False
    k = most_differences(size)
    last = np.uint64(LAST_RANK)
    rank = np.uint64(0) if ranks is None else ranks[elements >> np.uint64(64 - RANK_BITS)].astype(np.uint64)
    for band in bands(size):
        # an element is 60 bits of a hash and its rank; the hash's first bits are its part
        marks = mix(elements ^ _seed(round_, band, 1)) & ~last | rank
        marks.sort()
        if (1 << band) <= ELEMENT_PARTS:
            tokens = (marks & last) << np.uint64(60) | mix(marks) >> np.uint64(8)
        else:
            parts = (marks >> np.uint64(32)) * np.uint64(int(PARTS * (1 << band))) >> np.uint64(32)
            new = np.empty(size + 1, bool)
            new[0] = new[-1] = True
            np.not_equal(parts[1:], parts[:-1], out=new[1:-1])
            first = np.flatnonzero(new)
            counts, first = first[1:] - first[:-1], first[:-1]
            least = np.minimum.reduceat(marks & last, first)
            tokens = least << np.uint64(60) | np.maximum(15 - counts, 0).astype(np.uint64) << np.uint64(56) | mix(np.add.reduceat(marks, first)) >> np.uint64(8)
        tokens.sort()
        short |= len(tokens) <= k
        found.append(mix(tokens[: k + 1] ^ _seed(round_, band, 4)))
    return np.concatenate(found), short


def bitmap(elements: np.ndarray, n_cells: int) -> np.ndarray:
    """Parities of the elements in each cell, as bytes."""
    at = (mix(elements ^ _seed(5)) % np.uint64(n_cells)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n_cells) & 1).astype(np.uint8))


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shingles of the texts with the bounds of each text's, and the hashes of their words with the bounds of each text's."""
    data = lower_ascii(data)
    starts, ends, word_bounds = words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    return *gram_hashes(hashes, word_bounds, SHINGLE), hashes, word_bounds


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingles of each text; of fewer words, the whole sequence; without words, none."""
    grams, gram_bounds, hashes, word_bounds = shingles(data, bounds)
    for i in range(len(bounds) - 1):
        if gram_bounds[i + 1] > gram_bounds[i]:
            every = grams[gram_bounds[i] : gram_bounds[i + 1]]
            every.sort()
            new = np.empty(len(every), bool)
            new[0], new[1:] = True, every[1:] != every[:-1]
            yield every[new]
        else:
            few = hashes[word_bounds[i] : word_bounds[i + 1]]
            total = np.uint64(len(few))
            for x in few:
                total = mix(np.array([total * np.uint64(_GOLDEN) ^ x]))[0]
            yield np.array([total] if len(few) else [], np.uint64)


def set_code(elements: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = np.add.reduce(mix(elements ^ _seed(6)), dtype=np.uint64) if len(elements) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(elements))]))[0].view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _repeated(grams: list[np.ndarray]) -> pa.RecordBatch:
    """(cell, n): how often the shingles of a cell come that come REPEATED times at least."""
    every = np.concatenate([np.zeros(0, np.uint64), *grams])
    grams.clear()
    every.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]]))
    times = np.diff(np.append(first, len(every)))
    often = times >= REPEATED
    cells_ = (every[first[often]] >> np.uint64(64 - RANK_BITS)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(cells_, pa.int32()), pa.array(times[often], pa.int64())], ["cell", "n"])


def common_ranks(docs: DataFrame) -> np.ndarray:
    """The ranks of shingles by the first bits of their hashes, from how often they come in all texts: 0 below 16 times, then one more with each doubling.

    Tasks send only what comes repeatedly among some millions of shingles, summed by cells, so no more than the table's cells reach the driver. Signatures are
    right with any ranks that all sets share; they only spare candidates.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            for i, j in slices(bounds):
                held.append(shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0])
                size += len(held[-1])
                if size >= CHUNK:
                    yield _repeated(held)
                    size = 0
        yield _repeated(held)

    counted = _texts(docs).select("text").mapInArrow(count, "cell int, n long")
    often = counted.groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 16").toArrow()
    ranks = np.zeros(1 << RANK_BITS, np.uint8)
    ranks[often.column("cell").to_numpy()] = np.minimum(np.log2(often.column("n").to_numpy()).astype(np.int64) - 3, LAST_RANK)
    return ranks


def _signed(docs: DataFrame, round_: int, ranks: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n, code, short, signatures, bitmap). Of equal sets in a task only the first has signatures."""
    packed = zlib.compress(ranks, 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ranks = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in slices(bounds):
                out: list[list] = [[], [], [], [], []]
                for elements in shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
                    code, short, marks, map_ = set_code(elements), False, np.zeros(0, np.uint64), b""
                    if len(elements) and code not in seen:
                        seen.add(code)
                        marks, short = signatures(elements, round_, ranks)
                        sizes = sorted({cells(1 << b) for b in bands(len(elements))})  # one bitmap for each band
                        map_ = b"".join(bitmap(elements, c).tobytes() for c in sizes)
                    for column, value in zip(out, (len(elements), code, short, marks.view(np.int64), map_), strict=True):
                        column.append(value)
                cuts = pa.array(np.cumsum([0, *map(len, out[3])]).astype(np.int32))
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *out[3]]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()),
                    pa.ListArray.from_arrays(cuts, flat), pa.array(out[4], pa.binary()),
                ], ["doc_id", "text_hash", "n", "code", "short", "signatures", "bitmap"])

    return _texts(docs).mapInArrow(sign, "doc_id long, text_hash long, n long, code long, short boolean, signatures array<long>, bitmap binary")


class _Member:
    """A set of a signature, with its bitmaps as whole numbers."""

    def __init__(self, code: int, n: int, label: int, block: int, map_: bytes):
        self.code, self.n, self.label, self.block, self.maps = code, n, label, block, {}
        at = 0
        for c in sorted({cells(1 << b) for b in bands(n)}):
            self.maps[c] = int.from_bytes(map_[at : at + c // 8], "little")
            at += c // 8

    def may_match(self, other: _Member) -> bool:
        small, large = sorted((self.n, other.n))
        if 100 * small < PERCENT * large:
            return False
        limit = (100 - PERCENT) * (small + large) // (100 + PERCENT)
        return all((m ^ other.maps[c]).bit_count() <= limit for c, m in self.maps.items() if c in other.maps)


def _forest(members: list[_Member]) -> list[tuple[int, int]]:
    """Each set with the first one it may match and that no earlier one may match; so every set that may match any is in a pair."""
    found, taken = [], []
    while members:
        one, rest, members = members[0], members[1:], []
        here = len(found)
        for x in rest:
            if one.may_match(x):
                found.append((one.code, x.code))
                taken.append(x)
            else:
                members.append(x)
        if len(found) == here:
            other = next((x for x in taken if x.may_match(one)), None)
            if other:
                found.append((min(one.code, other.code), max(one.code, other.code)))
    return found


def _askers(members: list[_Member]) -> list[tuple[int, int, int]]:
    """(code, label, block) of the sets that may match one of another label, and of the other block if there are two."""
    two, found = len({m.block for m in members}) > 1, set()
    for i, x in enumerate(members):
        for y in members[i + 1 :]:
            if x.label != y.label and (not two or x.block != y.block) and not (x.code in found and y.code in found) and x.may_match(y):
                found |= {x.code, y.code}
    return [(m.code, m.label, m.block) for m in members if m.code in found]


def _dealt(members: DataFrame) -> DataFrame:
    """Add (block, i, j): a signature of many sets is dealt into blocks; block b meets each block c in the task (min, max)."""
    sizes = members.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "signature").withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    return rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "c"), "j": F.greatest("block", "c")}).drop("c", "blocks")


def _by_key(batches: Iterator[pa.RecordBatch], members_of: Callable, results_of: Callable) -> Iterator[list]:
    """Results of each (signature, i, j), whose rows come together. Elements stay views of the batch: as Python numbers they would take some ten times the room."""
    key, members = None, []
    for batch in batches:
        found: list = []
        columns = [(x.values.to_numpy() for x in c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for signature, i, j, *rest in zip(*columns, strict=True):
            if key != (signature, i, j):
                found += [(key, r) for r in results_of(members)]
                key, members = (signature, i, j), []
            members.append(members_of(*rest))
        yield found
    yield [(key, r) for r in results_of(members)]


_KEYS = ["signature", "i", "j"]


def _forest_candidates(members: DataFrame, maps: DataFrame) -> DataFrame:
    """(signature, a, b) with a < b: in each signature (of each block, if it has many sets) a forest of candidates by the bitmaps in `maps` (code, n, bitmap)."""
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_key(batches, _Member, _forest):
            yield pa.RecordBatch.from_arrays([pa.array([key[0] for key, _ in found], pa.int64()), *_pairs([r for _, r in found]).columns], ["signature", "a", "b"])

    rows = _dealt(members).where("i = j").withColumn("label", F.col("code"))
    dealt = rows.join(maps, "code").select(*_KEYS, "code", "n", "label", "block", "bitmap").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "code")
    return dealt.mapInArrow(pair, "signature long, a long, b long")


def _undecided(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """(signature, code): the sets that the forest leaves open. Every set that may match any is in a pair of its signature, so a signature of one pair or none is settled once
    that pair is compared; blocks of a signature of many sets have not met yet, so all of its sets are open."""
    open_ = candidates.groupBy("signature").count().where(F.col("count") > 1).select("signature")
    paired = candidates.join(open_, "signature", "left_semi").select("signature", F.explode(F.array("a", "b")).alias("code"))
    large = groups.groupBy("signature").count().where(F.col("count") > BLOCK).select("signature")
    return paired.unionByName(groups.join(large, "signature", "left_semi").select("signature", "code")).distinct()


def _open_members(members: DataFrame, maps: DataFrame, labels: DataFrame) -> DataFrame:
    """(signature, i, j, code, label, block): the sets of each signature that may be linked with one of another label, as far as the bitmaps tell.

    A set is one row for each pair of blocks, however many it may match. Callers keep one of several signatures that leave the same sets.
    """
    rows = members.join(labels, "code", "left").withColumn("label", F.coalesce("label", "code"))
    mixed = rows.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("signature")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_key(batches, _Member, _askers):
            columns = [*zip(*[(*key, *r) for key, r in found], strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OPEN.types, strict=True)], _OPEN.names)

    dealt = _dealt(rows.join(mixed, "signature", "left_semi")).join(maps, "code").select(*_KEYS, "code", "n", "label", "block", "bitmap")
    return dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "code").mapInArrow(ask, "signature long, i int, j int, code long, label long, block int")


_OPEN = pa.schema([("signature", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("code", pa.int64()), ("label", pa.int64()), ("block", pa.int32())])


def _proven(members: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """A forest of true links over the labels of the sets (code, label, block, elements): fewer links than sets, but every set that is similar to another is connected with it."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    two, found = len({m[2] for m in members}) > 1, []
    for at, (a, label, block, x) in enumerate(members):
        for b, other, where, y in members[at + 1 :]:
            if (two and block == where) or 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)) or root(label) == root(other):
                continue
            if _alike(x, y):
                parent[root(label)] = root(other)
                found.append((min(a, b), max(a, b)))
    return found


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _proven_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): true links between the open sets of each signature, at most one fewer than it has rows. The elements come to the task once for each row; nothing but links leaves it."""
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_key(batches, lambda *member: member, _proven):
            yield _pairs([r for _, r in found])

    rows = open_.join(sets, "code").select(*_KEYS, "code", "label", "block", "elements").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "code")
    return rows.mapInArrow(prove, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets (code, elements) are similar enough. The elements of both sides are sorted."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i) for i in (2, 3))
            good = []
            for x, y in zip(a, b, strict=True):
                good.append(_alike(x.values.to_numpy(), y.values.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = sets.select(F.col("code").alias("a"), F.col("elements").alias("x"))
    second = sets.select(F.col("code").alias("b"), F.col("elements").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _elements(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code, elements) of the sets of the documents in `wanted` (doc_id, code)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in slices(bounds):
                sets = list(shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
                cuts = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
                codes = pa.array([set_code(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), codes, pa.ListArray.from_arrays(cuts, flat)], ["doc_id", "code", "elements"])

    # a merge join whatever the size, as the ids grow with the texts
    texts = _texts(docs).join(wanted.select("doc_id").hint("merge"), "doc_id", "left_semi")
    found = texts.mapInArrow(cut, "doc_id long, code long, elements array<long>")
    # rows that repeat an id may hold other texts; only the wanted set counts, and once
    return found.join(wanted, ["doc_id", "code"], "left_semi").groupBy("code").agg(F.first("elements").alias("elements"))


def connect(links: DataFrame, checkpoint_to: str) -> DataFrame:
    """(code, label) of all nodes of the links (a, b): the least node reachable. Labels are halved in distance in each round."""
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{checkpoint_to}/edges")
    both = spark.read.parquet(f"{checkpoint_to}/edges")
    labels = both.groupBy(F.col("a").alias("code")).agg(F.least(F.min("b"), F.col("code")).alias("label"))
    for round_ in range(1000):
        labels.write.parquet(f"{checkpoint_to}/labels{round_}")
        labels = spark.read.parquet(f"{checkpoint_to}/labels{round_}")
        near = both.join(labels.withColumnRenamed("code", "a"), "a").groupBy(F.col("b").alias("code")).agg(F.min("label").alias("near"))
        low = labels.join(near, "code").select("code", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        far = labels.select(F.col("code").alias("label"), F.col("label").alias("far"))
        nexts = low.join(far, "label").select("code", F.least("label", "far").alias("label"), "old")
        nexts.write.parquet(f"{checkpoint_to}/next{round_}")
        nexts = spark.read.parquet(f"{checkpoint_to}/next{round_}")
        if nexts.where("label <> old").isEmpty():
            return nexts.select("code", "label")
        labels = nexts.select("code", "label")
    raise RuntimeError("labels did not settle")


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs that no frame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, n_links, component_id) of each row; text_hash, the xxhash64 of the text (null: empty), tells rows that share an id apart.

    The set of a row is that of the distinct 5-word shingles of its whole text, in lower case (A-Z); texts of fewer words have their whole sequence as
    one, those without words an empty set that is linked with nothing. Rows link when the intersection is at least 75 % of the union. component_id
    is the least doc_id reachable by links; n_links counts the different sets linked with the row's own, as far as they were compared (a
    spanning part of a group of near copies). Equal sets are handled once. A null doc_id belongs to its set, and has a component as the others.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    root = scratch_path(spark, "near")
    ranks = common_ranks(docs)
    for round_ in range(20):
        path = f"{root}/signed{round_}"
        _signed(docs, round_, ranks).write.parquet(path)
        signed = spark.read.parquet(path)
        if signed.where("short").isEmpty():
            break
    else:
        raise RuntimeError("some set had too few tokens with every hash")

    _members(signed).write.parquet(f"{root}/members")
    signed.drop("signatures", "short").write.parquet(f"{root}/sets")  # without the signatures, which take most of the room
    remove_path(spark, path)
    release(spark)
    signed = spark.read.parquet(f"{root}/sets")
    found = spark.read.parquet(f"{root}/members")
    one = found.groupBy("signature").agg(F.sum(F.xxhash64("code").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
    one = one.groupBy("sum", "n").agg(F.min("signature").alias("signature")).select("signature")
    found.join(one, "signature", "left_semi").write.parquet(f"{root}/groups")
    remove_path(spark, f"{root}/members")
    release(spark)
    groups = spark.read.parquet(f"{root}/groups")
    maps = signed.where(F.length("bitmap") > 0).groupBy("code").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))

    _forest_candidates(groups, maps).write.parquet(f"{root}/forest")
    release(spark)
    forest = spark.read.parquet(f"{root}/forest")
    _undecided(groups, forest).write.parquet(f"{root}/undecided")
    undecided = spark.read.parquet(f"{root}/undecided")
    forest = forest.select("a", "b").distinct()
    least = signed.where("n > 0").groupBy("code").agg(F.min("doc_id").alias("doc_id"))
    paired = forest.select(F.col("a").alias("code")).unionByName(forest.select(F.col("b").alias("code"))).unionByName(undecided.select("code")).distinct()
    least.join(paired, "code", "left_semi").write.parquet(f"{root}/wanted")
    _elements(docs, spark.read.parquet(f"{root}/wanted")).write.parquet(f"{root}/elements")
    release(spark)
    sets = spark.read.parquet(f"{root}/elements")
    _similar(forest, sets).write.parquet(f"{root}/links0")
    release(spark)
    labels = connect(spark.read.parquet(f"{root}/links0"), f"{root}/connect0")
    _open_members(undecided, maps, labels).write.parquet(f"{root}/open")
    release(spark)
    asked = spark.read.parquet(f"{root}/open")
    alike = asked.groupBy(*_KEYS).agg(F.sum(F.xxhash64("code", "block").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
    alike = alike.groupBy("sum", "n").agg(F.min(F.struct(*_KEYS)).alias("key")).select("key.*")
    _proven_links(asked.join(alike, _KEYS, "left_semi"), sets).write.parquet(f"{root}/links1")
    remove_path(spark, f"{root}/elements")
    release(spark)
    links = spark.read.parquet(f"{root}/links0", f"{root}/links1")
    labels = connect(links, f"{root}/connect1")

    degree = links.select(F.col("a").alias("code")).unionByName(links.select(F.col("b").alias("code"))).groupBy("code").agg(F.count(F.lit(1)).alias("n_links"))
    component = labels.join(least, "code").groupBy("label").agg(F.min("doc_id").alias("component"))
    linked = labels.join(component, "label").join(degree, "code", "left").select("code", "component", "n_links")
    known = least.withColumnRenamed("doc_id", "own").join(linked, "code", "left")
    rows = signed.select("doc_id", "text_hash", "n", "code").join(known, "code", "left")
    rows.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "own")).alias("component_id"),
    ).write.parquet(result := scratch_path(spark, "components"))
    remove_path(spark, root)
    return spark.read.parquet(result)


#: Rows (signature, code) that a task deals into buckets together, and of a bucket, about.
DEALT, BUCKET = 1 << 19, 1 << 18


def _members(signed: DataFrame) -> DataFrame:
    """(signature, code), once each, of the signatures that two or more sets share.

    The rows travel as packed arrays, sorted and dealt by the first bits of the signature into buckets; a task holds one bucket at a time. More sets make more buckets.
    """
    total = signed.agg(F.sum(F.size("signatures"))).first()[0] or 0
    bits = max(1, (total // BUCKET).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            marks = batch.column(0)
            codes = np.repeat(batch.column(1).to_numpy(), np.diff(marks.offsets.to_numpy()))
            held.append(np.stack([marks.values.to_numpy()[marks.offsets[0].as_py() : marks.offsets[-1].as_py()], codes]))
            size += len(codes)
            if size >= DEALT:
                yield _buckets(held, bits)
                held, size = [], 0
        yield _buckets(held, bits)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for here, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if here != bucket:
                    yield _shared(held)
                    bucket, held = here, []
                held.append(np.frombuffer(rows.as_buffer(), np.int64).reshape(2, -1))
        yield _shared(held)

    dealt = signed.where(F.size("signatures") > 0).select("signatures", "code").mapInArrow(deal, "bucket int, rows binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(share, "signature long, code long")


def _buckets(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """(bucket, rows): rows (signature, code) by the first bits of the signature."""
    rows = np.concatenate([np.zeros((2, 0), np.int64), *held], 1)
    rows = rows[:, np.argsort(rows[0].view(np.uint64))]
    buckets = (rows[0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    parts = np.split(rows, cuts, 1) if len(buckets) else []
    numbers = buckets[np.concatenate([[0], cuts])] if len(buckets) else []
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["bucket", "rows"])


def _shared(held: list[np.ndarray]) -> pa.RecordBatch:
    """The rows (signature, code) of a bucket whose signature has another code, once each."""
    rows = np.concatenate([np.zeros((2, 0), np.int64), *held], 1)
    rows = rows[:, np.argsort(rows[0])]
    rows = rows[:, _repeats(rows[:1])]
    rows = rows[:, np.lexsort(rows[::-1])]
    rows = rows[:, ~_repeats(rows, True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, _repeats(rows[:1])]], ["signature", "code"])


def _repeats(rows: np.ndarray, before: bool = False) -> np.ndarray:
    """Which columns of a sorted array are equal to a column beside them, or to the one before."""
    same = (rows[:, 1:] == rows[:, :-1]).all(0) if rows.shape[1] else np.zeros(0, bool)
    none = np.zeros(min(rows.shape[1], 1), bool)
    after = np.concatenate([none, same])
    return after if before else after | np.concatenate([same, none])
