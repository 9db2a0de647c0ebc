"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word is the vector of its letter counts. One inserted or deleted code point changes the squared distance of two vectors by one, a replaced one by two, so
words one edit apart have a squared distance of at most two and lengths that differ by at most one. Words are blocked by length and by how many of their
letters lie in each of CLASSES classes; one edit leads to a block of the same length (one letter of another class), or of the next length (one
letter more). Each block meets these neighbours; a NumPy product of the two count matrices gives all squared distances at once, and the pairs at
most two apart are verified letter by letter. Large blocks are cut into pieces and each pair of pieces is met on its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweir.session import ensure_checkpoint_dir, remove_path, scratch_path

#: Least code points and occurrences of a word; a form occurs at least FORM_TIMES as often as the word.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 6, 5, 5
#: One of so many (document, word) pairs loses a code point in the contract's own texts.
DAMAGED = 199
#: Letters are classed by code point modulo this.
CLASSES = 6
#: Words of a piece of a block, distinct words counted in a task before they are passed on, and cells of a distance matrix held at once.
PIECE, HELD, CELLS = 2048, 200_000, 1 << 22

#: What each Latin-1 byte counts as: letters themselves, A-Z in lower case, all else a space. Code points beyond are separators too.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of [A-Za-z\\u00C0-\\u00FF] in whole texts, A-Z in lower case, of at least `least_length` code points and `least_count` occurrences.

    A run whose crc32 of `<doc_id>:<run>` DAMAGED divides is counted without one code point. A null doc_id is written as nothing; null and empty
    texts have no words. Counts are summed within a task before the shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, times in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(word) >= least_length:  # a shorter run can't become a word
                        crc = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                        if not crc % DAMAGED:
                            at = crc % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] = held.get(word, 0) + times
                if len(held) > HELD:
                    yield _counted(held)
                    held = {}
        yield _counted(held)

    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    counts = counted.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _block() -> list[Column]:
    """How many letters of `word` lie in each class."""
    points = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.ascii(F.substr(F.col("word"), i, F.lit(1))) % CLASSES)
    return [F.size(points) - F.size(F.array_remove(points, k)) for k in range(CLASSES)]


def _neighbours() -> list[list[int]]:
    """Changes of the class counts by one edit, each pair of blocks from one side only: none, a letter of a later class for one of an earlier, or one letter more."""
    none = [0] * CLASSES
    swaps = [[(k == j) - (k == i) for k in range(CLASSES)] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return [none, *swaps, *[[int(k == i) for k in range(CLASSES)] for i in range(CLASSES)]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PIECE words (Latin-1, in a row) of each block; rows come sorted by block."""
    names = ["block", "piece", "words", "counts"]
    block, piece, words, counts = None, 0, [], []
    out: list[list] = [[], [], [], []]

    def close() -> None:
        if words:
            for column, value in zip(out, (block, piece, "".join(words).encode("latin-1"), np.array(counts, np.int64).tobytes()), strict=True):
                column.append(value)

    def batch_of() -> pa.RecordBatch:
        types = (pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != block or len(words) >= PIECE:
                close()
                piece = piece + 1 if key == block else 0
                block, words, counts = key, [], []
            words.append(word)
            counts.append(n)
        yield batch_of()
    close()
    yield batch_of()


def _letters(words: bytes, length: int) -> np.ndarray:
    return np.frombuffer(words, np.uint8).reshape(-1, length)


def _count_matrix(letters: np.ndarray, used: np.ndarray) -> np.ndarray:
    """How often each of the used letters occurs in each word. Single precision holds the squared distances of words of up to 2000 letters exactly."""
    place = np.zeros(256, np.int64)
    place[used] = np.arange(len(used))
    at = place[letters] + np.arange(len(letters))[:, None] * len(used)
    counts = np.bincount(at.ravel(), minlength=len(letters) * len(used))
    return counts.reshape(len(letters), len(used)).astype(np.float32 if letters.shape[1] <= 2000 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b (letters; those of b as long or one longer) are exactly one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


def near_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the words one edit apart, by the Gram matrix of their letter counts."""
    used = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    x, y = _count_matrix(a, used), _count_matrix(b, used)
    x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(CELLS // max(len(b), 1), 1)
    for i in range(0, len(a), step):
        distances = x2[i : i + step, None] + y2[None, :] - 2 * (x[i : i + step] @ y.T)
        at, to = np.nonzero((distances <= 2) & (distances > 0))
        for j in range(0, len(at), PIECE):  # anagrams with one other letter are many
            p, q = at[j : j + PIECE] + i, to[j : j + PIECE]
            good = one_edit(a[p], b[q])
            found.append((p[good], q[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways round, from rows (words, counts, length, the same of the other piece, whether it is the same piece)."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for words, counts, length, others, other_counts, other_length, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = _letters(words, length), _letters(others, other_length)
            p, q = near_pairs(a, b)
            if same:
                p, q = p[p < q], q[p < q]
            n, m = np.frombuffer(counts, np.int64), np.frombuffer(other_counts, np.int64)
            left = [words[k * length : (k + 1) * length].decode("latin-1") for k in p.tolist()]
            right = [others[k * other_length : (k + 1) * other_length].decode("latin-1") for k in q.tolist()]
            out[0] += left + right
            out[1] += right + left
            out[2] += m[q].tolist() + n[p].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of the words (word, n) that are one inserted, deleted or replaced code point apart, both ways round.

    Words are distinct and not empty, of code points up to U+00FF. Pieces of blocks lie in a staged table below the shared folder; Spark joins each with its neighbours'.
    """
    spark = words.sparkSession
    keyed = words.withColumn("block", F.array(*_block()).cast("array<int>")).repartition("block").sortWithinPartitions("block", "word")
    path = scratch_path(spark, "blocks")
    keyed.select("block", "word", "n").mapInArrow(_pack, "block array<int>, piece int, words binary, counts binary").write.parquet(path)
    pieces = spark.read.parquet(path)
    changes = F.array(*[F.struct(F.array(*[F.lit(x) for x in change]).alias("change"), F.lit(i == 0).alias("own")) for i, change in enumerate(_neighbours())])
    sides = pieces.select("block", "piece", F.explode(changes).alias("c")).select(
        "block", "piece", F.zip_with("block", "c.change", lambda x, y: x + y).alias("other"), "c.own"
    )
    others = pieces.select(F.col("block").alias("other"), F.col("piece").alias("other_piece"))
    pairs = sides.join(others, "other").where(~F.col("own") | (F.col("piece") <= F.col("other_piece")))
    right = pieces.select(F.col("block").alias("other"), F.col("piece").alias("other_piece"), F.col("words").alias("other_words"), F.col("counts").alias("other_counts"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    met = pairs.join(pieces, ["block", "piece"]).join(right, ["other", "other_piece"]).select(
        "words", "counts", total("block").alias("length"), "other_words", "other_counts", total("other").alias("other_length"),
        (F.col("own") & (F.col("piece") == F.col("other_piece"))).alias("same"),
    )
    return met.mapInArrow(_meet, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms. Chains double in reach in each round; counts grow fivefold
    along a chain, so its length is bounded by the logarithm of the largest count."""
    spark = forms.sparkSession
    ensure_checkpoint_dir(spark)
    reach = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nexts = reach.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        reach = nexts.select("word", "root")
        if nexts.where("moved").isEmpty():
            return reach


def group_spellings(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the distinct words (word, n).

    n_near counts the words one edit apart; `form` is the one of largest n (ties: the smallest in code-point order) if that is at least FORM_TIMES the word's own n, else
    null; `root` follows the forms to the last, and is the word itself without one. An empty table gives an empty one.
    """
    spark = words.sparkSession
    staged = scratch_path(spark, "words")
    words.select("word", "n").write.parquet(staged)
    words = spark.read.parquet(staged)
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    large = -F.col("best.m") >= FORM_TIMES * F.col("n")
    path = scratch_path(spark, "forms")
    known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n"),
    ).write.parquet(path)
    found = spark.read.parquet(path)
    roots = _roots(found.where("form IS NOT NULL").select("word", "form"))
    remove_path(spark, staged)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
