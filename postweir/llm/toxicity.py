"""Toxicity by a chain of linear classifiers over words and beginnings of words.

The label columns form the chain. Each classifier sees the features and the probabilities of the categories before it; in training these
come from classifiers that did not see the row (out of fold), so that a later one doesn't trust an earlier one too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweir.llm.buffers import BASE, BYTE_CODES, kept_columns, mix, slices, text_bytes, unkept_columns, words
from postweir.session import bound_batches

#: Labelled rows used for training at most (a random share, by a hash of the id), and features kept of those with the clearest difference.
TRAINING_ROWS, FEATURES = 12_000, 1500
FOLDS, STEPS, RATE, SHRINK = 5, 150, 0.15, 3e-4
#: Lengths in bytes of the beginnings of words, beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
LEAST_ROWS = 4
THRESHOLD = 0.5


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(latin, data + np.uint8(32), data)


def text_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature hash) of each word and each beginning of a word in texts that lie one after another, and the words of each text."""
    data = _lower(data)
    starts, ends, word_bounds = words(data, bounds, ((data >= 97) & (data <= 122)) | (data >= 128))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(word_bounds))
    if not len(starts):
        return owner, np.zeros(0, np.uint64), np.diff(word_bounds)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    letters = BYTE_CODES[data[np.repeat(starts, lengths) + place]] * np.cumprod(np.full(int(lengths.max()), BASE))[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters)])
    owners, found = [owner], [mix(total[firsts + lengths] - total[firsts])]
    for size in BEGINNINGS:
        here = lengths > size
        owners.append(owner[here])
        found.append(mix(total[firsts[here] + size] - total[firsts[here]] + np.uint64(size)))
    return np.concatenate(owners), np.concatenate(found), np.diff(word_bounds)


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(first)
    return owner[at], feature[at], np.diff(np.append(at, len(owner)))


def _hits(data: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, column, times) of the vocabulary's features in each text, and the words of each text. vocabulary: sorted hashes."""
    owner, feature, n_words = text_features(data, bounds)
    if len(vocabulary):
        gate = np.zeros(1 << 16, bool)
        gate[(vocabulary & np.uint64(0xFFFF)).astype(int)] = True
        maybe = gate[(feature & np.uint64(0xFFFF)).astype(np.int64)]
        owner, feature = owner[maybe], feature[maybe]
        at = np.minimum(np.searchsorted(vocabulary, feature), len(vocabulary) - 1)
        here = vocabulary[at] == feature
        owner, feature = owner[here], feature[here]
    else:
        owner, feature = owner[:0], feature[:0]
    owner, feature, times = _distinct(owner, feature)
    return owner, np.searchsorted(vocabulary, feature), times, n_words


class Rows:
    """Sparse rows: the features of each text (present or not), and three dense columns about all of them."""

    def __init__(self, n: int, width: int, owner: np.ndarray, column: np.ndarray, times: np.ndarray, n_words: np.ndarray):
        self.n, self.width, self.owner, self.column = n, width, owner, column
        hits = np.bincount(owner, times, n)
        self.dense = np.stack([np.log1p(n_words) / 10, np.log1p(hits), np.minimum(10 * hits / np.maximum(n_words, 1), 3)], 1)

    def times(self, weights: np.ndarray, extra: np.ndarray) -> np.ndarray:
        k = self.dense.shape[1]
        dense, sparse = weights[1 : 1 + k], weights[1 + k : 1 + k + self.width]
        return weights[0] + self.dense @ dense + extra @ weights[1 + k + self.width :] + np.bincount(self.owner, sparse[self.column], self.n)

    def back(self, errors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.concatenate([[errors.sum()], errors @ self.dense, np.bincount(self.column, errors[self.owner], self.width), errors @ extra])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: Rows, extra: np.ndarray, wanted: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier on the rows in `used` (0 or 1), by steps scaled for each weight."""
    weights = np.zeros(1 + rows.dense.shape[1] + rows.width + extra.shape[1])
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        errors = used * (_sigmoid(rows.times(weights, extra)) - wanted)
        slope = rows.back(errors, extra) / max(used.sum(), 1) + SHRINK * np.append(0, weights[1:])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights of each category's classifier. labels: a column for each category, NaN where unknown; folds: each row's fold."""
    extra, chain = np.zeros((rows.n, 0)), []
    for at in range(labels.shape[1]):
        known = ~np.isnan(labels[:, at])
        wanted = np.where(known, labels[:, at], 0)
        chain.append(fit_linear(rows, extra, wanted, known.astype(float)))
        if at + 1 < labels.shape[1]:
            unseen = np.zeros(rows.n)
            for fold in range(FOLDS):
                held = folds == fold
                unseen[held] = _sigmoid(rows.times(fit_linear(rows, extra, wanted, (known & ~held).astype(float)), extra))[held]
            extra = np.column_stack([extra, unseen])
    return chain


def predict_chain(rows: Rows, chain: list[np.ndarray]) -> np.ndarray:
    extra = np.zeros((rows.n, 0))
    for weights in chain:
        extra = np.column_stack([extra, _sigmoid(rows.times(weights, extra))])
    return extra


def fit(docs: DataFrame, labels: DataFrame, categories: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted vocabulary, weights of the chain) from labelled documents.

    At most about TRAINING_ROWS labelled rows are used. Features are counted over them by Spark; those whose shares among the rows with
    and without the last category differ most, against chance, are kept. Nulls count as empty texts or unknown labels; without labelled
    rows of both sorts nothing is learned and every probability stays even.
    """
    bound_batches(docs.sparkSession)
    last = categories[-1]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    have = known.count()
    share = min(1.0, TRAINING_ROWS / max(have, 1))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    known = known.where(part)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(part).join(known, "doc_id").select("text", *categories)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            toxic = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float))
            for i, j in slices(bounds):
                owner, feature, _ = _distinct(*text_features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[:2])
                seen, inverse = np.unique(feature, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(seen.view(np.int64)), pa.array(np.bincount(inverse, toxic[i:j][owner], len(seen))), pa.array(np.bincount(inverse, minlength=len(seen)).astype(float)),
                ], ["feature", "toxic", "rows"])

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(last), F.lit(0.0)).alias("toxic")).first()
    n, toxic = float(totals["n"]), float(totals["toxic"])
    if not 0 < toxic < n:
        return np.zeros(0, np.uint64), []
    counts = rows.select("text", last).mapInArrow(count, "feature long, toxic double, rows double").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
    share_all = F.col("rows") / n
    clear = F.abs(F.col("toxic") / toxic - (F.col("rows") - F.col("toxic")) / (n - toxic)) / F.sqrt(F.greatest(share_all * (1 - share_all), F.lit(1e-9)))
    top = counts.where(F.col("rows") >= LEAST_ROWS).orderBy(clear.desc(), "feature").limit(FEATURES).select("feature").collect()
    vocabulary = np.sort(np.array([r["feature"] for r in top], np.int64).view(np.uint64))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            for i, j in slices(bounds):
                owner, column, times, n_words = _hits(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], vocabulary)
                cuts = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(i, j - i) for k in range(1, batch.num_columns)), pa.array(n_words, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(column.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
                ], [*batch.schema.names[1:], "n_words", "columns", "times"])

    schema = ", ".join([*(f"`{c}` double" for c in categories), "fold int", "n_words long", "columns array<int>", "times array<int>"])
    sample = rows.mapInArrow(match, schema).toPandas()
    owner = np.repeat(np.arange(len(sample)), sample["columns"].map(len).to_numpy(int))
    flat = [np.concatenate([np.zeros(0, int), *sample[c]]).astype(int) for c in ("columns", "times")]
    matrix = Rows(len(sample), len(vocabulary), owner, flat[0], flat[1], sample["n_words"].to_numpy(float))
    return vocabulary, fit_chain(matrix, sample[categories].to_numpy(float), sample["fold"].to_numpy(int))


def score(docs: DataFrame, model: tuple[np.ndarray, list[np.ndarray]], categories: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of each row and `p_CATEGORY` for each category, from the whole text (null: empty).

    Rows may repeat; equal texts have equal probabilities. Columns of `docs` named like a probability are replaced.
    """
    vocabulary, chain = model
    named = [f"p_{c}" for c in categories]
    keep = [c for c in keep or docs.columns if c not in named]
    first = 0 if "text" in keep else 1
    bound_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0).fill_null(""))
            for i, j in slices(bounds):
                if chain:
                    owner, column, times, n_words = _hits(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], vocabulary)
                    found = predict_chain(Rows(j - i, len(vocabulary), owner, column, times, n_words.astype(float)), chain)
                else:
                    found = np.full((j - i, len(categories)), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(first, batch.num_columns)), *(pa.array(x) for x in found.T)],
                    [*batch.schema.names[first:], *(f"p_{c}" for c in categories)],
                )

    chosen = docs.select("text", kept_columns(keep))
    schema = T.StructType([*chosen.schema.fields[first:], *[T.StructField(n, T.DoubleType()) for n in named]])
    return chosen.mapInArrow(predict, schema).select(*unkept_columns(keep), *named)
