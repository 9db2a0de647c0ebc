"""Language identification by letter trigrams, learned from labelled texts.

A trigram is one number: three code points of 21 bits. Texts become letters and single spaces inside the JVM; the trigrams are counted by one sort of a
text's numbers in an Arrow kernel, so the work grows with the length of the text (times its logarithm) and no gram crosses as a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweir.operators.keyed import spread_join
from postweir.session import ensure_checkpoint_dir, stage

#: Characters counted at once in a task; a longer text is counted alone and whole.
SLICE_CHARS = 1 << 18


def letters_of(text: Column) -> Column:
    """The lower-cased letters, words separated by one space; letters beyond the basic plane count as separators."""
    return F.trim(F.regexp_replace(F.lower(text), r"[[^\p{L}\p{M}]\x{10000}-\x{10FFFF}]+", " "))


def gram_code(gram: str) -> int:
    """The number of a trigram."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts in a row, words framed by spaces, and the place of each one's text in the list."""
    texts = [f" {t} " if t else "" for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:-2] == owner[2:] if len(points) > 2 else np.zeros(0, bool)
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return codes[inside], owner[:-2][inside]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts, given their lengths, of SLICE_CHARS characters or one longer text."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE_CHARS:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each slice of texts."""
    for batch in batches:
        for i, texts in _text_slices(batch.column(1)):
            codes, owner = _grams(texts)
            langs = batch.column(0).slice(i, len(texts)).to_pylist()
            names = sorted(set(langs))
            lang = np.array([names.index(x) for x in langs], np.int64)[owner]
            for k, name in enumerate(names):
                grams, times = _counts(codes[lang == k])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(times, pa.int64())], ["lang", "gram", "n"])


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(gram, lang, weight, base): add-one smoothed log probabilities; `gram` is the number of a trigram.

    `base` is the language's value for a trigram it never saw, `weight` what a seen one adds to it.
    Counts are summed within a task first. The counts, far smaller than the texts, are checkpointed: the texts are read once.
    """
    ensure_checkpoint_dir(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters_of(F.col(text)).alias("t"))
    partial = rows.mapInArrow(_count_by_language, "lang string, gram bigint, n bigint")
    counts = partial.groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    vocabulary = counts.select(F.count_distinct("gram").alias("v")).scalar()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select(
        "gram", "lang", F.log(F.col("n") + 1.0).alias("weight"), (-F.log(F.col("total") + vocabulary)).alias("base")
    )


_GRAM_COUNTS = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("times", T.IntegerType())]))


def _count_lists(texts: list[str | None]) -> pa.Array:
    """For each text the list of its (gram, times), NULL without any."""
    grams, owner = _grams(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    counts = [_counts(grams[first:last]) for first, last in zip(bounds, bounds[1:], strict=False)]
    sizes = np.array([len(found) for found, _ in counts], np.int64)
    none = np.append(sizes == 0, False)
    cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=none if none.any() else None)
    values = np.concatenate([np.zeros(0, np.int64), *(found for found, _ in counts)])
    times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(values), pa.array(times)], ["gram", "times"]))


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of a column: only one slice at a time is made Python strings."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    for i, j in _slices(sizes):
        yield i, texts.slice(i, j - i).to_pylist()


@F.arrow_udf(_GRAM_COUNTS)
def _counted(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_count_lists([]), *(_count_lists(part) for _, part in _text_slices(texts))])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of a row but the last, its text, in whose place come the text's counts; a batch goes out in slices, so that only one slice's counts are held."""
    for batch in batches:
        last = batch.num_columns - 1
        for i, part in _text_slices(batch.column(last)):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, len(part)) for c in range(last)), _count_lists(part)], batch.schema.names)


def gram_counts(text: Column) -> Column:
    """array<struct<gram, times>>: the distinct trigrams of one text, as numbers, with how often they occur; NULL without letters."""
    return _counted(letters_of(text))


def detect_lang(df: DataFrame, profiles: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys…, detected): the most likely language of each text, NULL when no trigram of it is known.

    The profile becomes one row per trigram with one weight per language. The trigrams of a text are counted within its row, then meet the
    profile; Spark's own estimate decides whether the profile is broadcast. Texts without trigrams stay in the same
    pass, so the input is read once.
    """
    # one row per language, some tens
    bases = [(r["lang"], r["base"]) for r in profiles.select("lang", "base").distinct().orderBy("lang").collect()]
    weights = profiles.groupBy("gram").agg(*[
        F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("weight"))), F.lit(0.0)).alias(f"w{i}") for i, (lang, _) in enumerate(bases)
    ])
    # as a written table Spark knows its size, and joins it where the texts are if it is small enough
    weights = stage(weights, "profile")
    # a text without trigrams gets a row of its own that asks nothing
    own = df.select(F.struct(*keys).alias("keys"), letters_of(F.col(text)).alias("counts"))
    listed = own.mapInArrow(_count_rows, T.StructType([own.schema["keys"], T.StructField("counts", _GRAM_COUNTS)]))
    counted = F.coalesce("counts", F.array(F.struct(F.lit(None).cast("bigint").alias("gram"), F.lit(0).alias("times"))))
    grams = listed.select("keys.*", F.explode(counted).alias("g")).select(*keys, "g.gram", "g.times")
    sums = spread_join(grams, weights, ["gram"], F.col("gram").isNotNull()).groupBy(*keys).agg(
        F.sum("times").alias("n"),
        F.count("w0").alias("known"),
        *[F.sum(F.coalesce(f"w{i}", F.lit(0.0)) * F.col("times")).alias(f"s{i}") for i in range(len(bases))],
    )
    scores = [
        F.struct((F.col(f"s{i}") + F.col("n") * F.lit(base)).alias("score"), F.lit(lang).alias("lang"))
        for i, (lang, base) in enumerate(bases)
    ]
    return sums.select(*keys, F.when(F.col("known") > 0, F.array_max(F.array(*scores))["lang"]).alias("detected"))
