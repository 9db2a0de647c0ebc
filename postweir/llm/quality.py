"""Quality rules whose cutoffs are chosen on labelled rows so that few good documents of any stratum are rejected.

Each rule rejects a document whose score exceeds a cutoff from a fixed list. In a stratum, k of n good holdout documents are rejected at
a cutoff; the exact binomial tail P(Bin(n, limit) <= k) is the p-value of "more than `limit` of the good ones are rejected". Each stratum and
rule gets an equal share of the error (Bonferroni) and walks its list from the mildest cutoff on until a test fails, which keeps the
chance of any wrong certificate below `error`. Among certified cutoffs the one with the best balance of bad and good rejections is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweir.llm.buffers import gram_hashes, slices, text_bytes, word_hashes, words

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]
#: Score of each rule: a ratio of two counts.
RULES = {
    "symbols": ("n_symbols", "word_chars"), "duplicate_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"),
    "upper_case": ("n_upper", "n_letters"), "marks": ("n_marks", "n_words"),
}
CUTOFFS = [round(x / 50, 2) for x in range(100, 0, -1)]
#: Share of good documents that one rule may reject in a stratum, and the chance that any rule in any stratum rejects more.
LIMIT, ERROR = 0.005, 0.05
#: How many bad rejections (as a share of the bad) one good rejection (as a share of the good) must bring.
PRICE = 20


def _flags(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


_SYMBOLS = _flags("#*$%&|<>")
_UPPER, _LOWER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("abcdefghijklmnopqrstuvwxyz")
_MARKS = _flags("!\"'()*+,-./:;<=>?@[]^_`{|}~#$%&")


def _between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, whether its owner has it earlier, and whether its owner has it twice or more."""
    order = np.lexsort((value, owner))  # stable: equal ones stay in order
    same = (owner[order][1:] == owner[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, twice = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return later, twice


def count_texts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The columns of COUNTS for texts that lie one after another in `data`."""
    n = len(bounds) - 1
    starts, ends, word_bounds = words(data, bounds)
    n_words = np.diff(word_bounds)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word_chars = _between(~space & ((data & 0xC0) != 0x80), bounds)
    line_starts, line_ends, _ = words(data, bounds, data != 10)
    n_line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[n_line_words > 0], line_ends[n_line_words > 0]
    line_owner = np.searchsorted(bounds, line_starts, "right") - 1
    later, _ = _again(line_owner, word_hashes(data, line_starts, line_ends))
    grams, gram_bounds = gram_hashes(word_hashes(data, starts, ends), word_bounds, WINDOW)
    gram_owner = np.repeat(np.arange(n), np.diff(gram_bounds))
    _, twice = _again(gram_owner, grams)
    first = (np.arange(len(grams)) + (word_bounds[:-1] - gram_bounds[:-1])[gram_owner])[twice]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + WINDOW, -1)
    covered = np.cumsum(change)[: len(starts)] > 0
    upper, lower = _UPPER[data], _LOWER[data]
    return [
        n_words, word_chars, _between(_SYMBOLS[data], bounds), np.bincount(line_owner[later], minlength=n), _between(covered, word_bounds),
        np.bincount(line_owner, minlength=n), _between(upper, bounds), _between(upper | lower, bounds), _between(_MARKS[data], bounds),
    ]


def measure(docs: DataFrame, stratum: str) -> DataFrame:
    """(doc_id, stratum, COUNTS) of each row's whole text; a null text has no words, a null stratum is the empty one."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            for i, j in slices(bounds):
                found = count_texts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(x, pa.int64()) for x in found)],
                    ["doc_id", "stratum", *COUNTS],
                )

    schema = ", ".join(["doc_id long", "stratum string", *(f"{c} long" for c in COUNTS)])
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).mapInArrow(count, schema)


def score(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def certify(good: np.ndarray, bad: np.ndarray, level: float, limit: float = LIMIT) -> float | None:
    """The chosen cutoff. good, bad: how many labelled documents each cutoff of CUTOFFS rejects, and last how many there are."""
    best, chosen = 0.0, None
    for at, cutoff in enumerate(CUTOFFS):
        k, n = int(good[at]), int(good[-1])
        if n == 0 or k > limit * n or binomial_tail(k, n, limit) > level:
            break
        gain = bad[at] / max(bad[-1], 1) - PRICE * k / n
        if gain > best:
            best, chosen = gain, cutoff
    return chosen


def fit_cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff, for those with a certified cutoff that rejects some bad documents.

    `labels` has (doc_id, quality); a document is good if all its labels are 1; null labels are left out. Documents that the base rules
    reject take no part. All labelled rows count; what comes to the driver is one row for each stratum, rule, label and cutoff.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    scores = F.array(*[F.struct(F.lit(r).alias("rule"), score(r).alias("score")) for r in RULES])
    passed = F.size(F.filter(F.lit(CUTOFFS), lambda c: F.col("r.score") > c))
    counts = (
        measured.where(~base_failed()).join(marked, "doc_id").select("stratum", "good", F.explode(scores).alias("r"))
        .groupBy("stratum", "good", F.col("r.rule").alias("rule"), passed.alias("passed")).count().collect()
    )
    table: dict[tuple[str, str], dict[bool, np.ndarray]] = {}
    for row in counts:
        both = table.setdefault((row["stratum"], row["rule"]), {g: np.zeros(len(CUTOFFS) + 1, np.int64) for g in (True, False)})
        both[row["good"]][len(CUTOFFS) - row["passed"] : len(CUTOFFS)] += row["count"]
        both[row["good"]][-1] += row["count"]
    chosen = {key: certify(x[True], x[False], error / max(len(table), 1), limit) for key, x in table.items()}
    return {key: cutoff for key, cutoff in chosen.items() if cutoff is not None}


def judge(measured: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """Measured rows with `base_failed`, `rejected_by` (rules whose cutoff is exceeded) and `kept`."""
    pairs = [F.lit(x) for (stratum, rule), cutoff in cutoffs.items() for x in (f"{rule} {stratum}", cutoff)]
    limits = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    hits = [F.when(score(r) > F.try_element_at(limits, F.concat(F.lit(f"{r} "), F.col("stratum"))), F.lit(r)) for r in RULES]
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*hits)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
