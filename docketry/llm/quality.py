"""Quality rules: gradient-boosted trees over document statistics.

The statistics of every whole text are computed in one pass over its bytes.  Trees are grown on a
bounded sample of labelled documents (``MAX_TRAIN`` rows, those with the smallest hash of their id)
with monotonic constraints on chosen features, then flattened into numpy node arrays that score a
batch level by level.  A document is kept unless a base rule fails it or the trees reject it.

Null text counts as empty; an empty text has no words and fails the base rule.  Rows are judged one
by one, so repeated or null ids and ties change nothing; very long texts are counted whole; extra columns are carried
by :func:`keep`.  With no usable labels (empty table, or one class only) the trees hold no split and reject nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, written
from docketry.llm.textbytes import Run, firsts, mix, repeated, runs

MAX_TRAIN = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_bars", "n_distinct_words")
COUNTS = BASE + EXTRA
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
#: Features and the sign of the constraint on the score: -1 may only lower it as the feature grows.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0, "marks": -1, "bars": -1, "distinct": 1, "words_per_line": 0}


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS, _MARKS, _BARS = _class("#*$%&|<>"), _class("!?"), _class("|")
_UPPER, _DIGITS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")


def _counts(run: Run) -> np.ndarray:
    starts, ends, first = run.words()
    doc = np.repeat(np.arange(run.n), np.diff(first))
    data, prefix = run.data, run.prefix()
    hashes = Run.spans(prefix, starts, ends)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    per_doc = lambda values: np.bincount(doc, weights=values, minlength=run.n).astype(np.int64)
    # Words in three-word windows that are found twice or more.
    covered = np.zeros(len(starts), dtype=bool)
    if len(starts) > 2:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        a, b, c = hashes[inside], hashes[inside + 1], hashes[inside + 2]
        again = inside[repeated(doc[inside], mix(mix(mix(a) + b) + c))]
        for k in range(3):
            covered[again + k] = True
    # Lines with a word that equal an earlier line.
    breaks = np.flatnonzero(data == 10)
    line_at = np.unique(np.concatenate([run.at[:-1], breaks + 1]))
    line_at = line_at[line_at < len(data)]
    line_doc = np.searchsorted(run.at, line_at, "right") - 1
    line_end = np.append(line_at[1:], len(data)) if len(line_at) else line_at
    line_end = np.where((line_end > line_at) & (line_end > 0), line_end, line_at)
    stop = line_end - np.where((line_end > line_at) & (data[np.maximum(line_end - 1, 0)] == 10), 1, 0) if len(line_at) else line_end
    with_word = np.searchsorted(starts, stop) > np.searchsorted(starts, line_at)
    lines, owner = Run.spans(prefix, line_at[with_word], stop[with_word]), line_doc[with_word]
    fresh = firsts(owner, lines)
    n_lines = np.bincount(owner, minlength=run.n)
    return np.column_stack([
        np.diff(first),
        per_doc(points[ends] - points[starts]),
        run.sums(_SYMBOLS[data]),
        n_lines - np.bincount(owner[fresh], minlength=run.n),
        per_doc(covered),
        n_lines,
        run.sums(_UPPER[data]),
        run.sums(_DIGITS[data]),
        run.sums(_MARKS[data]),
        run.sums(_BARS[data]),
        per_doc(firsts(doc, hashes)),
    ]).astype(np.int64)


def counts(column: pa.Array) -> np.ndarray:
    """The statistics ``COUNTS`` of every text of a column."""
    parts = [_counts(run) for run in runs(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), dtype=np.int64)


def features(c: np.ndarray) -> np.ndarray:
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    of = dict(zip(COUNTS, c.T.astype(float), strict=True))
    return np.column_stack([
        np.log1p(of["n_words"]), of["word_chars"] / words, of["n_symbols"] / chars, of["n_dup_lines"] / np.maximum(of["n_lines"], 1), of["n_repeat_words"] / words,
        of["n_upper"] / chars, of["n_digits"] / chars, of["n_marks"] / chars, of["n_bars"] / words, of["n_distinct_words"] / words, of["n_words"] / np.maximum(of["n_lines"], 1),
    ])


class Trees:
    """Boosted trees as arrays of (tree, node): feature (-1: leaf), threshold, value; children of i are 2i+1 and 2i+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.feature, self.threshold, self.value, self.base, self.depth = feature, threshold, value, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality, for all rows and trees at once."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, node]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.threshold[trees, node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, shrink: float = 1.0) -> Trees:
    """Second-order boosting on histograms.  A split on a constrained feature must order its two leaf
    values; its children are bounded by their mean, so the order holds in the whole subtree."""
    signs = np.array(list(FEATURES.values()))
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    if len(y) == 0 or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], value[:0], 20.0, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    mean = y.mean()
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        for i in range(size):
            rows = np.flatnonzero(node == i)
            if not len(rows):
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, i] = np.clip(-g / (h + shrink), low[i], high[i])
            if 2 * i + 2 >= size:
                continue
            best = (1e-6, -1, 0, 0.0, 0.0)
            for f in range(x.shape[1]):
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, grad[rows], minlength=bins))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], minlength=bins))[:-1]
                wl, wr = np.clip(-gl / (hl + shrink), low[i], high[i]), np.clip(-(g - gl) / (h - hl + shrink), low[i], high[i])
                gain = -(gl * wl + (hl + shrink) * wl**2 / 2) - ((g - gl) * wr + (h - hl + shrink) * wr**2 / 2) + g * value[t, i] + (h + shrink) * value[t, i] ** 2 / 2
                gain[(hl < least) | (h - hl < least) | (signs[f] * (wr - wl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0] and k < len(edges[f]):
                    best = (gain[k], f, k, wl[k], wr[k])
            _, f, k, wl, wr = best
            if f < 0:
                continue
            feature[t, i], threshold[t, i] = f, edges[f][k]
            right = binned[rows, f] > k
            node[rows] = 2 * i + 1 + right
            low[[2 * i + 1, 2 * i + 2]], high[[2 * i + 1, 2 * i + 2]] = low[i], high[i]
            if signs[f]:
                middle = (wl + wr) / 2
                upper, lower = (2 * i + 2, 2 * i + 1) if signs[f] > 0 else (2 * i + 1, 2 * i + 2)
                low[upper], high[lower] = max(low[upper], middle), min(high[lower], middle)
        value[t] *= rate
        margin += value[t, node]
    return Trees(feature, threshold, value, base, depth)


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in c.T)], names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {SCHEMA}")


def train(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from labelled statistics; ``max_train`` bounds what reaches the driver.  Documents or labels with nulls are no examples."""
    quality = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = written(stats.join(quality, "doc_id"), "labelled")
    # A cut on the hash first, so that little more than the sample is ever sent to the driver.
    share = min(1.0, 1.2 * max_train / max(labelled.count(), 1))
    hashed = F.xxhash64("doc_id")
    sample = labelled.where(F.pmod(hashed, F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.pmod(hashed, F.lit(1 << 20)), hashed, *COUNTS).limit(max_train).toPandas()
    return grow(features(sample[list(COUNTS)].to_numpy(np.int64)), sample["quality"].to_numpy(float))


def judge(stats: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """Adds base_failed, score and kept to statistics."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c = f[list(COUNTS)].to_numpy(np.int64)
            failed, score = base_failed(c), trees.score(features(c))
            yield f.assign(base_failed=failed, score=score, kept=~failed & (score >= threshold))

    return stats.mapInPandas(run, f"doc_id long, {SCHEMA}, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """The rows that pass, with all their columns, in one pass over the texts."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = counts(b.column(place))
            yield b.filter(pa.array(~base_failed(c) & (trees.score(features(c)) >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(statistics(table(spark, sf_dir, "documents")), "stats")
    return judge(stats, train(stats, table(spark, sf_dir, "labels"))).select("doc_id", *BASE, "base_failed", "kept", "score")
