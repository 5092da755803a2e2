"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics.  Training adds up,
per class, the count, the sums and the sums of products of all labelled rows in
one aggregation, so no sample is needed.  Class covariances are shrunk towards
the pooled covariance and towards a multiple of the identity; their Cholesky
factors are computed once, and a score is the logistic function of the
difference of the two log densities plus the log prior odds.

Defined cases: null and empty texts have the statistics of an empty text and
get a score like any other; labels that occur several times for one document
count once (the smallest); a class with fewer than two rows takes the pooled
moments; without any label every score is 0.5; very long texts are taken whole; equal
statistics give equal scores; repeated rows are scored each; extra columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import textkit

NAMES = ("words", "word_bytes", "upper", "digits", "symbols", "stops", "breaks", "bars", "calls", "high", "distinct", "top_word", "lines_distinct", "odd_ends", "mixed")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:'\"?()-"]] = True


def _shares(mask: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(of, 1)


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in each row and the count of the commonest."""
    n = len(offsets) - 1
    kinds, most = np.zeros(n), np.zeros(n)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(hashes[a:b])
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            kinds[k], most[k] = len(edges) - 1, np.diff(edges).max()
    return kinds, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text, transformed to be closer to normal."""
    out = np.zeros((len(column), len(NAMES)))
    for a, b, data, offsets, starts, ends, hashes, at, _ in textkit.texts_in_runs(column):
        size, n = np.diff(offsets).astype(float), np.diff(at).astype(float)
        kinds, most = _distinct(hashes, at)
        breaks = np.flatnonzero(data == 10)
        # Lines: from each text's start or line break to the next one.
        begin = np.concatenate([offsets[:-1], breaks + 1])
        begin = np.sort(begin[begin <= len(data)], kind="stable")
        row = np.minimum(np.searchsorted(offsets, begin, "right") - 1, b - a - 1)
        ended = np.append(begin[1:], len(data))
        lines = textkit.hash_slices(textkit.LOWER[data], begin, np.maximum(begin, ended)) if len(begin) else np.zeros(0, np.uint64)
        line_kinds, _ = _distinct(lines, np.searchsorted(row, np.arange(b - a + 1)))
        n_lines = np.bincount(row, minlength=b - a)
        last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        first = data[starts] if len(starts) else np.zeros(0, np.uint8)
        share = lambda table, on=data, by=offsets, of=size: np.arcsin(np.sqrt(np.clip(_shares(table[on], by, of), 0, 1)))
        bar, call, high, newline = (np.zeros(256, bool) for _ in range(4))
        bar[ord("|")] = call[ord("!")] = newline[10] = True
        high[0x80:] = True
        out[a:b] = np.column_stack(
            [
                np.log1p(n),
                np.log1p(size / np.maximum(n, 1)),
                share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_STOP), share(newline), share(bar), share(call), share(high),
                np.log1p(kinds) - np.log1p(n),
                np.sqrt(most / np.maximum(n, 1)),
                np.sqrt(line_kinds / np.maximum(n_lines, 1)),
                share(_SYMBOL, last, at, n),
                share(_UPPER, first, at, n),
            ]
        )
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every text."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_featurise, f"doc_id {docs.schema[key].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log terms; class 1 minus class 0 is scored."""

    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        log = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            log.append(self.offset[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -50, 50)))


def fit(labelled: DataFrame, label: str, pooled: float = 0.3, ridge: float = 0.02) -> Discriminant | None:
    """From rows with ``x`` and a 0/1 label; None without labels."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    count, total, product = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums).collect():  # two rows at most
        k = int(r[label])
        count[k], total[k] = r["n"], [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            product[k, i, j] = product[k, j, i] = r[f"p{i}_{j}"]
    if not count.sum():
        return None
    every = total.sum(0) / count.sum()
    means = np.array([total[k] / count[k] if count[k] > 1 else every for k in (0, 1)])
    scatter = [product[k] - count[k] * np.outer(means[k], means[k]) if count[k] > 1 else np.zeros((d, d)) for k in (0, 1)]
    shared = sum(scatter) / max(count.sum() - 2, 1)
    scale = np.trace(shared) / d + 1e-9
    whiten, offset = [], []
    for k in (0, 1):
        own = scatter[k] / (count[k] - 1) if count[k] > 1 else shared
        trust = (1 - pooled) * count[k] / (count[k] + 2 * d)
        covariance = trust * own + (1 - trust) * shared
        covariance = (1 - ridge) * covariance + ridge * np.diag(np.diag(shared)) + 1e-4 * scale * np.eye(d)
        factor = np.linalg.cholesky(covariance)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(max(count[k], 0.5) / count.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(offset))


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """``doc_id`` and ``score`` of rows with ``x``."""
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
