"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of other training texts,
whatever their labels, is the unlabelled set.  Features are whole words and
word beginnings of 4 to 8 bytes, of whole texts, by the logarithm of how often
they occur.  Those that tell positives
from the unlabelled by a likelihood-ratio statistic enter a linear model whose
weights minimise the class-prior-corrected risk

    pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)),

with the gradient of the second term turned round while it is negative.

The model is fitted from a bounded sample (``MAX_POSITIVE`` and
``MAX_UNLABELLED`` ids with the smallest hash, one text of each).  Spark counts
in how many of its texts each feature occurs and selects; only the selected
features of the sample come to the driver.  The class prior is the share of
positives among all labelled training rows, and scoring covers every whole
text.

Defined cases: null and empty texts have no features and get the score of the
bias alone; a document labelled twice counts once, by its largest label; of an
id with several rows the sample takes the text that sorts first; of equally
telling features those of smaller hash are taken; very long texts are scored
whole; with no positives every score is 0; extra columns, of whatever names,
are kept by ``accepted`` and ignored otherwise; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from arbora.llm import storage, textkit

#: Bounds of the sample on which the classifier is fitted.
MAX_POSITIVE, MAX_UNLABELLED = 2500, 5000
#: A selected feature occurs in so many positives, has such a likelihood ratio, and is one of so many.
LEAST, TELLING, MOST = 3, 11, 4000
#: Word beginnings, in bytes; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8)
_SALT = np.array([textkit.mix_int(1000 + k) for k in LENGTHS], np.uint64)
_BITS = 20


def _features(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which words have the feature, and its hashes."""
    for k, salt in zip(LENGTHS, _SALT, strict=True):
        if not k:
            yield np.arange(len(starts)), hashes ^ salt
        else:
            own = np.flatnonzero(ends - starts >= k)
            yield own, textkit.slices(sums, starts[own], starts[own] + k) ^ salt


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features, ascending, and how often each occurs."""
    for a, b, _, _, starts, ends, hashes, at, sums in textkit.texts_in_runs(column, textkit.ALNUM):
        row = np.repeat(np.arange(b - a), np.diff(at))
        parts = [(row[own], found) for own, found in _features(sums, starts, ends, hashes)]
        rows, found = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(rows, kind="stable")
        cut = np.searchsorted(rows[order], np.arange(b - a + 1))
        found = found[order]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            yield np.unique(found[x:y], return_counts=True)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """role and feature, once for each text that has it."""
    for batch in batches:
        for role, (kinds, _) in zip(batch.column(0).to_pylist(), text_features(batch.column(1)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), role), pa.int32()), pa.array(kinds.view(np.int64))], ["role", "feature"])


def _chosen_features(chosen: np.ndarray):
    """role, and each text's selected features as bytes: 64-bit hashes, then a byte for each one's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kinds, counts in text_features(batch.column(1)):
                own = np.isin(kinds, chosen)
                out.append(kinds[own].tobytes() + np.minimum(counts[own], 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["role", "features"])

    return run


@dataclass(frozen=True)
class Model:
    """Selected feature hashes, ascending, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Feature number by the low bits of its hash; -1 without one, and -2 for several."""
        table = np.full(1 << _BITS, -1, np.int32)
        slot = (self.features & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        table[slot] = np.arange(len(slot))
        kinds, counts = np.unique(slot, return_counts=True)
        table[kinds[counts > 1]] = -2
        return table


def select(occurrences: DataFrame, n: int, m: int) -> np.ndarray:
    """Features that the n positives have more often than the m unlabelled, by the likelihood-ratio statistic; ascending."""
    counts = occurrences.groupBy("feature").agg(F.sum("role").cast("double").alias("p"), F.sum(1 - F.col("role")).cast("double").alias("q"))
    counts = counts.where((F.col("p") >= LEAST) & (F.col("p") / n > 2 * F.col("q") / m))
    mean = (F.col("p") + F.col("q")) / (n + m)
    part = lambda x, size: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / size / mean)).otherwise(0.0)
    telling = counts.withColumn("g", 2 * (part("p", n) + part("q", m))).where(F.col("g") > TELLING)
    rows = telling.orderBy(F.desc("g"), "feature").limit(MOST).select("feature").collect()  # MOST rows
    return np.sort(np.array([r["feature"] for r in rows], np.int64).view(np.uint64))


def weight_of(counts: np.ndarray) -> np.ndarray:
    """What a feature counts for that occurs so often."""
    return np.log2(1 + np.minimum(counts, 15))


def train(chosen: np.ndarray, roles: np.ndarray, sets: list[np.ndarray], counts: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 2e-3) -> Model:
    """Fit from each sampled text's role (1 positive, 0 unlabelled), features and their counts, by Adam on the non-negative risk."""
    rows, cols, values = [], [], []
    for k, (s, c) in enumerate(zip(sets, counts, strict=True)):
        place = np.minimum(np.searchsorted(chosen, s), max(len(chosen) - 1, 0))
        own = np.flatnonzero(chosen[place] == s) if len(chosen) else place[:0]
        rows.append(np.full(len(own), k))
        cols.append(place[own])
        values.append(weight_of(c[own]))
    rows, cols, values = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    positive, other = roles == 1, roles == 0
    n, m = max(positive.sum(), 1), max(other.sum(), 1)
    w, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    moment, speed = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        margin = bias + np.bincount(rows, w[cols] * values, len(sets))
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        loss = np.logaddexp(0, margin)  # of calling a text not toxic's opposite: the loss for label 0
        negative = loss[other].sum() / m - prior * loss[positive].sum() / n
        if negative >= 0:
            slope = positive * (prior / n * (p - 1) - prior / n * p) + other * (p / m)
        else:
            slope = -(other * (p / m) - positive * (prior / n * p))
        g = np.append(np.bincount(cols, slope[rows] * values, len(w)) + decay * w / max(len(w), 1) ** 0.5, slope.sum())
        moment = 0.9 * moment + 0.1 * g
        speed = 0.999 * speed + 0.001 * g * g
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(chosen, w, float(bias))


def _scorer(model_of, text: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = model_of.value
        mask, crowded = np.uint64((1 << _BITS) - 1), bool((table == -2).any())
        for batch in (part for whole in batches for part in textkit.parts(whole, text)):
            margin = np.full(batch.num_rows, model.bias)
            for a, b, _, _, starts, ends, hashes, at, sums in textkit.texts_in_runs(batch.column(text), textkit.ALNUM):
                row = np.repeat(np.arange(b - a), np.diff(at))
                hits = []
                for own, found in _features(sums, starts, ends, hashes):
                    number = table[(found & mask).astype(np.int64)]
                    if crowded and len(many := np.flatnonzero(number == -2)):
                        number[many] = np.minimum(np.searchsorted(model.features, found[many]), len(model.features) - 1)
                    near = np.flatnonzero(number >= 0)
                    near = near[model.features[number[near]] == found[near]]
                    hits.append(row[own[near]] * np.int64(len(model.features)) + number[near])
                hit, count = np.unique(np.concatenate(hits), return_counts=True)
                if len(hit):
                    margin[a:b] += np.bincount(hit // len(model.features), model.weights[hit % len(model.features)] * weight_of(count), b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], [*batch.schema.names, name])
        batch = None
        textkit.release()

    return run


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", training: Column | None = None) -> Model | None:
    """A model from rows for which ``training`` (a condition on the id) holds; None without positives."""
    training = F.lit(True) if training is None else training
    known = labels.where(training & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    counts = known.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    if not counts["n"] or not counts["p"]:
        return None
    prior = min(max(counts["p"] / counts["n"], 1e-3), 0.9)
    smallest = lambda rows, n: rows.select(F.col(key).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    positive = smallest(known.where(F.col("label") == 1), MAX_POSITIVE).withColumn("role", F.lit(1))
    other = smallest(docs.where(training & F.col(key).isNotNull()), MAX_UNLABELLED).withColumn("role", F.lit(0))
    sample = positive.union(other)
    texts = docs.select(F.col(key).alias("of"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample.select("id").distinct()), F.col("of") == F.col("id")).groupBy("id").agg(F.min("text").alias("text"))
    rows, path = storage.materialize(sample.join(chosen, "id").select("role", "text"), "sample")
    sizes = rows.agg(F.coalesce(F.sum("role"), F.lit(0)).alias("n"), F.count("*").alias("all")).first()
    n, m = sizes["n"], sizes["all"] - sizes["n"]
    if not n:
        return None
    features = select(rows.mapInArrow(_occurrences, "role int, feature bigint"), max(n, 1), max(m, 1))
    got = rows.mapInArrow(_chosen_features(features), "role int, features binary").toArrow()  # the sample's selected features
    storage.drop(docs.sparkSession, path)
    packed = [x.as_py() for x in got.column(1)]
    sets, often = [np.frombuffer(x, np.uint64, len(x) // 9) for x in packed], [np.frombuffer(x, np.uint8, -1, len(x) // 9 * 8) for x in packed]
    return train(features, got.column(0).to_numpy(), sets, often, prior)


def with_score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of that name, which they do not have yet."""
    if model is None or not len(model.features):
        return docs.withColumn(name, F.lit(0.0 if model is None else float(1 / (1 + np.exp(-model.bias)))))
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))
    return docs.mapInArrow(_scorer(shared, docs.columns.index(text), name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row."""
    return with_score(docs.select(key, text), model, text, "score").select(key, "score")


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    name = storage.free_name(docs, "score")
    return with_score(docs, model, text, name).where(F.col(name) < threshold).drop(name)
