"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the byte n-grams of 4 to 6 bytes of the text's words (A-Z in lower case, joined by single
spaces), hashed into 2^20 places; a document has a feature or not. Spark counts, over all labelled
training documents, how many toxic and other documents have each feature. Its log-count ratio
r = log((toxic + a * share) / (other + a * (1 - share))) - log(all toxic / all other), with `prior`
pseudo-documents a dealt by class, is 0 without evidence; features below `least_ratio` are left out.
A logistic regression over r * x, with ridge penalty, is fitted on about `fit_rows` training documents
of either class (4 * fit_rows rows at most), chosen by hash; weights make up for that choice.

Defined results. A null or empty text has no features and gets the intercept's score. Labels that are
null are no labels; several labels of one document count once each. Without documents of both classes
to learn from every score is the share of toxic training labels (0 if there are none). Extra columns
are ignored; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import carried, unpacked
from .common import bounded_batches, fold_of, stored
from .kernels import U64, Words, byte_rolling, lower, mix, pieces

#: log2 of the number of hashed features.
BITS = 20
ORDERS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once, ordered by document."""
    words = Words(lower(data), offsets)
    joined, begins = words.joined()
    n = len(words.counts)
    # A space before each text's first word, then the words with a space behind each.
    ends = begins[words.first]
    spaced = np.insert(joined, ends[:-1], 0x20)
    starts = ends[:-1] + np.arange(n)
    stops = ends[1:] + np.arange(n) + 1
    hashes = byte_rolling(spaced)
    every = [(mix(hashes.every(order)) >> U64(64 - BITS)).astype(np.int32) for order in ORDERS]
    # Of each feature in a document the last occurrence counts: the one whose number stays in the feature's slot.
    slot = np.zeros(1 << BITS, np.int32)
    number = np.arange(len(ORDERS) * int((stops - starts).max(initial=0)), dtype=np.int32)
    found = [np.zeros(0, np.int32)]
    for a, z in zip(starts.tolist(), stops.tolist(), strict=True):
        own = np.concatenate([x[a : max(a, z - order + 1)] for x, order in zip(every, ORDERS, strict=True)])
        mine = number[: len(own)]
        slot[own] = mine
        found.append(own[slot[own] == mine])
    sizes = np.fromiter(map(len, found[1:]), np.int64, n)
    return np.repeat(np.arange(n), sizes), np.concatenate(found)


@dataclass
class Model:
    """weights: for each feature its ratio times its fitted weight."""

    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = features(data, offsets)
        z = np.bincount(doc, self.weights[feature], len(offsets) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def counts(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, other): documents with each feature, of (packed, label) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for rows, data, offsets in pieces(unpacked(batches)):
            label = rows.column("label").to_numpy(zero_copy_only=False)
            doc, feature = features(data, offsets)
            for k in (0, 1):
                sums[k] += np.bincount(feature[label[doc] == k], minlength=1 << BITS)
        seen = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[1, seen]), pa.array(sums[0, seen])], ["feature", "toxic", "other"])

    return labelled.select("packed", "label").mapInArrow(run, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def logistic(ends: np.ndarray, feature: np.ndarray, ratio: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression by adaptive gradient steps, on documents in blocks.

    Document i has the features feature[ends[i] : ends[i + 1]]; the value of a feature is its ratio."""
    size = len(ratio)
    w, seen = np.zeros(size), np.zeros(size)
    share = float(np.average(label, weights=weight))
    b, b_seen = np.log(share / (1 - share)), 0.0
    weight = weight / weight.sum()
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)), [0, len(label)]))
    for _ in range(rounds):
        slope, b_slope, scaled = np.zeros(size), 0.0, ratio * w
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = feature[ends[first] : ends[last]]
            row = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
            z = np.bincount(row, scaled[own], last - first) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[first:last]) * weight[first:last]
            slope += np.bincount(own, error[row], size)
            b_slope += error.sum()
        slope = slope * ratio + ridge * w
        seen += slope**2
        b_seen += b_slope**2
        w -= 0.05 * slope / np.sqrt(seen + 1e-12)
        b -= 0.2 * b_slope / np.sqrt(b_seen + 1e-12)
    return w, b


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, packed, label) of the documents that known has a label for, written once for all passes of a fit."""
    return stored(carried(docs, known).join(known, "doc_id"), "labelled")


def fit(labelled: DataFrame, prior: float = 20.0, least_ratio: float = 1.0, fit_rows: int = 2000, ridge: float = 1e-5, rounds: int = 80) -> Model:
    """The model of (doc_id, packed, label) rows; gathers 2^20 counts and 4 * fit_rows documents' features at most."""
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    zero = np.zeros(1 << BITS)
    if not toxic or not other:
        share = toxic / max(toxic + other, 1)
        return Model(zero, np.log(share / (1 - share)) if 0 < share < 1 else (500.0 if share else -500.0))
    share = toxic / (toxic + other)
    ratio = zero.copy()
    for table in counts(labelled).toArrow().to_batches():
        have = np.log((table.column("toxic").to_numpy() + prior * share) / (table.column("other").to_numpy() + prior * (1 - share))) - np.log(toxic / other)
        ratio[table.column("feature").to_numpy()] = np.where(np.abs(have) >= least_ratio, have, 0)
    chosen = np.flatnonzero(ratio)
    place_of = np.full(1 << BITS, -1, np.int32)
    place_of[chosen] = np.arange(len(chosen), dtype=np.int32)
    shared = labelled.sparkSession.sparkContext.broadcast(place_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(unpacked(batches)):
            doc, feature = features(data, offsets)
            at = shared.value[feature]
            hit = at >= 0
            ends = np.zeros(rows.num_rows + 1, np.int32)
            np.cumsum(np.bincount(doc[hit], minlength=rows.num_rows), out=ends[1:])
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit]))], ["label", "features"])

    # About fit_rows of either class, by hash; the limit only guards against rows that repeat without end.
    place = F.pmod(F.xxhash64("doc_id", "packed"), F.lit(1 << 30))
    part = F.when(F.col("label") == 1, F.lit(min(1.0, fit_rows / toxic))).otherwise(F.lit(min(1.0, fit_rows / other)))
    sample = labelled.where(place < part * float(1 << 30)).select("packed", "label")
    rows = sample.mapInArrow(run, "label int, features array<int>").limit(4 * fit_rows).toArrow()
    label = rows.column("label").to_numpy().astype(np.float64)
    if not 0 < label.sum() < len(label):
        return Model(zero, np.log(share / (1 - share)))
    lists = rows.column("features").combine_chunks()
    ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64))
    weight = np.where(label == 1, toxic / label.sum(), other / (1 - label).sum())
    w, b = logistic(ends, lists.flatten().to_numpy(), ratio[chosen], label, weight, ridge, rounds)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = ratio[chosen] * w
    return Model(weights, float(b))


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with a column score; docs has doc_id and text, and any columns besides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(shared.value.score(data, offsets))], [*kept, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document; rows of the held fold teach nothing."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = F.coalesce(fold_of("doc_id", folds) == held, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)").where(~fold)
    model = fit(labelled_texts(docs, known), **options)
    return apply(docs.select("doc_id", fold.alias("held_out"), "text"), model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
