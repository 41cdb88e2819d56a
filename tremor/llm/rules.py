"""Quality by a sparse rule ensemble over text statistics.

Statistics of every text are computed once. A random forest on the labelled training rows gives trees;
every path from a root to a node is a conjunction of conditions on statistics. A lasso logistic
regression over these rules (1 where a rule holds) keeps few of them, and the kept rules with their
weights are compiled into one Spark column expression, which scores all documents.

Both models are fitted by Spark ML on all labelled training rows, which hold statistics only.

Defined results. A null or empty text has statistics 0 (and 1 for the share of distinct words). Null
labels are none; several labels of one document count each. Without two classes to learn from, the
score is the share of good training labels (1 if there are none). Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold_of, settle
from .kernels import U64, Words, mix, pieces
from .perplexity import statistics

STATISTICS = ("words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "loud_share", "bar_share", "duplicate_lines", "repeat_share", "distinct_share", "short_share", "top_share", "line_words", "far_share")

_IN = {
    "upper": bytes(range(65, 91)),
    "letters": bytes([*range(65, 91), *range(97, 123)]),
    "digits": b"0123456789",
    "marks": b".,;:?!\"'()-",
    "loud": b"!",
    "bar": b"|",
    "lines": b"\n",
    "far": bytes(range(0xC3, 0xF5)),
}
_TABLES = {}
for _name, _bytes in _IN.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][list(_bytes)] = True


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text, all finite."""
    n = len(offsets) - 1
    base = statistics(data, offsets)
    words = Words(data, offsets)
    count = base["n_words"].astype(np.float64)
    per = lambda x: x / np.maximum(count, 1)
    sums = {}
    for name, table in _TABLES.items():
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=run[1:])
        sums[name] = run[offsets[1:]] - run[offsets[:-1]]
    size = np.maximum(np.diff(offsets), 1)
    doc = words.doc_of()
    length = words.ends - words.starts
    key = np.sort(mix(words.hashes() + mix(doc.astype(U64))) >> U64(20) | (doc.astype(U64) << U64(44)))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    owner, times = (key[new] >> U64(44)).astype(np.int64), np.diff(np.append(new, len(key)))
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    return {
        "words": count,
        "word_length": per(base["word_chars"]),
        "symbol_share": per(base["n_symbols"]),
        "upper_share": sums["upper"] / np.maximum(sums["letters"], 1),
        "digit_share": sums["digits"] / size,
        "mark_share": per(sums["marks"]),
        "loud_share": per(sums["loud"]),
        "bar_share": per(sums["bar"]),
        "duplicate_lines": base["n_dup_lines"] / (sums["lines"] + 1),
        "repeat_share": per(base["n_repeat_words"]),
        "distinct_share": np.where(count > 0, per(np.bincount(owner, minlength=n)), 1.0),
        "short_share": per(np.bincount(doc[length <= 2], minlength=n)),
        "top_share": per(top),
        "line_words": count / (sums["lines"] + 1),
        "far_share": sums["far"] / size,
    }


def statistics_of(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, one column per statistic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            found = measured(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), *(pa.array(found[s]) for s in STATISTICS)], ["doc_id", "held_out", *STATISTICS])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction: for some statistics a value that they exceed, or that they do not exceed."""

    bounds: tuple[tuple[str, float, float], ...]  # (statistic, above, at most)

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, most in self.bounds:
            if above > -math.inf:
                out = out & (F.col(name) > above)
            if most < math.inf:
                out = out & (F.col(name) <= most)
        return out.cast("double")


def paths(printed: str) -> list[Rule]:
    """The distinct paths of a printed Spark ML tree ensemble, by its indented conditions."""
    found: dict[Rule, None] = {}
    stack: list[tuple[int, str, str, float]] = []
    for line in printed.splitlines():
        indent = len(line) - len(line.lstrip())
        match = re.search(r"\(feature (\d+) (<=|>) (\S+)\)", line)
        while stack and (stack[-1][0] >= indent or not line.strip() or "Tree " in line):
            stack.pop()
        if not match:
            continue
        stack.append((indent, STATISTICS[int(match[1])], match[2], float(match[3])))
        limits: dict[str, list[float]] = {}
        for _, name, sign, value in stack:
            own = limits.setdefault(name, [-math.inf, math.inf])
            own[0], own[1] = (own[0], min(own[1], value)) if sign == "<=" else (max(own[0], value), own[1])
        found[Rule(tuple((n, a, b) for n, (a, b) in sorted(limits.items())))] = None
    return list(found)


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self) -> Column:
        """The probability of a good text, from its statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.lit(weight) * rule.column()
        return 1 / (1 + F.exp(-z))


def fit(labelled: DataFrame, trees: int = 12, depth: int = 4, penalty: float = 0.001, seed: int = 11) -> Ensemble:
    """The ensemble of (statistics, label) rows."""
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good or not bad:
        return Ensemble([], 40.0 if good or not bad else -40.0)
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="v").transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(vectors.select("v", "label"))
    rules = paths(forest.toDebugString)
    if not rules:
        return Ensemble([], math.log(good / bad))
    tested = labelled.select(F.col("label").cast("double").alias("label"), F.array(*(r.column() for r in rules)).alias("a"))
    lasso = LogisticRegression(featuresCol="v", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=200).fit(settle(tested.select("label", array_to_vector("a").alias("v"))))
    return Ensemble([(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w], float(lasso.intercept))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document; rows of the held fold teach nothing."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = F.coalesce(fold_of("doc_id", folds) == held, F.lit(False))
    rows = settle(statistics_of(docs.select("doc_id", fold.alias("held_out"), "text")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)").where(~fold)
    model = fit(settle(rows.where("NOT held_out").join(known, "doc_id").drop("doc_id", "held_out")), **options)
    return rows.select("doc_id", "held_out", model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
