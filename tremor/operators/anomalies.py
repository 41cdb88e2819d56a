"""Anomalies without labels: scores of signals, suggestions for reviewers, isolation forests.

An isolation forest is grown from samples of fixed size, one group of at most `sample` rows for each tree, and is at
most trees * (2 * sample - 1) nodes, which is the bound of what is broadcast. Rows are scored where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..sources.shared import settle
from .ranks import numbered

NODES = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"
#: Euler's constant, in the mean depth of a search that fails.
EULER = 0.5772156649015329
#: The largest confidence of a suggestion, its start, and its growth above the limit.
MOST, START, GROWTH = 0.95, 0.5, 0.05


def signal_scores(x: Column) -> Column:
    """struct(rms, kurtosis, crest) of a signal: kurtosis above the normal one, 0 for three values or fewer; null for no signal."""
    rms = A.rms(x)
    excess = F.when(F.size(x) > 3, A.kurtosis(x, A.mean(x)) - 3).otherwise(0.0)
    crest = F.when(rms > 0, A.crest(x)).otherwise(0.0)
    return F.when(F.size(x) > 0, F.struct(F.round(rms, 5).alias("rms"), F.round(excess, 3).alias("kurtosis"), F.round(crest, 3).alias("crest")))


def suggestion(kurtosis: Column, limit: float, reason: str) -> Column:
    """struct(reason_key, confidence, note) where a signal's kurtosis reaches the limit, else null."""
    confidence = F.least(F.lit(MOST), START + (kurtosis - limit) * GROWTH)
    note = F.concat(F.lit("task:tick_proposal kurt="), F.format_string("%.2f", kurtosis))
    return F.when(kurtosis >= limit, F.struct(F.lit(reason).alias("reason_key"), F.round(confidence, 2).alias("confidence"), note.alias("note")))


def mean_depth(n: int) -> float:
    """How deep a search tree of n values is, on average, where a search fails."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def sampled(rows: DataFrame, features: Sequence[str], key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, key, x): for each tree the `sample` rows of least hash, all rows if there are fewer.

    Rows offer themselves to a tree by chance, a little more often than needed, so few are ranked."""
    n = rows.count()
    chance = min(1.0, (sample + 8 * math.sqrt(sample) + 16) / max(n, 1))
    hashed = lambda t: F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), t), 11) / float(1 << 53)
    values = F.array(*(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features))
    offered = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), hashed(t).alias("die"))), lambda o: o.die < chance)
    dealt = rows.select(F.col(key).alias("key"), values.alias("x"), F.explode(offered).alias("o")).select("o.tree", "o.die", "key", "x")
    return dealt.withColumn("_k", F.row_number().over(Window.partitionBy("tree").orderBy("die", "key"))).where(F.col("_k") <= sample).select("tree", "key", "x")


def isolation_forest(rows: DataFrame, features: Sequence[str], key: str, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """The nodes of a forest of random cuts; missing values count as 0. Leaves have no cut, and the rows that they hold."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        pdf = pdf.sort_values("key")
        data, rng, out = np.stack(pdf.x.to_list()), np.random.default_rng([seed, tree]), []
        deepest = math.ceil(math.log2(max(len(data), 2)))
        left = [(0, np.arange(len(data)), 0)]
        count = 1
        while left:
            node, inside, depth = left.pop()
            low, high = data[inside].min(0), data[inside].max(0)
            usable = np.flatnonzero(high > low)
            if depth >= deepest or not len(usable):
                out.append((tree, node, -1, 0.0, -1, -1, len(inside), depth))
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            small = data[inside, feature] <= cut
            if small.all():
                cut = float(low[feature])
                small = data[inside, feature] <= cut
            out.append((tree, node, feature, cut, count, count + 1, len(inside), depth))
            left += [(count, inside[small], depth + 1), (count + 1, inside[~small], depth + 1)]
            count += 2
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    return sampled(rows, features, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODES)


def isolated(rows: DataFrame, nodes: DataFrame, features: Sequence[str], sample: int = 256) -> DataFrame:
    """rows with `anomaly_score` in (0, 1]: 2 to the minus mean depth of a row over the depth that is usual; higher is stranger."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    forest = [tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth", "size")) for _, t in table.groupby("tree")]
    extra = [np.array([mean_depth(int(s)) for s in t[5]]) + t[4] for t in forest]
    usual = mean_depth(min(sample, int(table[table.node == 0]["size"].max()))) if len(table) else 0.0
    shared = rows.sparkSession.sparkContext.broadcast((forest, extra))
    names = list(features)
    out = rows.select("*", F.array(*(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in names)).alias("_x"))

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=float)
        data, total = np.stack(xs.to_list()), np.zeros(len(xs))
        for (feature, cut, left, right, _, _), depth in zip(*shared.value, strict=True):
            at = np.zeros(len(data), np.int64)
            while (inner := feature[at] >= 0).any():
                here = at[inner]
                small = data[inner, feature[here]] <= cut[here]
                at[inner] = np.where(small, left[here], right[here])
            total += depth[at]
        return pd.Series(2.0 ** (-total / len(shared.value[0]) / usual) if usual else np.ones(len(data)))

    return out.withColumn("anomaly_score", score("_x")).drop("_x")


def for_normal_fit(rows: DataFrame, label: str, normal: str, key: str) -> DataFrame:
    """rows of splits for a fit on normal rows alone: half of the training anomalies, in order of key, go to validation, the others to test."""
    odd = F.coalesce((F.col("split") == "train") & (F.col(label) != normal), F.lit(False))
    ranked = numbered(rows.where(odd), [key], "_k")
    half = ranked.count() // 2
    moved = ranked.withColumn("split", F.when(F.col("_k") < half, "validation").otherwise("test")).select(rows.columns)
    return rows.where(~odd).union(moved)


def anomaly_run(rows: DataFrame, features: Sequence[str], label: str, normal: str, key: str, contamination: float | None = None, threshold: float = 0.0, normal_only: bool = True, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """rows of splits with decision (above the threshold: normal) and whether they are taken for anomalies.

    The decision is 0.5 less the score, or less the score that this share of the fitted rows exceeds."""
    placed = for_normal_fit(rows, label, normal, key) if normal_only else rows
    fit = placed.where("split = 'train'")
    nodes = settle(isolation_forest(fit, features, key, trees, sample, seed))
    scored = isolated(placed, nodes, features, sample)
    offset = 0.5 if contamination is None else scored.where("split = 'train'").agg(F.percentile_approx("anomaly_score", 1 - contamination, 100_000)).first()[0]
    decision = F.lit(offset) - F.col("anomaly_score")
    return scored.withColumns({"decision": decision, "anomaly": decision <= threshold, "truth": F.col(label) != normal})
