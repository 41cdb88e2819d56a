"""Group-wise splits found by search over group and label counts, folds, and threshold tuning.

The search looks at one row per group and label, not at rows. Its trials are orders of the groups by
hash, cut and judged in Spark, by one rule whatever the number of groups; only sums of dice ranges and
the best trial are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .learning import dice


def _die(seed: int) -> Column:
    """A number below 2^62 for each group and trial."""
    return F.shiftrightunsigned(F.xxhash64("group", F.lit(seed), "trial"), 2)


def _cuts(counts: DataFrame, share: float, trials: int, seed: int) -> list[int]:
    """For each trial the die below which the groups fill the share, one group at least and never all; none for fewer than two groups.

    Each round cuts the range that the trial's cut lies in by 1024, so that as many sums are gathered for a trial."""
    sizes = counts.groupBy("group").agg(F.sum("n").alias("n"))
    total, groups = sizes.agg(F.sum("n"), F.count("*")).first()
    if groups < 2:
        return []
    dealt = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("die", _die(seed))
    low, room, taken, shift, above = [0] * trials, [total * share] * trials, [0] * trials, 62, 62
    while True:
        above, shift = shift, max(0, shift - 10)
        offset = F.col("die") - F.element_at(F.array(*(F.lit(x).cast("long") for x in low)), F.col("trial") + 1)
        inside = dealt.withColumn("offset", offset).where(F.col("offset").between(0, (1 << above) - 1))
        sums = inside.groupBy("trial", F.shiftright("offset", shift).alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("die").alias("first"))
        found: dict[int, Row] = {}
        for r in sorted(sums.collect(), key=lambda r: (r.trial, r.place)):
            if r.trial in found:
                continue
            if r.n > room[r.trial]:
                found[r.trial] = r
                low[r.trial] += r.place << shift
            else:
                room[r.trial] -= r.n
                taken[r.trial] += r.k
        if shift == 0 or all(r.k == 1 for r in found.values()):
            return [found[t].first + (taken[t] == 0) for t in range(trials)]


def search_split(counts: DataFrame, share: float, trials: int, seed: int) -> Column:
    """Whether a group goes to the smaller side: of `trials` orders of the groups by hash, each filled up to its share, the one that fits best, the first on ties.

    counts has n rows for each group and label. A trial fits by the labels with rows enough for the side that it lacks,
    and then by Pearson's statistic of its label counts against their shares."""
    cuts = _cuts(counts, share, trials, seed)
    if not cuts:
        return F.lit(False)
    own = F.element_at(F.array(*(F.lit(x).cast("long") for x in cuts)), F.col("trial") + 1)
    dealt = counts.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    sides = dealt.groupBy("trial", "label").agg(F.sum(F.when(_die(seed) < own, F.col("n")).otherwise(0)).alias("side"), (F.sum("n") * share).alias("expected"))
    lacks = F.count_if((F.col("side") == 0) & (F.col("expected") >= 1))
    # Rounded, so that the order in which Spark adds does not choose between equal trials.
    unlike = F.round(F.sum((F.col("side") - F.col("expected")) ** 2 / F.greatest("expected", F.lit(1.0))), 6)
    best = sides.groupBy("trial").agg(lacks.alias("lacks"), unlike.alias("unlike")).orderBy("lacks", "unlike", "trial").first().trial
    return F.shiftrightunsigned(F.xxhash64("group", F.lit(seed), F.lit(best)), 2) < F.lit(cuts[best]).cast("long")


def searched_split(rows: DataFrame, group: str, label: str, test: float = 0.1, validation: float = 0.125, trials: int = 64, seed: int = 0) -> DataFrame:
    """rows with `split`: whole groups in train, validation or test, labels as even as the search finds them; rows without a group are for training."""
    counts = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    counts = counts.persist()
    first = search_split(counts, test, trials, seed)
    second = search_split(counts.where(~first), validation, trials, seed + 1)
    sides = counts.select("group").distinct().select(F.col("group").alias(group), F.when(first, "test").when(second, "validation").alias("split"))
    return rows.join(sides.where("split IS NOT NULL"), group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_within(rows: DataFrame, outer: str, serial: str, test: float = 0.1, validation: float = 0.125, seed: int = 0) -> DataFrame:
    """Splits by serial inside every outer group, so that all outer groups are on all sides; a group of one serial is for training.

    Serials are ranked by dice; at least one goes to each side that has a share, where there are enough."""
    serials = rows.select(outer, serial).distinct()
    by = Window.partitionBy(outer)
    placed = serials.withColumns({"k": F.row_number().over(by.orderBy(dice(F.col(outer), F.col(serial), F.lit(seed)), serial)), "n": F.count("*").over(by)})
    tests = F.greatest(F.lit(1), F.round(F.col("n") * test))
    checks = F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.round((F.col("n") - tests) * validation))).otherwise(0)
    named = placed.withColumn("split", F.when(F.col("n") < 2, "train").when(F.col("k") <= tests, "test").when(F.col("k") <= tests + checks, "validation").otherwise("train"))
    return rows.join(named.select(outer, serial, "split"), [outer, serial])


def tuned_thresholds(scores: DataFrame, names: Sequence[str], ok: str, start: Sequence[float], grid: Sequence[float], rounds: int = 2) -> list[float]:
    """One threshold per class by coordinate search for the best macro F1; on ties the one nearest to the current.

    scores has `truth` and the array `scores`. Rows are reduced once to counts over (truth, class of the highest score,
    how many grid values lie below that score), which is all that any threshold can see."""
    place = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    levels = F.size(F.filter(F.array(*(F.lit(float(g)) for g in grid)), lambda g: g < F.array_max("scores")))
    seen = scores.groupBy("truth", place.alias("place"), levels.alias("level")).agg(F.count("*").alias("n")).collect()
    ordered, index = sorted(grid), {n: k for k, n in enumerate(names)}

    def macro(limits: list[float]) -> float:
        matrix = np.zeros((len(names), len(names)))
        for r in seen:
            above = r.level > ordered.index(limits[r.place])
            matrix[index[r.truth], r.place if above else index[ok]] += r.n
        hit, claimed, real = np.diag(matrix), matrix.sum(0), matrix.sum(1)
        return float(np.mean(np.where(claimed + real > 0, 2 * hit / np.maximum(claimed + real, 1), 0)))

    current = [min(ordered, key=lambda g, s=s: abs(g - s)) for s in start]
    for _ in range(rounds):
        for k in range(len(names)):
            tried = [(macro([*current[:k], g, *current[k + 1 :]]), -abs(g - current[k]), g) for g in ordered]
            current[k] = max(tried)[2]
    return current
