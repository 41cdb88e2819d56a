"""Samples of bounded size that keep labels in proportion or in balance, and label columns as models take them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import dice
from .ranks import drawn


def _any(rows: DataFrame, size: int, key: str, seed: int) -> DataFrame:
    """size rows of least dice of the whole table, all if it is smaller."""
    one = rows.withColumn("_one", F.lit(0))
    return drawn(one, "_one", dice(F.col(key), F.lit(seed)), key, lambda n: F.lit(size)).where("_in").drop("_in", "_all", "_one")


def stratified(rows: DataFrame, label: str, size: int, key: str, seed: int = 0) -> DataFrame:
    """At most size rows, each label with its share rounded up, one row at least; the sum over size is drawn down by other dice.

    A size of 0 or less, or a smaller table, gives all rows. Rows without a label are left out of a sample."""
    total = rows.count() if size > 0 else 0
    if total <= size or size <= 0:
        return rows
    share = drawn(rows.where(F.col(label).isNotNull()), label, dice(F.col(key), F.lit(seed)), key, lambda n: F.greatest(F.lit(1), F.ceil(F.lit(size) * n / F.lit(total))))
    return _any(share.where("_in").drop("_in", "_all"), size, key, seed + 1)


def balanced(rows: DataFrame, label: str, size: int, key: str, seed: int = 0) -> DataFrame:
    """size rows, the same number of each label (null is one); what small labels leave is filled from the rest of the others."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    labels, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    if size <= 0 or total <= size:
        return rows
    quota = max(1, size // max(1, labels))
    first = drawn(rows, label, dice(F.col(key), F.lit(seed)), key, lambda n: F.lit(quota)).drop("_all")
    picked = counts.agg(F.sum(F.least("n", F.lit(quota)))).head()[0]
    if picked > size:
        return _any(first.where("_in").drop("_in"), size, key, seed + 1)
    rest = _any(first.where(~F.col("_in")).drop("_in"), size - picked, key, seed + 1)
    return first.where("_in").drop("_in").unionByName(rest)


def remainder_to_test(rows: DataFrame, label: str, targets: Mapping[str, int], key: str, seed: int = 0) -> DataFrame:
    """Training rows beyond their label's target go to test; labels without a target, or of -1, stay whole. Other splits stay."""
    train, others = rows.where("split = 'train'"), rows.where("split <> 'train'")
    wanted = F.lit(-1)
    for name, target in targets.items():
        wanted = F.when(F.col(label) == name, target).otherwise(wanted)
    placed = drawn(train, label, dice(F.col(key), F.lit(seed)), key, lambda n: F.when(wanted >= 0, wanted).otherwise(n))
    return placed.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in", "_all").unionByName(others)


def mapped_labels(rows: DataFrame, reason_id: str, classes: Mapping[int, int]) -> DataFrame:
    """rows with `label`, the class of their reason's number; text that is no number and reasons without a class are left out."""
    number = F.col(reason_id).cast("string").try_cast("double")
    names = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    label = F.try_element_at(names, F.when((number == F.floor(number)) & (F.abs(number) < 2**31), number).cast("int"))
    return rows.withColumn("label", label).where("label IS NOT NULL")


def aligned_scores(scores: Column, classes: Sequence[int], labels: Sequence[int]) -> Column:
    """Scores of a model's classes in the order of labels, 0 for labels that the model does not know."""
    return F.array(*(F.element_at(scores, list(classes).index(k) + 1) if k in classes else F.lit(0.0) for k in labels))


def crosstab(rows: DataFrame, group: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Rows per group and label, labels as columns."""
    return rows.groupBy(group).pivot(label, list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))


def length_target(rows: DataFrame, signal: str, share: float = 0.95) -> DataFrame:
    """The length that the share of signals does not exceed, whole and at least 1; no row where there are no signals."""
    sizes = rows.where(F.col(signal).isNotNull()).select(F.size(signal).alias("n"))
    return sizes.agg(F.percentile("n", F.lit(share)).alias("p")).where("p IS NOT NULL").select(F.greatest(F.lit(1), F.floor("p").cast("int")).alias("length"))


def feature_group(feature: Column) -> Column:
    """The family of a feature by its name."""
    named = F.when(F.startswith(feature, F.lit("mel_band_")), "mel_band").when(F.startswith(feature, F.lit("mel_shock_")), "mel_shock").when(F.startswith(feature, F.lit("dwt_")), "dwt")
    timed = feature.isin("mean", "time_std", "duration") | F.startswith(feature, F.lit("time_"))
    return named.when(timed, "time").when(F.contains(feature, F.lit("_")), F.substring_index(feature, "_", 1)).otherwise("other")


def group_summary(ranking: DataFrame, top: int = 20) -> DataFrame:
    """Per family its features, how many are among the best, and their importance. ranking: feature, place (from 1), importance, score."""
    return ranking.groupBy(feature_group(F.col("feature")).alias("family")).agg(
        F.count("*").alias("features"), F.count_if(F.col("place") <= top).alias("among_top"), F.avg("importance").alias("mean_importance"), F.sum("importance").alias("sum_importance"), F.min("score").alias("best_score")
    )
