"""Sampling, splits without leakage, decisions, metrics and the audit of labels."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text
from .ranks import below, drawn, numbered


def dice(*key: Column) -> Column:
    """A number in [0, 1) that a key always gets, the same in every engine: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def downsampled(rows: DataFrame, label: str, target: int, key: str, seed: int = 0) -> DataFrame:
    """At most target rows of each label, those of least dice."""
    return drawn(rows, label, dice(F.col(key), F.lit(seed)), key, lambda n: F.lit(target)).where("_in").drop("_in", "_all")


def rebalanced(rows: DataFrame, label: str, target: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly target rows of each label: fewer are repeated in whole rounds, the rest by dice; `copies` says how often."""
    placed = drawn(rows, label, dice(F.col(key), F.lit(seed)), key, lambda n: F.lit(target) % n)
    copies = F.floor(F.lit(target) / F.col("_all")) + F.col("_in").cast("int")
    return placed.withColumn("copies", copies.cast("int")).where("copies > 0").drop("_in", "_all")


def rebalanced_to(rows: DataFrame, label: str, targets: Mapping[object, int], key: str, seed: int = 0, oversample: bool = True) -> DataFrame:
    """rows of the labels in targets with `copies`: all of a label whose target is below 0, so many of least dice of one that has more, and of one that has fewer all, and more of them by draws with replacement where that is allowed.

    Rows with 0 copies are what is left."""
    numbers = F.create_map(*(F.lit(x) for k, n in targets.items() for x in (str(k), n)))
    kept = rows.where(F.col(label).isin(list(targets))).withColumn("_die", dice(F.col(key), F.lit(seed)))
    ranked = numbered(kept, [label, "_die", key], "_at")
    sizes = ranked.groupBy(label).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumn("_target", numbers[F.col(label).cast("string")])
    draws = sizes.where((F.col("_target") > F.col("_n")) & F.lit(oversample)).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_target") - F.col("_n"), F.lit(1)))))
    place = F.col("_first") + F.floor(dice(F.col(label), F.col("_draw"), F.lit(seed)) * F.col("_n"))
    more = draws.groupBy(place.alias("_at")).agg(F.count("*").alias("_more"))
    out = ranked.join(sizes, label).join(more, "_at", "left")
    inside = (F.col("_target") < 0) | (F.col("_at") - F.col("_first") < F.col("_target"))
    return out.select(*rows.columns, (F.when(inside, 1).otherwise(0) + F.coalesce("_more", F.lit(0))).cast("int").alias("copies"))


def group_split(rows: DataFrame, group: str, test: float = 0.1, validation: float = 0.125, seed: int = 0) -> DataFrame:
    """train, validation or test for whole groups, by the group's dice; validation is a share of what test leaves."""
    d = dice(F.col(group), F.lit(seed))
    return rows.withColumn("split", F.when(d < test, "test").when(d < test + (1 - test) * validation, "validation").otherwise("train"))


def folds(rows: DataFrame, group: str, k: int = 5, seed: int = 0) -> DataFrame:
    return rows.withColumn("fold", F.floor(dice(F.col(group), F.lit(seed)) * k).cast("int"))


def split_overlap(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one split has; none, if the split holds."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def decided(scores: Column, names: Sequence[str], thresholds: Sequence[float], ok: str) -> Column:
    """The class of the highest score, first on ties, classes other than ok with thresholds of 1 or more left out; ok where its score is not above its threshold."""
    limits = F.array(*(F.lit(0.0 if n == ok else float(t)) for n, t in zip(names, thresholds, strict=True)))
    usable = F.transform(F.arrays_zip(scores.alias("s"), limits.alias("t")), lambda x: F.when(x["t"] < 1, x["s"]).otherwise(F.lit(-1.0)))
    place = F.array_position(usable, F.array_max(usable)).cast("int")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), place)
    return F.when(F.array_max(usable) <= pick([float(t) for t in thresholds]), F.lit(ok)).otherwise(pick(list(names)))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts, zero where nothing is counted."""
    both = matrix.select(F.col(truth).alias("label"), F.col("n").alias("support"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("claimed"))
    both = both.union(matrix.select(F.col(predicted), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("n")))
    sums = both.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "hit", "claimed")))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("label", "support", ratio("hit", "claimed").alias("precision"), ratio("hit", "support").alias("recall"), F.when(F.col("support") + F.col("claimed") > 0, 2 * F.col("hit") / (F.col("support") + F.col("claimed"))).otherwise(0.0).alias("f1"))


def quality_gate(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """The gate's rates for good (true) and bad parts; null where there are none to count."""
    n = lambda c: F.count_if(c)
    rate = lambda a, b: F.when(b > 0, a / b)
    return rows.agg(
        rate(n(truth & predicted), n(truth)).alias("ok_recall"),
        rate(n(~truth & ~predicted), n(~truth)).alias("nok_recall"),
        rate(n(~truth & ~predicted), n(~predicted)).alias("nok_precision"),
        n(~truth & predicted).alias("false_ok"),
        n(truth & ~predicted).alias("false_reject"),
    )


def auc(rows: DataFrame, group: str, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums with mean ranks on ties; counts per score come first, and ranks are dealt by score."""
    levels = rows.groupBy(group, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    won = below(levels, [group], score, "q").withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2))
    sums = won.groupBy(group).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(group, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("won") / (F.col("p") * F.col("q"))).alias("auc"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Rows over (classes times the class's rows)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(0))
    return counts.select(label, (F.sum("n").over(one) / (F.count("*").over(one) * F.col("n"))).alias("weight"))


def anova(rows: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """F statistic of each value column over the labels, from one pass of sums per label."""
    long = rows.select(label, F.explode(F.array(*(F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values))).alias("f")).select(label, "f.*").where("x IS NOT NULL")
    per = long.groupBy("feature", label).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = per.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = per.join(total.select("feature", "mean"), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2))).alias("between"))
    return total.join(between, "feature").select("feature", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def feature_quality(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Share of missing values, distinct values and variance per column, one pass."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values))).alias("f")).select("f.*")
    return long.groupBy("feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("nan_rate"), F.count_distinct("x").alias("nunique"), F.var_pop("x").alias("variance"))


def correlated_pairs(rows: DataFrame, values: Sequence[str], least: float) -> DataFrame:
    """Pairs of columns (a, b, r) whose correlation is at least that strong, each from the rows that have both columns.

    A task adds up products of its rows, about the columns' means, and sends one row per pair; pairs with fewer than two
    rows, or a column that is constant in them, have none."""
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    names, plain = list(values), rows.select(*(number(v).alias(f"_{k}") for k, v in enumerate(values)))
    means = plain.agg(*(F.avg(c) for c in plain.columns)).first()
    middle = np.array([0.0 if m is None else m for m in means])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(names), len(names)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) if batch.num_rows else np.zeros((0, len(names)))
            there = np.isfinite(x)
            x, m = np.where(there, x - middle, 0.0), there.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        a, b = np.triu_indices(len(names), 1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(s[a, b]) for s in sums)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    parts = plain.mapInArrow(products, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).where("n >= 2")
    spread = lambda a: F.col(a + a) - F.col(a) * F.col(a) / F.col("n")
    tiny = 1e-13 * F.greatest("xx", "yy")
    r = F.when((spread("x") > tiny) & (spread("y") > tiny), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread("x") * spread("y")))
    name = lambda c: F.element_at(F.array(*(F.lit(v) for v in names)), F.col(c).cast("int") + 1)
    return total.select(name("i").alias("a"), name("j").alias("b"), r.alias("r")).where(F.abs("r") >= least)


# Names of mistakes and priorities, limits, and the points of the score, in the three functions below.


def issue(truth: Column, predicted: Column, ok: int = 0) -> Column:
    """What kind of mistake a wrong decision is."""
    good, called = truth == ok, predicted == ok
    return F.when(~good & called, "false_ok_NOK_as_OK").when(good & ~called, "false_reject_OK_as_NOK").when(~good & ~called & (truth != predicted), "nok_type_confusion").otherwise("other_mismatch")


def priority(kind: Column, seeds: Column, confidence: Column) -> Column:
    sure = (seeds >= 2) | (confidence >= 0.9)
    false_ok = F.when(sure, "P0_critical_false_ok").otherwise("P1_false_ok")
    reject = F.when(sure, "P2_false_reject").otherwise("P3_false_reject_low_conf")
    return F.when(kind == "false_ok_NOK_as_OK", false_ok).when(kind == "false_reject_OK_as_NOK", reject).when(kind == "nok_type_confusion", "P3_nok_type_confusion").otherwise("P4_other")


def suspect_score(kind: Column, seeds: Column, confidence: Column, true_probability: Column, source: Column, note: Column) -> Column:
    """How much speaks for a wrong label: the kind of mistake, its repetition over seeds, sure decisions, sources that are no experts, fuzzy imports."""
    base = F.when(kind == "false_ok_NOK_as_OK", 100).when(kind == "false_reject_OK_as_NOK", 65).when(kind == "nok_type_confusion", 40).otherwise(20)
    text, of = F.coalesce(norm_text(note), F.lit("")), F.lower(F.coalesce(norm_text(source), F.lit("expert")))
    signs = (confidence >= 0.9, true_probability <= 0.05, of != "expert", F.contains(text, F.lit("fuzzy=")) | F.contains(text, F.lit("中等-")))
    bonus = sum((F.when(sign, 10).otherwise(0) for sign in signs), F.lit(0))
    return base + F.least(F.greatest(seeds - 1, F.lit(0)) * 10, F.lit(40)) + bonus


def exact_mean(value: Column) -> Column:
    """The mean of numbers, the same in whatever order they are added: sums of doubles differ in their last bit, which decides at a limit.

    Decimals of 18 places hold numbers below 10^10; a group with a NaN or a larger one has the mean of its doubles."""
    decimal = value.try_cast("decimal(28,18)")
    return F.when(F.count(decimal) == F.count(value), F.avg(decimal).cast("double")).otherwise(F.avg(value))


def audit(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wrong decisions of several seeds by sample, true and predicted class, with what they suggest.

    errors: keys, seed, truth, predicted, confidence, true_probability, source, note."""
    found = errors.where("truth <> predicted").groupBy(*keys, "truth", "predicted").agg(
        F.count_distinct("seed").alias("seeds"), exact_mean(F.col("confidence")).alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.min("true_probability").alias("min_true"), F.min("source").alias("source"), F.min("note").alias("note")
    )
    found = found.withColumn("issue", issue(F.col("truth"), F.col("predicted")))
    found = found.withColumn("priority", priority(F.col("issue"), F.col("seeds"), F.col("mean_confidence")))
    return found.withColumn("score", suspect_score(*(F.col(c) for c in ("issue", "seeds", "mean_confidence", "min_true", "source", "note"))).cast("long"))
