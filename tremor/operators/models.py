"""Training with Spark ML: one fit per seed, decisions by thresholds, reports and lists for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learning import class_metrics, class_weights, confusion, decided


def predictions(rows: DataFrame, features: Sequence[str], names: Sequence[str], seed: int, trees: int = 20, depth: int = 5) -> DataFrame:
    """rows with `scores` in the order of names and `seed`; a balanced random forest learns from split train.

    rows: a `label` among names, a `split` and the feature columns; missing values count as 0."""
    index = F.element_at(F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, float(k)))), F.col("label"))
    weights = class_weights(rows.where("split = 'train'"), "label")
    plain = rows.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features}).withColumn("_y", index)
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(plain)
    train = vectors.where("split = 'train'").join(weights.withColumnRenamed("weight", "_w"), "label").select("_v", "_y", "_w")
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
    scored = model.transform(vectors).withColumn("scores", vector_to_array("probability"))
    padded = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda k: F.coalesce(F.try_element_at("scores", k), F.lit(0.0)))
    return scored.withColumn("scores", padded).withColumn("seed", F.lit(seed)).select(*rows.columns, "scores", "seed")


def report(scored: DataFrame, names: Sequence[str], thresholds: Sequence[float], ok: str) -> DataFrame:
    """Per seed and split the accuracy and macro F1 of the decisions."""
    rows = scored.withColumn("predicted", decided(F.col("scores"), names, thresholds, ok))
    out = None
    for seed, split in ((r.seed, r.split) for r in rows.select("seed", "split").distinct().collect()):
        part = rows.where((F.col("seed") == seed) & (F.col("split") == split))
        macro = class_metrics(confusion(part, "label", "predicted"), "label", "predicted").agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("rows"))
        right = part.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
        one = macro.crossJoin(right).select(F.lit(seed).alias("seed"), F.lit(split).alias("split"), "rows", "accuracy", "macro_f1")
        out = one if out is None else out.union(one)
    return out


def misclassified(scored: DataFrame, names: Sequence[str], thresholds: Sequence[float], ok: str) -> DataFrame:
    """Wrong decisions with the scores of the true and the decided class, the widest gap first."""
    at = lambda c: F.element_at("scores", F.array_position(F.array(*(F.lit(n) for n in names)), F.col(c)).cast("int"))
    rows = scored.withColumn("predicted", decided(F.col("scores"), names, thresholds, ok)).where("label <> predicted")
    rows = rows.withColumns({"confidence": at("predicted"), "true_probability": at("label")})
    return rows.withColumn("score_gap", F.col("confidence") - F.col("true_probability")).orderBy(F.desc("score_gap"))


def for_review(errors: DataFrame, serial: str, top: int) -> DataFrame:
    """All wrong rows of the `top` serials whose worst row has the widest gap, ranked."""
    worst = errors.groupBy(serial).agg(F.max(F.struct("score_gap", "confidence", -F.col("true_probability"))).alias("w"))
    ranked = worst.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("w"), serial))).where(F.col("rank") <= top)
    return errors.join(ranked.select(serial, "rank"), serial)


def ranked_features(f_values: DataFrame, importances: DataFrame, weight: float = 0.5) -> DataFrame:
    """Features by a weighted mean of their ranks by F and by importance."""
    by = lambda c: F.percent_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col(c)))
    joined = f_values.join(importances, "feature")
    return joined.withColumn("score", weight * by("f") + (1 - weight) * by("importance")).orderBy(F.desc("score"), "feature")


def without_redundant(ranked: Sequence[str], pairs: Sequence[tuple[str, str, float]], least: int, limit: float = 0.95) -> list[str]:
    """Features in rank order, without those that a kept one correlates with; refilled in rank order up to least."""
    close = {frozenset(p[:2]) for p in pairs if abs(p[2]) >= limit}
    kept: list[str] = []
    for f in ranked:
        if not any(frozenset((f, k)) in close for k in kept):
            kept.append(f)
    return kept + [f for f in ranked if f not in kept][: max(0, least - len(kept))]
