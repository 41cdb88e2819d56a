"""Training runs with Spark ML: forests and boosted trees, grids and folds, several seeds, decisions by tuned thresholds.

Every fit is a Spark job over the whole table; the driver only loops over parameters, folds, classes and seeds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .learning import class_weights, decided
from .prediction import best_seeds, split_metrics
from .splits import tuned_thresholds

#: Ways to train, folds of cross runs and of grids.
MODES, CROSS_FOLDS, GRID_FOLDS = ("normal", "cross", "grid"), 5, 3
FOREST, BOOSTED = "random_forest", "boosted_trees"


def vectors(rows: DataFrame, features: Sequence[str], names: Sequence[str], label: str = "label") -> DataFrame:
    """rows with `_v`, their features, and `_y`, the place of their label among names; missing values count as 0."""
    index = F.element_at(F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, float(k)))), F.col(label))
    plain = rows.select("*", *(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{k}") for k, f in enumerate(features)))
    made = VectorAssembler(inputCols=[f"_x{k}" for k in range(len(features))], outputCol="_v").transform(plain)
    return made.select(*rows.columns, "_v", index.alias("_y"))


def fit_scores(train: DataFrame, rows: DataFrame, names: Sequence[str], kind: str = FOREST, params: Mapping[str, Any] | None = None, seed: int = 0, label: str = "label") -> DataFrame:
    """rows with `scores` in the order of names, by a model of the training rows, labels weighed alike; both as `vectors` gives them.

    Boosted trees part each label from all others, and their chances are scaled to a sum of 1; labels without training rows score 0."""
    params = dict(params or {})
    weighed = train.join(class_weights(train, label).withColumnRenamed("weight", "_w"), label).select("_v", "_y", "_w")
    if kind == FOREST:
        model = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", seed=seed, **params).fit(weighed)
        scored = model.transform(rows).withColumn("scores", vector_to_array("probability"))
        padded = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda k: F.coalesce(F.try_element_at("scores", k), F.lit(0.0)))
        return scored.select(*rows.columns, padded.alias("scores"))
    if kind != BOOSTED:
        raise ValueError(f"no such model: {kind}")
    weighed = settle(weighed)
    present = sorted(int(r[0]) for r in weighed.select("_y").distinct().collect())
    if len(present) == 1:
        return rows.withColumn("scores", F.array(*(F.lit(1.0 if k == present[0] else 0.0) for k in range(len(names)))))
    out, chances = rows, {}
    for k in present[1:] if len(present) == 2 else present:
        model = GBTClassifier(featuresCol="_v", labelCol="_t", weightCol="_w", seed=seed, predictionCol="_d", **params).setRawPredictionCol("_r").setProbabilityCol("_p")
        fitted = model.fit(weighed.withColumn("_t", (F.col("_y") == k).cast("double")))
        out = fitted.transform(out).withColumn(f"_c{k}", vector_to_array("_p")[1]).drop("_r", "_p", "_d")
        chances[k] = F.col(f"_c{k}")
    if len(present) == 2:
        chances[present[0]] = 1 - chances[present[1]]
    total = sum(chances.values(), F.lit(0.0))
    even = F.lit(1.0 / len(present))
    scores = F.array(*(F.when(total > 0, chances[k] / total).otherwise(even) if k in chances else F.lit(0.0) for k in range(len(names))))
    return out.select(*rows.columns, scores.alias("scores"))


def _measured(scored: DataFrame, keys: Sequence[str], names: Sequence[str], thresholds: Sequence[float], ok: str, label: str) -> DataFrame:
    return split_metrics(scored.withColumn("_predicted", decided(F.col("scores"), names, thresholds, ok)), keys, label, "_predicted", "scores", names, ok)


def cross_run(rows: DataFrame, features: Sequence[str], names: Sequence[str], ok: str, kind: str = FOREST, params: Mapping[str, Any] | None = None, seed: int = 0, label: str = "label", fold: str = "fold") -> DataFrame:
    """rows with the scores of the model that has not seen their fold."""
    made, out = settle(vectors(rows, features, names, label)), None
    for f in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        one = fit_scores(made.where(F.col(fold) != f), made.where(F.col(fold) == f), names, kind, params, seed, label)
        out = one if out is None else out.union(one)
    return out.drop("_v", "_y")


def grid_run(rows: DataFrame, features: Sequence[str], names: Sequence[str], ok: str, grid: Mapping[str, Sequence[Any]], kind: str = FOREST, seed: int = 0, label: str = "label", fold: str = "fold") -> tuple[dict[str, Any], list[tuple[dict[str, Any], float]]]:
    """The parameters with the best mean macro F1 over the folds, the first of equal ones, and what each of them reached."""
    made, found = settle(vectors(rows, features, names, label)), []
    nothing = [0.0] * len(names)
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    for values in product(*grid.values()):
        params, every = dict(zip(grid, values, strict=True)), None
        for f in folds:
            one = fit_scores(made.where(F.col(fold) != f), made.where(F.col(fold) == f), names, kind, params, seed, label)
            every = one if every is None else every.union(one)
        metrics = _measured(every, [fold], names, nothing, ok, label)
        found.append((params, round(metrics.agg(F.avg("f1_macro")).first()[0], 9)))
    best = max(range(len(found)), key=lambda k: (found[k][1], -k))
    return found[best][0], found


def seed_runs(rows: DataFrame, features: Sequence[str], names: Sequence[str], ok: str, seeds: Sequence[int], kind: str = FOREST, params: Mapping[str, Any] | None = None, start: Sequence[float] | None = None, steps: Sequence[float] | None = None, label: str = "label") -> tuple[DataFrame, dict[int, list[float]], DataFrame]:
    """One run per seed on rows with a `split`: fit, thresholds tuned on validation, metrics of every split.

    Returns the metrics by seed and split, the thresholds by seed, and all rows with scores, decision and seed."""
    made, tuned, measured, every = settle(vectors(rows, features, names, label)), {}, None, None
    for seed in dict.fromkeys(seeds):
        scored = settle(fit_scores(made.where("split = 'train'"), made, names, kind, params, seed, label).drop("_v", "_y").withColumn("seed", F.lit(seed)))
        limits = list(start or [0.0] * len(names))
        if steps:
            limits = tuned_thresholds(scored.where("split = 'validation'").select(F.col(label).alias("truth"), "scores"), names, ok, limits, steps)
        tuned[seed] = limits
        one = scored.withColumn("predicted", decided(F.col("scores"), names, limits, ok))
        every = one if every is None else every.union(one)
    measured = split_metrics(every, ["seed", "split"], label, "predicted", "scores", names, ok)
    return measured, tuned, every


def best_run(metrics: DataFrame) -> int:
    """The seed whose run lets fewest bad parts pass in validation, then finds most of them, then has the best F1."""
    return best_seeds(metrics).first()["seed"]
