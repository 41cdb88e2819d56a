"""Runs of models and isolation forests on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tremor.operators import anomalies as A
from tremor.operators import runs as R

NAMES = ["OK", "noise", "tick"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(240):
        kind = rng.choices(NAMES, [5, 3, 2])[0]
        a, b = {"OK": (0, 0), "noise": (3, 0), "tick": (0, 3)}[kind]
        data.append((i, kind, rng.gauss(a, 0.8), rng.gauss(b, 0.8) if i % 17 else None, rng.random(), ["train", "train", "train", "validation", "test"][i % 5], i % 3))
    return spark.createDataFrame(data, "id long, label string, a double, b double, c double, split string, fold int").cache()


def test_boosted_trees_part_each_label(spark, rows):
    made = R.vectors(rows, ["a", "b"], NAMES).cache()
    params = {"maxIter": 4, "maxDepth": 3}
    got = {r["id"]: r["scores"] for r in R.fit_scores(made.where("split = 'train'"), made, NAMES, R.BOOSTED, params, seed=3).collect()}
    assert all(abs(sum(s) - 1) < 1e-9 for s in got.values())
    weights = {r["label"]: r["weight"] for r in R.class_weights(rows.where("split = 'train'"), "label").collect()}
    train = made.where("split = 'train'").withColumn("_w", F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("label")])
    alone = []
    for k in range(3):
        model = GBTClassifier(featuresCol="_v", labelCol="t", weightCol="_w", seed=3, **params).fit(train.withColumn("t", (F.col("_y") == k).cast("double")))
        alone.append({r["id"]: r["p"][1] for r in model.transform(made).select("id", vector_to_array("probability").alias("p")).collect()})
    right = sum(NAMES[int(np.argmax(got[r["id"]]))] == r["label"] for r in rows.where("split = 'test'").collect())
    assert right >= 36
    far = sum(abs(got[i][k] - alone[k][i] / sum(p[i] for p in alone)) > 0.05 for i in got for k in range(3))
    assert far <= 0.02 * 3 * len(got)


def test_two_labels_and_one(spark, rows):
    two = R.vectors(rows.where("label <> 'tick'"), ["a"], NAMES)
    scores = [r["scores"] for r in R.fit_scores(two, two, NAMES, R.BOOSTED, {"maxIter": 2}).collect()]
    assert all(s[2] == 0 and abs(s[0] + s[1] - 1) < 1e-9 for s in scores)
    one = R.vectors(rows.where("label = 'tick'"), ["a"], NAMES)
    assert {tuple(r["scores"]) for r in R.fit_scores(one, one, NAMES, R.BOOSTED).collect()} == {(0.0, 0.0, 1.0)}
    with pytest.raises(ValueError, match="no such model"):
        R.fit_scores(one, one, NAMES, "other")


def test_grid_prefers_depth_that_can_tell(rows):
    best, found = R.grid_run(rows, ["a", "b"], NAMES, "OK", {"maxDepth": [0, 4], "numTrees": [8]}, seed=2)
    assert best == {"maxDepth": 4, "numTrees": 8} and [p["maxDepth"] for p, _ in found] == [0, 4] and found[1][1] > 0.8 > found[0][1]


def test_cross_run_never_scores_what_it_saw(spark):
    # A label that only the row's own fold has, told by its own feature: unseen, it scores 0.
    data = spark.createDataFrame([(i, "tick" if i % 3 == 0 else "OK" if i % 2 else "noise", float(i % 3 == 0), i % 3) for i in range(60)], "id long, label string, a double, fold int")
    out = R.cross_run(data, ["a"], NAMES, "OK", params={"numTrees": 3}).collect()
    assert len(out) == 60 and all(r["scores"][2] == 0 for r in out if r["fold"] == 0)


def test_seed_runs(rows):
    metrics, tuned, every = R.seed_runs(rows, ["a", "b"], NAMES, "OK", [1, 2, 2], params={"numTrees": 8}, steps=[0.0, 0.3, 0.5])
    table = {(r["seed"], r["split"]): r for r in metrics.collect()}
    assert set(table) == {(s, p) for s in (1, 2) for p in ("train", "validation", "test")} and table[1, "test"]["accuracy"] > 0.8
    assert set(tuned) == {1, 2} and every.count() == 2 * rows.count()
    by = {s: (table[s, "validation"]["false_ok_rate"], -table[s, "validation"]["nok_recall"], -table[s, "validation"]["f1_macro"], s) for s in (1, 2)}
    assert R.best_run(metrics) == min(by, key=by.get)


def test_forest_of_random_cuts(spark):
    rng = np.random.default_rng(3)
    data = [(i, *map(float, rng.normal(size=2)), "ok") for i in range(500)] + [(500 + i, 8.0 + i, -9.0, "odd") for i in range(5)] + [(600, None, float("nan"), "ok")]
    rows = spark.createDataFrame(data, "id long, a double, b double, label string")
    nodes = A.isolation_forest(rows, ["a", "b"], "id", trees=25, sample=64, seed=1).cache()
    scored = {r["id"]: r["anomaly_score"] for r in A.isolated(rows, nodes, ["a", "b"], 64).collect()}
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    sizes = A.sampled(rows, ["a", "b"], "id", 25, 64, 1).groupBy("tree").count().collect()
    assert {r["count"] for r in sizes} == {64} and max(r["depth"] for r in table.values()) <= 6

    def depth(tree, x):
        node = table[tree, 0]
        while node["feature"] >= 0:
            node = table[tree, node["left"] if x[node["feature"]] <= node["cut"] else node["right"]]
        return node["depth"] + A.mean_depth(node["size"])

    for i, a, b, _ in data[::50] + data[-6:]:
        x = [0.0 if v is None or math.isnan(v) else v for v in (a, b)]
        assert scored[i] == pytest.approx(2 ** (-sum(depth(t, x) for t in range(25)) / 25 / A.mean_depth(64)))
    assert min(scored[500 + i] for i in range(5)) > np.quantile([scored[i] for i in range(500)], 0.97)
    assert A.mean_depth(1) == 0 and A.mean_depth(256) == pytest.approx(10.2447, abs=1e-3)


def test_normal_rows_alone_are_fitted(spark):
    data = [(i, float(i % 7), "ok" if i % 10 else "odd", "train" if i < 80 else "test") for i in range(100)]
    rows = spark.createDataFrame(data, "id long, a double, label string, split string").repartition(3)
    placed = {r["id"]: r["split"] for r in A.for_normal_fit(rows, "label", "ok", "id").collect()}
    assert [placed[i] for i in range(0, 80, 10)] == ["validation"] * 4 + ["test"] * 4 and sum(s == "train" for s in placed.values()) == 72
    out = A.anomaly_run(rows, ["a"], "label", "ok", "id", contamination=0.1, trees=10, sample=32).collect()
    assert len(out) == 100 and 0 < sum(r["anomaly"] for r in out if r["split"] == "train") <= 12
    whole = A.anomaly_run(rows, ["a"], "label", "ok", "id", normal_only=False, trees=5, sample=16).collect()
    assert sum(r["split"] == "train" for r in whole) == 80 and all((r["decision"] <= 0) == r["anomaly"] for r in whole)


def test_scores_and_suggestions_of_signals(spark):
    rows = spark.createDataFrame([([0.0] * 9 + [10.0],), ([1.0, -1.0],), ([0.0] * 5,), ([],), (None,)], "x array<double>")
    out = [r for r in rows.select(A.signal_scores(F.col("x")).alias("s"), A.suggestion(F.col("s.kurtosis"), 5.0, "tick_tock").alias("t")).collect()]
    assert out[0]["s"].asDict() == {"rms": 3.16228, "kurtosis": 10.0, "crest": 3.162} and out[0]["t"].asDict() == {"reason_key": "tick_tock", "confidence": 0.75, "note": "task:tick_proposal kurt=10.00"}
    assert out[1]["s"]["kurtosis"] == 0.0 and out[1]["t"] is None and out[2]["s"]["crest"] == 0.0
    assert out[3]["s"] is None and out[4]["s"] is None
