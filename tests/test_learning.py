import random

from pyspark.sql import functions as F

from tremor.operators import learning as M
from tremor.operators import models as K
from tremor.operators import splits as S


def table(spark, n=600):
    rng = random.Random(3)
    rows = [(i, f"l{i % 3}::r{i % 7}::s{i // 4}", f"r{i % 7}", f"s{i // 4}", "ok" if rng.random() < 0.7 else rng.choice(["friction", "tick"])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, grp string, reference string, sn string, label string")


def test_search_keeps_groups_whole_and_labels_even(spark):
    rows = table(spark)
    out = S.searched_split(rows, "grp", "label")
    assert M.split_overlap(out, "grp").count() == 0 and out.count() == 600
    shares = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert 30 <= shares["test"] <= 90 and 40 <= shares["validation"] <= 110
    assert out.where("split = 'test'").select("label").distinct().count() == 3
    again = S.searched_split(rows, "grp", "label")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in again.collect()}


def test_search_has_rare_labels_on_all_sides_of_many_groups(spark):
    rare = F.when(F.col("id") < 48, F.concat(F.lit("rare"), (F.col("id") % 4).cast("string"))).otherwise("ok")
    rows = spark.range(200_100).select("id", F.concat(F.lit("g"), F.col("id").cast("string")).alias("grp"), rare.alias("label"))
    out = S.searched_split(rows, "grp", "label")
    found = {r.split: (r.n, r.labels) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect()}
    assert {k: v[1] for k, v in found.items()} == {"train": 5, "validation": 5, "test": 5}
    # Filled up to their shares, to the group.
    assert found["test"][0] == 20010 and found["validation"][0] == int(180090 * 0.125)


def test_search_of_few_groups(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "grp string, label string")
    sides = {r.grp: r.split for r in S.searched_split(rows, "grp", "label").collect()}
    assert sides[None] == "train" and sorted([sides["a"], sides["b"]]) == ["test", "train"]
    assert {r.split for r in S.searched_split(rows.where("grp = 'a'"), "grp", "label").collect()} == {"train"}


def test_split_within_has_every_reference_on_every_side(spark):
    out = S.split_within(table(spark), "reference", "sn")
    sides = {r.reference: r.n for r in out.groupBy("reference").agg(F.count_distinct("split").alias("n")).collect()}
    assert set(sides.values()) == {3}
    assert out.groupBy("reference", "sn").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_thresholds_and_training(spark):
    rng = random.Random(1)
    names = ["ok", "friction"]
    rows = [("friction" if i % 4 == 0 else "ok", "train" if i % 5 else "test", f"s{i // 2}", (3.0 if i % 4 == 0 else 0.0) + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    data = spark.createDataFrame(rows, "label string, split string, sn string, a double, b double")
    scored = K.predictions(data, ["a", "b"], names, seed=5, trees=5).cache()
    limits = S.tuned_thresholds(scored.where("split = 'train'").withColumnRenamed("label", "truth"), names, "ok", [0.5, 0.5], [0.3, 0.5, 0.7])
    assert len(limits) == 2 and set(limits) <= {0.3, 0.5, 0.7}
    result = {r.split: r for r in K.report(scored, names, [0.0, limits[1]], "ok").collect()}
    assert result["test"].accuracy > 0.85 and result["test"].rows == 80
    wrong = K.misclassified(scored, names, [0.0, limits[1]], "ok")
    assert wrong.count() == round(sum((1 - r.accuracy) * r.rows for r in result.values()))
    assert K.for_review(wrong, "sn", 3).select("sn").distinct().count() <= 3


def test_redundant_features_go():
    pairs = [("a", "b", 0.99), ("a", "c", 0.1)]
    assert K.without_redundant(["a", "b", "c", "d"], pairs, 2) == ["a", "c", "d"]
    assert K.without_redundant(["a", "b"], pairs, 2) == ["a", "b"]
