"""Ranks and draws dealt by value against plain loops."""

import math
import random

from pyspark.sql import functions as F

from tremor.functions import arrays as A
from tremor.operators import learning, ranks, stats


def test_sums_below_hold_for_uneven_ranges_and_special_values(spark):
    dice = random.Random(5)
    values = [10.0 ** dice.uniform(-300, 300) for _ in range(300)] + [1 + k * 2.0**-50 for k in range(300)] + [-3.0, 0.0, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, None]
    rows = [(g, v, dice.randrange(5)) for g in ("a", None) for v in dict.fromkeys(values)]
    found = ranks.below(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", "n").collect()
    place = lambda v: (-1, 0.0) if v is None else (1, 0.0) if math.isnan(v) else (0, v)
    assert len(found) == len(rows)
    for r in found:
        own = [(place(v), n) for g, v, n in rows if g == r["g"]]
        assert r["below"] == sum(n for p, n in own if p < place(r["v"]))
        assert r["total"] == sum(n for _, n in own)


def test_draws_take_the_rows_of_least_dice(spark):
    rows = [(k, "hot" if k % 4 else None) for k in range(5000)] + [(7, "hot"), (9000, "small")]
    frame = spark.createDataFrame(rows, "k long, label string")
    with_dice = [(r["k"], r["label"], r["d"]) for r in frame.withColumn("d", learning.dice(F.col("k"), F.lit(3))).collect()]
    got = {}
    for r in learning.downsampled(frame, "label", 100, "k", 3).collect():
        got.setdefault(r["label"], []).append(r["k"])
    for label in ("hot", "small", None):
        own = sorted((d, k) for k, of, d in with_dice if of == label)
        assert sorted(got[label]) == sorted(k for _, k in own[:100])
    copies = {}
    for r in learning.rebalanced(frame, "label", 2000, "k", 3).collect():
        copies[r["label"]] = copies.get(r["label"], 0) + r["copies"]
    assert copies == {"hot": 2000, "small": 2000, None: 2000}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, label string, v double, p boolean")
    assert learning.downsampled(none, "label", 3, "k").count() == 0
    assert learning.auc(none, "label", "p", "v").count() == 0
    assert stats.percent_rank_average(none, "v").count() == 0


def test_array_functions_bind_values_once(spark):
    signal = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda k: F.sin(k.cast("double"))).alias("x"))
    out = signal.select(A.robust_scale(F.col("x")).alias("scale"), A.energy_entropy(F.col("x")).alias("e"), F.aggregate(A.standardize(F.col("x")), F.lit(0.0), lambda a, v: a + v * v).alias("s"), F.array_max(A.to_db(F.transform("x", lambda v: v * v))).alias("db")).head()
    assert abs(out["s"] / 100_000 - 1) < 1e-4 and abs(out["db"]) < 1e-9
    assert 0.9 < out["scale"] < 1.2 and 10 < out["e"] < math.log(100_000)
