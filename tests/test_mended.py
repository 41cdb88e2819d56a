"""Rules that earlier versions left out."""

import functools
import operator
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import labels as L
from tremor.operators import learning as M
from tremor.operators import prediction as P
from tremor.operators import recordings as C
from tremor.operators import registry as G
from tremor.operators import views as V


def test_correlations_use_the_rows_that_both_columns_have(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) + [0, 1e6, 0, 0]
    x[:, 2] = 0.5 * x[:, 0] + 0.1 * x[:, 2]
    x[:, 3] = 7
    x[rng.random((200, 4)) < 0.4] = np.nan
    rows = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x)], "a double, b double, c double, d double").repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in M.correlated_pairs(rows, "abcd", 0.0).collect()}
    for (i, a), (j, b) in (((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c"))):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert M.correlated_pairs(rows.limit(0), "ab", 0.0).count() == 0


def test_targets_with_replacement_and_remainder(spark):
    rows = spark.createDataFrame([(i, ["hot", "few", "all", "none"][min(i // 100, 3)] if i < 300 else "none") for i in range(310)] + [(400 + i, "few2") for i in range(3)], "k long, label string")
    out = M.rebalanced_to(rows, "label", {"hot": 30, "few2": 10, "all": -1, "absent": 5}, "k", 1).collect()
    copies = {label: [r["copies"] for r in out if r["label"] == label] for label in ("hot", "few2", "all")}
    assert sorted(copies["hot"]) == [0] * 70 + [1] * 30 and sum(copies["few2"]) == 10 and min(copies["few2"]) >= 1 and copies["all"] == [1] * 100
    assert {r["label"] for r in out} == {"hot", "few2", "all"}
    assert sum(r["copies"] for r in M.rebalanced_to(rows, "label", {"few2": 10}, "k", 1, oversample=False).collect()) == 3


def test_oldest_file_is_kept(spark):
    files = spark.createDataFrame([("a", "x", 3), ("b", "x", 1), ("c", "x", 1), ("d", "y", None), ("e", "y", 9)], "path string, content string, modified int")
    kept = {r["kept"]: r["files"] for r in G.content_duplicates(files, "path", "content", "modified").collect()}
    assert kept == {"b": 3, "e": 2}


def test_names_in_composed_form(spark):
    name = "é.tdms"
    files = spark.createDataFrame([(f"a/{name}",), (f"b/{unicodedata.normalize('NFD', name)}",), ("c/other",), (None,)], "path string")
    assert [(r["name"], r["files"]) for r in C.same_names(files).collect()] == [(name, 2)]


def test_one_label_for_each_sample(spark):
    samples = spark.createDataFrame([(1, "A", "s1"), (2, "B", "s2")], "id int, line string, sn string")
    labels = spark.createDataFrame([("A", "s1", "x", 1), ("A", "s1", "w", 2), (None, "s2", "y", 5), (None, "s2", "z", 4)], "line string, sn string, label string, at int")
    got = lambda **o: {r["id"]: r["label"] for r in L.with_fallback(samples, labels, ["line", "sn"], ["sn"], ["label"], **o).collect()}
    assert got() == {1: "x", 2: "z"} and got(order="at") == {1: "w", 2: "y"}


def test_serials_by_line_in_reviews(spark):
    rows = [(0, "A", "s", 0.5), (1, "B", "s", 0.9), (2, "A", "t", 0.1), (3, None, "s", 0.2)]
    errors = spark.createDataFrame([(*r, 0.5, 0.1, str(r[0])) for r in rows], "n int, line string, sn string, score_gap double, confidence double, true_probability double, sample_id string")
    assert [(r["n"], r["place"]) for r in V.review_rows(errors, "n", 2, by_line=True).collect()] == [(0, 1), (1, 2)]
    assert [(r["n"], r["place"]) for r in V.review_rows(errors, "n", 1).collect()] == [(1, 1), (0, 1), (3, 1)]


#: Added from left to right, these six make 0.8999999999999999 of a mean of 0.9.
_SIX = [0.4 + d * 6 for d in (0.09, 0.1, 0.09, 0.09, 0.09, 0.04)]


def _candidates(spark, values):
    rows = [(1, k, 0, 1, v, 0.5, "Expert", "seen") for k, v in enumerate(values)]
    return M.audit(spark.createDataFrame(rows, "sample int, seed int, truth int, predicted int, confidence double, true_probability double, source string, note string").coalesce(1), ["sample"])


def test_scores_at_a_limit_do_not_depend_on_the_order_of_rows(spark):
    added = lambda v: functools.reduce(operator.add, v)
    assert added(_SIX) / 6 < 0.9 <= added(sorted(_SIX)) / 6
    found = [_candidates(spark, v).first() for v in (_SIX, sorted(_SIX), _SIX[::-1])]
    assert {(r["mean_confidence"], r["score"]) for r in found} == {(0.9, 65 + 40 + 10)}
    mean = lambda v: spark.createDataFrame([(x,) for x in v], "x double").agg(M.exact_mean(F.col("x")).alias("m")).first()["m"]
    assert mean([]) is None and mean([None, 0.5]) == 0.5 and np.isnan(mean([0.5, float("nan")])) and mean([1e30, 3e30]) == 2e30


def test_scores_of_serials_do_not_depend_on_the_order_of_rows(spark):
    for values in (_SIX, sorted(_SIX)):
        found = P.suspicious_serials(_candidates(spark, values).withColumn("at", F.col("truth") * 10 + F.col("predicted")), ["sample"], "at").first()
        assert found["max_suspect_score"] == 115 and found["mean_suspect_score"] == 115


def test_files_of_short_serials_are_reduced_before_the_join(spark, monkeypatch):
    monkeypatch.setattr(C, "FILES", 20)
    paths = [f"L{k % 3}/part_{k}.v{k % 2}.tdms" for k in range(90)] + ["L0/1", "L9/.1"]
    serials = ["1", "12", "part_7", "", "none", None]
    found = C.by_name_part(spark.createDataFrame([(s,) for s in serials], "sn string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    name = lambda p: p.split("/")[-1]
    stem = lambda p: name(p).rsplit(".", 1)[0] or name(p)
    expected = {s: min((len(name(p)), p) for p in paths if s in stem(p))[1] for s in ("1", "12", "part_7")}
    assert {r["sn"]: r["path"] for r in found.collect()} == expected
    # A serial that most names hold comes to the join once, not with all its files.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("Aggregate [sn") < plan.index("Generate explode")
