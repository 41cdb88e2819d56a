import pytest
from pyspark.sql import functions as F

from tremor.operators import assembly as A
from tremor.operators import prediction as P


@pytest.fixture
def manifest(spark):
    rows = [("A", "s1", "R1", "t", "A/x/1"), ("B", "s2", "R1", "t", "B/x/2"), ("B", "s3", None, None, "prototype/B/3"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "line string, sn string, reference string, time string, relative_path string")


def test_selection_is_a_union_and_everything_without_rules(manifest):
    picked = lambda **kw: sorted(r.sn or "" for r in A.selected(manifest, **kw).collect())
    assert picked() == ["", "s1", "s2", "s3"] and picked(line_name=["A"]) == ["s1"]
    assert picked(lines=["A"], folders=["/B/x/"]) == ["s1", "s2"] and picked(folders=["A"], line_name=["B"]) == ["s1"]
    assert picked(references=["R1"]) == ["s1", "s2"] and picked(references=["B/R1"]) == ["s2"]
    assert picked(references=["none"], key_folders=["prototype/B"]) == ["s3"] and picked(references=["none"], key_folders=[("prototype/B", "A")]) == []


def test_samples_without_recordings_or_switched_off_are_left_out(spark, manifest):
    samples = spark.createDataFrame([(1, "A", "s1", 1), (2, "B", "s2", 0), (3, "B", "s9", 1)], "sample_pk long, line string, sn string, is_active int")
    samples = samples.withColumns({c: F.lit("") for c in ("reference", "time", "relative_path")})
    out = A.training_samples(samples, manifest.union(manifest)).collect()
    assert [(r.sample_pk, r.relative_path) for r in out] == [(1, "A/x/1")]
    assert A.training_samples(samples.limit(0), manifest).count() == 0


def test_conflicts_list_values_as_they_occur(spark):
    rows = [("k", 3, "nok", "b"), ("k", 1, "ok", " nan "), ("k", 2, "nok", "a"), ("l", 1, "ok", "x"), ("l", 2, None, "y"), (None, 1, "ok", "x"), (None, 2, "nok", "x")]
    out = {r.k: (r.row_count, r.result, r.reason) for r in A.conflicts(spark.createDataFrame(rows, "k string, at int, result string, reason string"), ["k"], ["result", "reason"], "at").collect()}
    assert out["k"] == (3, "ok|nok", "a|b") and "l" not in out and out[None][1] == "ok|nok"


def test_faulty_signals_are_not_scored(spark):
    rows = [(1, [0.0, 0.1]), (2, []), (3, None), (4, [0.0] * 9), (5, [3.0, 3.0])]
    scores = F.array(F.lit(0.3), F.lit(0.7))
    out = spark.createDataFrame(rows, "id int, signal array<double>").select("id", P.detail(scores, ["ok", "friction"], [0.5, 0.6], "ok", P.sensor_fault(F.col("signal"), F.lit(4), 2.0, 1.0)).alias("d")).collect()
    found = {r.id: r.d for r in out}
    assert (found[1].result, found[1].mtype, found[1].score, found[1].scores) == ("NOK", "friction", 0.7, {"ok": 0.3, "friction": 0.7})
    assert {found[i].mtype for i in (2, 3, 4, 5)} == {P.SENSOR_ERROR} and {found[i].result for i in (2, 3, 4, 5)} == {"NOK"}


def test_metrics_of_a_perfect_run_and_of_no_rows(spark):
    rows = spark.createDataFrame([("test", "ok", "ok", [1.0, 0.0]), ("test", "bad", "bad", [0.25, 0.75])], "split string, t string, p string, s array<double>")
    r = P.split_metrics(rows, ["split"], "t", "p", "s", ["ok", "bad"], "ok").first()
    assert (r.samples, r.accuracy, r.f1_macro, r.f1_weighted, r.false_ok_rate, r.margin_mean) == (2, 1.0, 1.0, 1.0, 0.0, 0.75)
    assert P.split_metrics(rows.limit(0), ["split"], "t", "p", "s", ["ok", "bad"], "ok").count() == 0
