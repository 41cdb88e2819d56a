"""Listings, sheets and registers on small files."""

import pytest

from pyspark.sql import functions as F

from tremor.operators import recordings as R
from tremor.operators import sampling as P
from tremor.operators import views as V
from tremor.sources import sheets


def test_listing_and_counts(spark, tmp_path):
    for name in ("L1/a.tdms", "L1/b.tdms.zst", "L2/.old/c.tdms", "L2/d.csv", "L2/e.TDMS"):
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 10)
    files = R.listing(spark, str(tmp_path / "data"))
    assert sorted(r["relative_path"] for r in files.collect()) == ["L1/a.tdms", "L1/b.tdms.zst", "L2/e.TDMS"]
    assert {(r["line"], r["files"], r["packed"], r["bytes"]) for r in R.folder_counts(files).collect()} == {("L1", 2, 1, 20), ("L2", 1, 0, 10), (None, 3, 1, 30)}
    assert R.listing(spark, str(tmp_path / "data"), packed=False).count() == 2


def test_sheets_of_several_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("line, sn ,note\nA,1,\"two\nlines\"\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_bytes("line,sn,reason\n甲,2,异常\n".encode("gbk"))
    (tmp_path / "c.csv").write_text("line,sn\n", encoding="utf-8")
    rows = {(r["line"], r["sn"], r["note"], r["reason"]) for r in sheets.read_sheets(spark, [str(tmp_path / "*.csv")]).collect()}
    assert rows == {("A", "1", "two\nlines", None), ("甲", "2", None, "异常")}


def test_header_prefers_the_exact_name(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], ["﻿line", " line", "line", "﻿sn "])
    assert sheets.clean_header(rows).head().asDict() == {"line": 3, "sn": 4}


def test_features_leave_out_augmented_files(spark, tmp_path):
    spark.createDataFrame([(1,)], "v int").toPandas().to_parquet(tmp_path / "features_batch_1.parquet")
    spark.createDataFrame([(2,)], "v int").toPandas().to_parquet(tmp_path / "features_augmented.parquet")
    spark.createDataFrame([(3,)], "v int").toPandas().to_parquet(tmp_path / "labels.parquet")
    assert [r["v"] for r in sheets.read_features(spark, str(tmp_path)).collect()] == [1]


def test_names_with_odd_serials(spark):
    rows = spark.createDataFrame([("S1", "a/x_S1_S1.tdms.zst"), ("", "a/b.tdms"), (None, "a/.hid"), ("zz", "a/n")], "sn string, path string")
    out = rows.select(R.augmented(F.col("sn"), F.col("path"), F.lit(7)).alias("a"), "sn").collect()
    names = {r["sn"]: r["a"] for r in out}
    assert names["S1"]["name"] == f"x_{names['S1']['sn']}_S1.tdms" and names["S1"]["sn"].startswith("S1aug007")
    assert names[""]["sn"].startswith("aug007") and names[""]["name"] == f"b_{names['']['sn']}.tdms"
    assert names[None]["name"].startswith(".hid_aug007")


def test_parts_of_names_without_serials(spark):
    files = spark.createDataFrame([("a/longer_12.tdms",), ("b/x12.tdms",), ("c/y12.tdms",)], "path string")
    found = R.by_name_part(spark.createDataFrame([("12",), ("12",), ("",), (None,), ("no",)], "sn string"), files).collect()
    assert [(r["sn"], r["path"]) for r in found] == [("12", "b/x12.tdms")]
    assert R.by_name_part(spark.createDataFrame([], "sn string"), files).count() == 0


def test_lists_that_are_none(spark):
    rows = spark.createDataFrame([(1, "[broken"), (2, "[1, 2]"), (3, None), (4, "[]"), (5, "[not a list}]")], "k int, sample_id string")
    got = sorted((r["k"], r["sample_id"]) for r in V.exploded_samples(rows).collect() if r["k"] < 5)
    assert got == [(1, "[broken"), (2, "1"), (2, "2"), (3, None), (4, "[]")]
    assert V.exploded_samples(rows).where("k = 5").count() == 1


def test_standard_columns(spark):
    rows = spark.createDataFrame([("a", 1, None)], "line string, sn int, sample_id string")
    assert V.standardized(rows, ["sn", "line", "sample_id", "note"]).head().asDict() == {"sn": "1", "line": "a", "sample_id": "", "note": ""}
    with pytest.raises(ValueError, match="sn"):
        V.standardized(rows.drop("sn"), ["line"])


def test_small_tables_are_their_own_samples(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)], "k int, label string")
    assert P.stratified(rows, "label", 10, "k").count() == 10
    assert P.balanced(rows, "label", 0, "k").count() == 10
    assert P.balanced(rows, "label", 7, "k").count() == 7
    assert P.balanced(rows.union(spark.createDataFrame([(99, None)], "k int, label string")), "label", 2, "k").count() == 2
    assert P.stratified(rows.where("false"), "label", 3, "k").count() == 0
    assert P.length_target(spark.createDataFrame([], "s array<double>"), "s").count() == 0
