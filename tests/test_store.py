"""The label store on disk, its exports and its feature tables."""

import pytest
from pyspark.sql import functions as F

from tremor.sources import store as S

SAMPLE = "id long, line string, sn string, sample_id string, is_active int"


def samples(spark, *rows):
    return spark.createDataFrame([(i, line, sn, f"{sn}_up", 1) for i, line, sn in rows], SAMPLE)


def test_versions_survive_a_new_session_and_a_killed_writer(spark, tmp_path, monkeypatch):
    store = S.LabelStore(spark, str(tmp_path))
    assert store.samples.append(samples(spark, (1, "A", "s1"), (2, "B/x=1", "s2"))) == 1
    assert store.samples.append(samples(spark, (3, "A", "s3"))) == 2
    with monkeypatch.context() as m:
        m.setattr(S.Table, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.samples.replace(samples(spark, (9, "A", "lost")), ["A"])
    again = S.LabelStore(spark.newSession(), str(tmp_path))
    assert again.samples.versions() == [1, 2]
    assert sorted(r["sn"] for r in again.samples.read().collect()) == ["s1", "s2", "s3"]
    assert sorted(r["sn"] for r in again.samples.read(1).collect()) == ["s1", "s2"]
    assert {r["line"] for r in again.samples.read().collect()} == {"A", "B/x=1"}
    with pytest.raises(ValueError, match="no version 7"):
        again.samples.read(7)


def test_scope_keeps_other_parts(spark, tmp_path):
    table = S.LabelStore(spark, str(tmp_path)).samples
    table.append(samples(spark, (1, "A", "s1"), (2, "B/x=1", "s2")))
    old = {p["of"]: p["path"] for p in table.record()["parts"]}
    table.replace(samples(spark, (4, "A", "s4")), ["A"])
    new = {p["of"]: p["path"] for p in table.record()["parts"]}
    assert old["B/x=1"] == new["B/x=1"] and old["A"] != new["A"]
    assert sorted(r["sn"] for r in table.read().collect()) == ["s2", "s4"]
    table.replace(samples(spark).limit(0), ["B/x=1"])
    assert [r["sn"] for r in table.read().collect()] == ["s4"]
    with pytest.raises(ValueError, match="beyond the scope"):
        table.replace(samples(spark, (5, "C", "s5")), ["A"])
    with pytest.raises(ValueError, match="repeat"):
        table.append(samples(spark, (6, "A", "s4")))
    table.replace(samples(spark, (7, "C", "s7")))
    assert [r["sn"] for r in table.read().collect()] == ["s7"]


def test_second_writer_conflicts(spark, tmp_path):
    table = S.LabelStore(spark, str(tmp_path)).samples
    begun = table.append(samples(spark, (1, "A", "s1")))
    table.append(samples(spark, (2, "A", "s2")), begun)
    with pytest.raises(S.Conflict):
        table.append(samples(spark, (3, "A", "s3")), begun)
    with pytest.raises(S.Conflict):
        table._commit(begun, [])
    assert sorted(r["sn"] for r in table.read().collect()) == ["s1", "s2"]


def test_migrations(spark, tmp_path):
    old = S.Table(spark, str(tmp_path), "samples", by="line")
    old.append(samples(spark, (1, "A", "s1")).withColumn("tdms_path", F.lit("x")).withColumn("reference", F.lit(None).cast("string")))
    table = S.LabelStore(spark, str(tmp_path)).samples
    assert table.read().first().asDict() == {"id": 1, "line": "A", "sn": "s1", "sample_id": "s1_up", "is_active": 1, "reference": "", "time": ""}
    table.append(samples(spark, (2, "B", "s2")).withColumn("reference", F.lit("R")).withColumn("time", F.lit("t")))
    assert [p["schema"] for p in table.record()["parts"]] == [0, 1]
    assert table.migrate() == 3 and table.migrate() == 3 and {p["schema"] for p in table.record()["parts"]} == {1}
    assert sorted((r["sn"], r["reference"]) for r in table.read().collect()) == [("s1", ""), ("s2", "R")]
    events = S.Table(spark, str(tmp_path), "label_events")
    rows = [(1, "expert", "x"), (2, "expert.lee", None), (3, "experts", "confirmed"), (4, "expert", "rejected"), (5, "model", "pending"), (6, "EXPERT-1", "")]
    events.append(spark.createDataFrame([(i, 1, s, t) for i, s, t in rows], "id long, sample_pk long, source string, status string"))
    store = S.LabelStore(spark, str(tmp_path))
    assert {r["id"]: r["status"] for r in store.events.read().collect()} == {1: "confirmed", 2: "confirmed", 3: "unconfirmed", 4: "rejected", 5: "pending", 6: "confirmed"}
    assert [r["sn"] for r in store.unlabeled().collect()] == ["s2"]


def test_exported_sheets(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "2026-01-01", "expert", "confirmed", "a, \"b\""), (2, 1, "2026-01-02", "expert", "confirmed", "[[prototype]] c"), (3, 1, "2026-01-03", "model", "unconfirmed", "d"), (4, 99, "2026-01-03", "expert", "confirmed", "nobody's")], "id long, sample_pk long, timestamp string, source string, status string, note string")
    sheets = S.exported_records(samples(spark, (1, "A", "s1"), (2, "B", "s2")), events)
    assert {k: v.count() for k, v in sheets.items()} == {"samples": 2, "label_events": 3, "sample_labels": 2}
    assert sheets["sample_labels"].columns == [*S.SAMPLE_COLUMNS, *S.EVENT_COLUMNS[3:]]
    labels = {r["sn"]: (r["note"], r["timestamp"], r["status"]) for r in sheets["sample_labels"].collect()}
    assert labels == {"s1": ("[[prototype]] c", "2026-01-02", "confirmed"), "s2": ("", "", "")}
    assert [r["sn"] for r in S.labels_of(sheets["sample_labels"], ["A", "B"], "[[prototype]]").collect()] == ["s1"] and S.labels_of(sheets["sample_labels"], ["B"]).count() == 1
    S.write_sheets(sheets, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv/label_events"))
    assert sorted(r["note"] for r in back.collect()) == ["[[prototype]] c", "a, \"b\"", "d"]


def test_ragged_features(spark, tmp_path):
    parts = [spark.createDataFrame([("s1", 1.0)], "sn string, f1 double"), spark.createDataFrame([(2.0, "s2", 3)], "f2 double, sn string, f1 int")]
    assert S.write_features(parts, str(tmp_path / "f"), ["line", "sn"], 1) == ["sn", "f1", "f2"]
    assert sorted((r["sn"], r["f1"], r["f2"], r["line"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [("s1", 1.0, None, None), ("s2", 3.0, 2.0, None)]


def test_tensors(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0]])], f"id int, {S.TENSOR} array<array<float>>")
    wide = S.to_wide(rows, ["mel_000", "mel_001"], 2)
    assert wide.columns == ["id", "feat__mel_000__0000", "feat__mel_000__0001", "feat__mel_001__0000", "feat__mel_001__0001"]
    assert S.from_wide(wide).first()[S.TENSOR] == [[1.0, 2.0], [3.0, 0.0]]
    gaps = spark.createDataFrame([("x", "4", float("nan"))], "feat__b__0002 string, feat__a__0000 string, feat__b__0000 double")
    assert S.from_wide(gaps).first()[S.TENSOR] == [[0.0, 0.0, 0.0], [4.0, 0.0, 0.0]]
    assert S.checked_tensors(rows, 2, 3).first()[S.TENSOR] == [[1.0, 2.0, 0.0], [3.0, 0.0, 0.0]]
    with pytest.raises(Exception, match="channels of a tensor: 2"):
        S.checked_tensors(rows, 1).collect()
    with pytest.raises(ValueError, match="no columns"):
        S.from_wide(rows)
