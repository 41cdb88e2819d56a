import difflib

from pyspark.sql import functions as F

from tremor.operators import imports as I

REASONS = (I.Reason("clean_normal", "clean normal", "ok"), I.Reason("friction", "摩擦声", "nok", ("friction", "rub noise")), I.Reason("tremble", "tremble", "nok"))


def test_reasons_match_by_name_form_holding_and_blocks(spark):
    rows = [("friction",), ("ＲＵＢ（noise)",), ("small rub noise",), ("frictoin",), ("zzz",), ("--",)]
    match = I.reason_matcher(REASONS, 0.72)
    got = {r.t: r.m for r in spark.createDataFrame(rows, "t string").select("t", match("t").alias("m")).collect()}
    assert (got["friction"].key, got["friction"].score) == ("friction", 1.0)
    assert (got["ＲＵＢ（noise)"].token, got["ＲＵＢ（noise)"].score) == ("rub noise", 0.999)
    assert got["small rub noise"].score == 0.9 or got["small rub noise"].score > 0.9
    assert got["frictoin"].score == difflib.SequenceMatcher(a="frictoin", b="friction").ratio() and got["frictoin"].key == "friction"
    assert got["zzz"].key is None and got["--"].key is None


def test_results_reasons_of_their_own_and_times(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(I.result_key(F.lit(x), ("ok", "nok"))) for x in (" OK", "故障", "边界", "nan", None)] == ["ok", "nok", None, None, None]
    assert [value(I.own_reason(F.lit(x), REASONS)) for x in ("ok", "nok")] == ["clean_normal", None]
    assert [value(I.sheet_time(F.lit(x))) for x in ("2024/3/5 7:08", "2024-03-05", "last week")] == ["2024-03-05T07:08:00", "2024-03-05T00:00:00", "last week"]
    assert [value(I.block_time(F.lit("2024-03-05"), F.lit(h))) for h in ("7.0", "24", None, "x")] == ["2024-03-05T07:00:00"] + ["2024-03-05T00:00:00"] * 3
    assert [value(I.confidence(F.lit(x), 0.7)) for x in ("轻微-friction", "强烈", "")] == [0.6, 0.95, 0.7]


def test_sheets_without_rows_lines_or_annotators(spark):
    assert I.annotator_groups(["label_3_up", "label_2_operator", "up", "x"]) == [1, 2, 3]
    assert I.has_annotators(["label_1_operator", "label_1_up"]) and not I.has_annotators(["up", "label_1_operator"])
    sheet = spark.createDataFrame([(2, None, "ok"), (3, "s1", None), (4, "s2", "nok")], "row long, sn string, up string").withColumn("down", F.lit("ok"))
    history = spark.createDataFrame([("s1", "A", 1, 1), ("s1", "A", 2, 2)], "sn string, line string, timestamp long, id long")
    manifest = spark.createDataFrame([], "sn string, reference string, line string, timestamp long, id long")
    out = {(r.row, r.direction): r for r in I.import_records(I.with_lines(I.sheet_labels(sheet), history, manifest), ("ok", "nok"), REASONS).collect()}
    assert len(out) == 6 and {r.line for r in out.values()} == {"A"}
    assert out[2, "up"].error == "no serial" and out[3, "up"].error == "no such result" and out[4, "up"].error == "no reason"
    assert out[4, "down"].error is None and out[4, "down"].note == "reason_auto=ok->clean normal"
    empty = I.sheet_labels(sheet.limit(0))
    assert I.import_records(I.with_lines(empty, history, manifest), ("ok", "nok"), REASONS).count() == 0
