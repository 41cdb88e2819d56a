"""Reasons, reviewers' actions, and the register's paths."""

import pytest
from pyspark.sql import functions as F

from tremor.operators import locations as P
from tremor.operators import reasons as R
from tremor.plans.recording_queries import RULES

YAML = {
    "results": {"ok": {"id": 0, "name": "good"}, "nok": {"id": 1, "name": "bad"}},
    "reasons": {"clean": {"id": 0, "name": "Clean", "alias": ["fine"], "parent": "ok"}, "tick": {"id": 102, "name": "Tick", "alias": ["tick-tock", "clock"], "parent": "nok"}},
    "meta": {"legacy_label_to_reason": {7: "tick", "102": "clean"}},
}
EVENT = "id long, line string, sn string, sample_id string, timestamp string, source string, reason_key string, reason_id int, reason_name string, result_key string, result_id int, result_name string, reason_confidence double, note string, status string"


def event(i, sample, time, source, note="", reason="tick"):
    return (i, "L", sample, f"{sample}_up", time, source, reason, None, None, None, None, None, None, note, "unconfirmed")


def test_reasons_by_key_name_and_number(spark):
    rules = R.rules_table(spark, YAML)
    rows = [("tick", None, None), (" tick ", "x", "Clean"), ("", None, "clock"), (None, "102.0", ""), (None, "7", None), ("other", "nan", "what"), (None, None, None), ("", "0", "nobody")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, reason_key string, reason_id string, reason_name string")
    got = {r["i"]: r for r in R.resolved(frame, rules).collect()}
    assert [got[i]["reason_key"] for i in range(8)] == ["tick", "tick", "tick", "tick", "tick", "other", None, "clean"]
    assert (got[3]["reason_name"], got[3]["reason_id"], got[3]["result_key"], got[3]["result_id"], got[3]["result_name"]) == ("Tick", "102", "nok", 1, "bad")
    assert [got[i]["known"] for i in (5, 6, 7)] == [False, False, True]
    shown = {r["i"]: r["reason_name"] for r in R.displayed(frame, rules).collect()}
    assert shown[5] == R.UNREGISTERED and shown[6] is None and shown[0] is None and shown[2] == "clock"
    out = frame.select(R.reason_number(F.col("reason_id"), F.col("reason_name"), {"clock": 102}, {102: "Tick"}).alias("r"), "i").collect()
    assert {r["i"]: (r["r"]["id"], r["r"]["name"]) for r in out if r["i"] in (2, 3, 4, 5)} == {2: (102, "clock"), 3: (102, "Tick"), 4: (7, "7"), 5: (None, "what")}


def test_added_labels_replace_those_of_the_day(spark):
    rules = R.rules_table(spark, YAML)
    events = spark.createDataFrame([event(1, "s1", "2026-01-01 08:00", "expert"), event(2, "s1", "2026-01-01 09:00", "Expert"), event(3, "s1", "2026-01-02 09:00", "expert"), event(4, "s1", "2026-01-01 09:00", "expert_lee")], EVENT)
    samples = spark.createDataFrame([("L", "s1", "s1_up", 0)], "line string, sn string, sample_id string, is_active int")
    new = [(0, "s1", "2026-01-01 10:00", "expert", "clean"), (1, "s1", "2026-01-01 11:00", "expert", "clock"), (2, "s1", "2026-01-01 10:00", "expert_lee", "fine"), (3, "s9", "2026-01-03 10:00", "visitor", "??")]
    frame = spark.createDataFrame([(p, "L", s, f"{s}_up", t, src, None, None, name) for p, s, t, src, name in new], "place int, line string, sn string, sample_id string, timestamp string, source string, reason_key string, reason_id int, reason_name string")
    out, after = R.added(events, samples, frame, rules)
    got = {r["id"]: (r["timestamp"], r["source"], r["reason_key"], r["status"]) for r in out.collect()}
    assert got == {1: ("2026-01-01 08:00", "expert", "tick", "unconfirmed"), 2: ("2026-01-01 11:00", "expert", "tick", "confirmed"), 3: ("2026-01-02 09:00", "expert", "tick", "unconfirmed"), 4: ("2026-01-01 09:00", "expert_lee", "tick", "unconfirmed"), 5: ("2026-01-01 10:00", "expert_lee", "clean", "confirmed"), 6: ("2026-01-03 10:00", "visitor", None, "unconfirmed")}
    assert sorted((r["sn"], r["is_active"]) for r in after.collect()) == [("s1", 0), ("s9", 1)]
    with pytest.raises(Exception, match="a label needs sn"):
        R.added(events, samples, frame.withColumn("sn", F.lit(" ")), rules)[0].collect()


def test_confirm_tag_and_accept(spark):
    events = spark.createDataFrame([event(1, "s1", "2026-01-01", "model", "n"), event(2, "s1", "2026-01-02", "model"), event(5, "s2", "2026-01-01", "model", "[[prototype]] old")], EVENT)
    now = F.lit("2026-02-01T00:00:00")
    out = R.confirmed_copies(events, spark.createDataFrame([(1,), (5,), (1,)], "id long"), now).where("id > 5").orderBy("id").collect()
    assert [(r["id"], r["sn"], r["source"], r["status"], r["timestamp"], r["note"]) for r in out] == [(6, "s1", "expert", "confirmed", "2026-02-01T00:00:00", "n"), (7, "s2", "expert", "confirmed", "2026-02-01T00:00:00", "[[prototype]] old")]
    with pytest.raises(Exception, match="no such label event: 9"):
        R.confirmed_copies(events, spark.createDataFrame([(9,)], "id long"), now).collect()
    samples = spark.createDataFrame([("L", "s1", "s1_up", 1), ("L", "s2", "s2_up", 1)], "line string, sn string, sample_id string, is_active int")
    assert {r["id"]: r["note"] for r in R.tagged(events, samples, "[[x]]").collect()} == {1: "n", 2: "[[x]]", 5: "[[prototype]] old [[x]]"}
    flags = spark.createDataFrame([("L", "s1", "s1_up", True), ("L", "s2", "s2_up", False)], "line string, sn string, sample_id string, typical boolean")
    assert {r["id"]: r["note"] for r in R.typical(events, flags).collect()} == {1: "n", 2: "[[prototype]]", 5: "old"}
    suggestions = spark.createDataFrame([("s1_up", "clean", 0.75, "task"), ("s2_up", "tick", 0.6, "")], "sample_id string, reason_key string, confidence double, note string")
    after, _ = R.accepted(events, samples, suggestions, spark.createDataFrame([("s1_up",)], "sample_id string"), R.rules_table(spark, YAML), F.lit("2026-01-02 12:00"))
    changed = {r["id"]: (r["reason_key"], r["reason_confidence"], r["source"], r["result_key"]) for r in after.collect()}
    assert changed[2] == ("clean", 0.75, "model", "ok") and set(changed) == {1, 2, 5}


def test_label_records(spark):
    events = spark.createDataFrame([event(1, "s1", "2026-01-01", "expert", "a"), event(2, "s1", "2026-01-02", "expert", "b"), event(3, "s7", "2026-01-02", "expert", "c")], EVENT)
    samples = spark.createDataFrame([("L", "s1", "s1_up", "g"), ("M", "s2", "s2_up", None)], "line string, sn string, sample_id string, group_name string")
    short = lambda df: sorted((r["sample_id"], r["line"], r["group_name"], r["note"]) for r in df.collect())
    assert short(R.label_records(samples, events)) == [("s1_up", "L", "g", "a"), ("s1_up", "L", "g", "b"), ("s7_up", "L", "", "c")]
    assert short(R.label_records(samples, events, labeled_only=False)) == [("s1_up", "L", "g", "b"), ("s2_up", "M", "", "")]
    changed = spark.createDataFrame([("s1_up",), ("s2_up",)], "sample_id string")
    assert short(R.label_records(samples, events, changed=changed)) == [("s1_up", "L", "g", "b")]


MANIFEST = "n int, line string, sn string, reference string, time string, created_time string, tdms_storage_root string, relative_path string"


def test_register_by_keys_and_paths_that_are_there(spark):
    rows = [(1, "L", "S1", "r1", "", "", "factory_raw", "L/a.tdms"), (2, "l ", "s1", "", "", "", "/factory_raw/", "L/b.tdms"), (3, None, "s2", "r2", "", "", "factory_raw", "x/c.tdms"), (4, "M", "s1", "r3", "", "", "factory_raw", "data_root/d.tdms"), (5, "K", "s3", "", "", "", "", "k/e.tdms"), (6, "L", "s1", "", "", "", "factory_raw", "L/late.tdms"), (7, "", " ", "", "", "", "factory_raw", "f.tdms")]
    manifest = spark.createDataFrame(rows, MANIFEST)
    by_key, by_sn = P.adapter(manifest, "n")
    assert {(r["line"], r["sn"]): (r["path"], r["storage"], r["reference"]) for r in by_key.collect()} == {("l", "s1"): ("L/late.tdms", "factory_raw", "r1"), ("m", "s1"): (None, None, "r3"), ("k", "s3"): (None, None, None)}
    assert {r["sn"]: (r["path"], r["reference"], r["line"]) for r in by_sn.collect()} == {"s1": ("L/late.tdms", "r3", "l"), "s2": ("x/c.tdms", "r2", None), "s3": (None, None, "k")}
    view = spark.createDataFrame([("L", "S1"), ("M", "s1"), ("", "s2"), ("K", "s3"), ("Z", "none")], "line string, sn string")
    present = spark.createDataFrame([("/d/factory_raw/L/a.tdms",), ("/d/factory_raw/L/b.tdms",)], "path string")
    got = {(r["line"], r["sn"]): (r["path"], r["tdms_status"]) for r in P.resolved_paths(view, manifest, "n", present, "/d/").collect()}
    assert got == {("L", "S1"): ("/d/factory_raw/L/b.tdms", "registered"), ("M", "s1"): ("/d/factory_raw/L/b.tdms", "registered"), ("", "s2"): ("/d/factory_raw/x/c.tdms", "registered"), ("K", "s3"): (None, "missing"), ("Z", "none"): (None, "missing")}
    updates = spark.createDataFrame([("l", "S2x", "n/1.tdms"), ("L", "s1", "n/2.tdms")], "line string, sn string, relative_path string")
    after = P.with_paths(manifest, updates).collect()
    assert sorted(r["relative_path"] for r in after if (r["sn"] or "").lower() == "s1" and (r["line"] or "").strip().lower() == "l") == ["n/2.tdms"] * 3 and len(after) == 8
    assert [(r["sn"], r["tdms_storage_root"]) for r in after if r["relative_path"] == "n/1.tdms"] == [("S2x", "factory_raw")]
    shown = [r["n"] for r in P.in_order(manifest, ("M", "L")).collect()]
    assert shown[:3] == [4, 1, 6]


def test_registering_files(spark):
    manifest = spark.createDataFrame([(1, "epump2", "S0", "R", "", "", "factory_raw", "epump2/x_S0_R_1_2.tdms.zst")], MANIFEST)
    files = spark.createDataFrame([("epump2\\x_S0_R_1_2.tdms.zst",), ("epump2/x_S1_R_02012026_030405.tdms.zst",)], "relative_path string")
    out = P.registered(manifest, files, RULES, F.lit("2026-01-01T00:00:00")).collect()
    assert sorted((r["sn"], r["time"], r["created_time"], r["n"]) for r in out) == [("S0", "", "", 1), ("S1", "20260102_030405", "2026-01-01T00:00:00", None)]
    for bad, why in (("epump2/x_S1_R_1_2.tdms", "not packed"), ("nowhere/x.tdms.zst", "the line cannot be told")):
        with pytest.raises(Exception, match=why):
            P.registered(manifest, spark.createDataFrame([(bad,)], "relative_path string"), RULES, F.lit("")).collect()


def test_unregistered_files(spark):
    names = {"a": "epump2/x_S1_R_1_2.tdms.zst", "b": "epump2/x_S2_R_1_2.tdms.zst", "c": "epump2/y_S1_R_1_2.tdms.zst", "d": "q/none.tdms", "e": "epump2/x_S3_R_1_2.tdms", "p": "prototype/x_S1_R_1_2.tdms"}
    files = spark.createDataFrame([(p,) for p in names.values()], "relative_path string")
    channels = spark.createDataFrame([(names[k], "Vib Up_0", "ACC") for k in "abc"], "relative_path string, group string, channel string")
    manifest = spark.createDataFrame([(1, "epump2", "S1", "R", "", "", "factory_raw", names["a"]), (2, "epump2", "S2", "R", "", "", "other", names["b"])], MANIFEST)
    samples = spark.createDataFrame([("epump2", "S1", "S1_up", "Vib Up_0", "other"), ("epump2", "S2", "S2_up", "Vib Up_0", "ACC")], "line string, sn string, sample_id string, group_name string, channel_name string")
    found = P.unregistered(files, channels, manifest, samples, RULES)
    got = {r["relative_path"]: (r["in_manifest"], r["in_samples"], r["duplicate"]) for r in found.collect()}
    assert got == {names["a"]: (True, False, False), names["b"]: (False, True, False), names["c"]: (False, True, True), names["d"]: (None, None, False), names["e"]: (False, False, False)}
    assert P.unregistered_counts(found).first().asDict() == {"files": 5, "missing_manifest": 2, "missing_samples": 2, "missing_both": 1, "duplicates": 1, "failed": 1}
