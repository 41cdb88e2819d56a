import pytest
from pyspark.sql import functions as F

from tremor.functions import text as T
from tremor.operators import label_writes as W
from tremor.operators import learning as M

EVENT = "id long, sample_pk long, timestamp string, source string, reason_key string, status string"


@pytest.fixture
def samples(spark):
    return spark.createDataFrame([(1, "A", "s1", "up"), (2, "A", "s1", "down")], "sample_pk long, line string, sn string, direction string")


def test_ids_go_on_and_broken_rows_raise(spark, samples):
    events = spark.createDataFrame([(7, 1, "t", "expert", "r", "confirmed")], EVENT)
    new = spark.createDataFrame([("A", "s1", "down", "t", "model_1", "r", None)] * 3, "line string, sn string, direction string, timestamp string, source string, reason_key string, status string")
    out = W.appended(events, new, samples).collect()
    assert len({r.id for r in out}) == 4 and min(r.id for r in out) == 7 and {r.status for r in out if r.id != 7} == {"unconfirmed"}
    for bad in (new.withColumn("sn", F.lit("s9")), new.withColumn("source", F.lit(" "))):
        with pytest.raises(Exception, match="no such sample|needs a source"):
            W.appended(events, bad, samples).collect()
    with pytest.raises(Exception, match="no such label event"):
        W.updated(events, spark.createDataFrame([(8, "expert")], "id long, source string")).collect()
    with pytest.raises(ValueError):
        W.with_status(events, events, "seen")


def test_confirming_goes_by_the_text_of_the_source(spark):
    rows = [(i, 1, "t", s, "r", "pending") for i, s in enumerate(["expert", "Expert_x", "expert.1", "expertise", "专家", "operator"])]
    events = spark.createDataFrame(rows, EVENT)
    assert [r.status for r in W.with_status(events, events, "confirmed").orderBy("id").collect()] == ["confirmed"] * 3 + ["unconfirmed"] * 3


def test_scalars(spark):
    one = spark.range(1)
    size = lambda n: one.select(T.byte_size(F.lit(n))).first()[0]
    assert [size(n) for n in (-5, 0, 1023, 1280, 1536, 3 << 50)] == ["0.0 B", "0.0 B", "1023.0 B", "1.2 KB", "1.5 KB", "3.0 PB"]
    note = lambda x: one.select(T.clean_note(F.lit(x))).first()[0]
    assert note("torque=5 measured | bearing ok") == "torque=5 measured | bearing ok"
    assert note("a|fuzzy = 0.9| |b [[prototype]]") == "[[prototype]] a | b" and note("[[prototype]]") == "[[prototype]]" and note(None) == ""
    time = lambda x, day: one.select(T.line_time(F.lit(x), F.lit(day))).first()[0]
    assert [time("05122024101112", True), time("20241205101112", True), time("2024", False), time(" UNKNOWN 20241205101112", False), time(None, True)] == ["20241205_101112", "20241205_101112", "2024", "UNKNOWN 20241205101112", ""]
    chosen = lambda *scores: one.select(M.decided(F.array(*map(F.lit, scores)), ["ok", "friction"], [1.0, 0.3], "ok")).first()[0]
    assert [chosen(0.6, 0.4), chosen(0.4, 0.6), chosen(0.2, 0.25)] == ["ok", "friction", "ok"]
