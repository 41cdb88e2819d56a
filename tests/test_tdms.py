"""Recordings written by hand, byte by byte, and by the source itself."""

import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tremor.sources import tdms as T


def described(order, *objects):
    out = struct.pack(order + "I", len(objects))
    for path, index, properties in objects:
        out += struct.pack(order + "I", len(path)) + path.encode() + index + struct.pack(order + "I", len(properties))
        for name, kind, value in properties:
            out += struct.pack(order + "I", len(name)) + name.encode() + struct.pack(order + "I", kind) + value
    return out


def index(order, kind, n):
    return struct.pack(order + "IIIQ", 20, kind, 1, n)


def one(order, contents, body, raw, open_end=False):
    contents |= (T.METADATA if body else 0) | (T.RAW if raw else 0) | (T.BIG_ENDIAN if order == ">" else 0)
    following = T.OPEN_END if open_end else len(body) + len(raw)
    return T.TAG + struct.pack("<I", contents) + struct.pack(order + "IQQ", T.VERSION, following, len(body)) + body + raw


@pytest.mark.parametrize("order", ["<", ">"])
def test_segments_of_every_form(tmp_path, order):
    a, b, c = np.arange(6, dtype="i2"), np.linspace(-1, 1, 4), np.arange(12, dtype="f4") / 7
    rate = ("wf_increment", 10, struct.pack(order + "d", 1 / 51200))
    name = ("unit", T.TEXT, struct.pack(order + "I", 1) + b"g")
    when = ("wf_start_time", T.TIME, struct.pack("<Qq", 1 << 63, T.EPOCH + 10) if order == "<" else struct.pack(">qQ", T.EPOCH + 10, 1 << 63))
    nothing, same = struct.pack(order + "I", T.NO_DATA), struct.pack(order + "I", T.SAME_DATA)
    x, y = "/'it''s'/'x'", "/'it''s'/'y'"
    first = one(order, T.NEW_LIST, described(order, ("/", nothing, []), ("/'it''s'", nothing, [name]), (x, index(order, 2, 3), [rate, when]), (y, index(order, 10, 2), [])), a[:3].astype(order + "i2").tobytes() + b[:2].astype(order + "f8").tobytes())
    # The same channels again without a description, in two chunks; then y alone with new properties; then interleaved.
    again = one(order, 0, b"", (a[:3].astype(order + "i2").tobytes() + b[2:].astype(order + "f8").tobytes()) * 2)
    alone = one(order, T.NEW_LIST, described(order, (y, same, [name])), b[:2].astype(order + "f8").tobytes())
    mixed = one(order, T.NEW_LIST | T.INTERLEAVED, described(order, ("/'z'/'p'", index(order, 9, 3), []), ("/'z'/'q'", index(order, 9, 3), [])), c.astype(order + "f4").tobytes())
    cut = one(order, T.NEW_LIST, described(order, ("/'z'/'p'", index(order, 9, 4), [])), c[:6].astype(order + "f4").tobytes() + b"\0\0", open_end=True)
    path = tmp_path / "a.tdms"
    path.write_bytes(first + again + alone + mixed + cut)
    with path.open("rb") as file:
        found = T.describe(file)
        got = {k: np.concatenate(list(T.values(file, v, most=4))).tolist() for k, v in found.items()}
    f4 = lambda *x: np.concatenate(x).astype("f4").tolist()
    assert got == {("it's", "x"): f4(a[:3], a[:3], a[:3]), ("it's", "y"): f4(b[:2], b[2:], b[2:], b[:2]), ("z", "p"): f4(c[::2], c[:6]), ("z", "q"): f4(c[1::2])}
    assert found["it's", "x"].rate == 51200 and found["it's", "x"].properties["wf_start_time"] == 10.5
    assert found["it's", "y"].properties == {"unit": "g"} and found["z", "p"].rate is None


def test_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(path, g, "ACC", 0, rng.normal(size=n).astype("f4").tolist(), {"wf_increment": "0.0001", "unit": "g"}) for path, n in (("L1/a.tdms", 1000), ("L1/b.tdms.zst", 70000), ("L2/c.tdms", 0)) for g in ("Up", "Down")]
    frame = spark.createDataFrame(rows, "relative_path string, group string, channel string, start long, samples array<float>, properties map<string,string>")
    T.write(frame, str(tmp_path / "out"))
    (tmp_path / "out/L1/.hidden").mkdir()
    (tmp_path / "out/L1/.hidden/d.tdms").write_bytes(b"broken")
    back = T.read(spark, str(tmp_path / "out")).cache()
    assert sorted((r["relative_path"], r["group"], r["channel"], r["start"], r["samples"]) for r in back.collect()) == sorted((*r[:5],) for r in rows)
    assert {(r["rate"], r["properties"]["unit"], float(r["properties"]["wf_increment"])) for r in back.collect()} == {(10000, "g", 0.0001)}
    few = T.read(spark, str(tmp_path / "out"), groups="Up", row_values=20000).where("relative_path = 'L1/b.tdms.zst'").orderBy("start").collect()
    assert [(r["start"], len(r["samples"]), r["n"]) for r in few] == [(0, 20000, 70000), (20000, 20000, 70000), (40000, 20000, 70000), (60000, 10000, 70000)]
    assert sum((r["samples"] for r in few), []) == rows[2][4]
    metadata = T.read(spark, str(tmp_path / "out"), values="false", channels="ACC, none").collect()
    assert sorted((r["relative_path"], r["n"], len(r["samples"])) for r in metadata) == sorted((r[0], len(r[4]), 0) for r in rows)
    assert T.read(spark, str(tmp_path / "out/L1/a.tdms")).count() == 2


def test_packed_files_beyond_memory(tmp_path):
    data = T.segment(("g", "c"), np.arange(5000, dtype="f4"), {})
    (tmp_path / "a.tdms.zst").write_bytes(zstandard.compress(data))
    files, path = T._opened(str(tmp_path / "a.tdms.zst"))
    for memory in (0, 1 << 20):
        with T.seekable(files, path, memory) as file:
            assert np.array_equal(next(T.values(file, T.describe(file)["g", "c"])), np.arange(5000))


def test_replaced_channels(spark, tmp_path):
    rows = [("a.tdms", g, "ACC", s, [float(s), 1.0], {"unit": "g"}) for g in ("Up", "Down") for s in (0, 2)]
    T.write(spark.createDataFrame(rows, "relative_path string, group string, channel string, start long, samples array<float>, properties map<string,string>"), str(tmp_path / "in"))
    source = T.read(spark, str(tmp_path / "in"), row_values=3)
    T.write_replaced(source, spark.createDataFrame([("a.tdms", "Up", "ACC", [7.0])], "relative_path string, group string, channel string, samples array<float>"), str(tmp_path / "out"))
    got = {(r["group"], tuple(r["samples"]), r["properties"]["unit"]) for r in T.read(spark, str(tmp_path / "out")).collect()}
    assert got == {("Up", (7.0,), "g"), ("Down", (0.0, 1.0, 2.0, 1.0), "g")}


def test_a_failed_job_leaves_no_recordings(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("f"), "id", F.lit(".tdms")).alias("relative_path"), F.lit("g").alias("group"), F.lit("c").alias("channel"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") < 19, F.array(F.lit(1.0).cast("float"))).otherwise(F.raise_error(F.lit("lost")).cast("array<float>")).alias("samples"), F.create_map(F.lit("a"), F.lit("b")).alias("properties"))
    with pytest.raises(Exception, match="lost"):
        T.write(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or T.read(spark, str(tmp_path / "out")).count() == 0


def test_no_recording(tmp_path):
    (tmp_path / "a.tdms").write_bytes(b"x" * 40)
    with (tmp_path / "a.tdms").open("rb") as file, pytest.raises(ValueError, match="no segment"):
        T.describe(file)
