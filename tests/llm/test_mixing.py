import random

import duckdb
import pytest

from tremor.llm import mixing as M
from tremor.llm import oracles


def rows(seed, docs=400):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "tiny"]
    out = []
    for i in range(docs):
        source = rng.choices(sources, [40, 10, 10, 5, 5, 1])[0]
        out.append((i, None if rng.random() < 0.03 else rng.choice([" ", "\n"]).join(["w"] * int(rng.paretovariate(0.9))), source))
    return [*out, (1000, "", "a"), (1001, "x " * 5000, "tiny"), (1002, None, "nothing")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sql(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, extra int")
    mixed = M.mix(docs)
    got = sorted(tuple(r) for r in mixed.select("doc_id", mixed["taken"], mixed["target"], mixed["copies"]).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
    expected = sorted(con.execute(f"SELECT doc_id, taken, target, copies FROM ({oracles.OP6})").fetchall())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in expected]
    assert [t for _, _, t, _ in got] == pytest.approx([t for _, _, t, _ in expected])


def test_targets_are_met(spark):
    data = [(i, "w " * (1 + i * 7919 % 400), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = M.mix(docs).collect()
    by = {}
    for r in out:
        assert 0 <= r.copies <= 2
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(s for _, _, s in by.values()))
    assert all(abs(t - taken) <= 400 for t, taken, _ in by.values())


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
