import random
import subprocess
import sys
from itertools import combinations
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import decontaminate, mixing, pii
from tremor.llm.common import bounded_batches
from tremor.llm.queries import pii_key


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "é"]) for _ in range(rng.randint(1, 4)))
    items = [" ".join(word() for _ in range(25)) for _ in range(3)]
    docs, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(30, 90))]
        toxic = i % 4 == 0
        if toxic:
            words[3] = words[9] = "badword"
        if i % 10 == 1:
            words[5:5] = items[i % 3].split()
        if i % 7 == 2:
            words[7] = "60.153.215.203"
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1100 + i, docs[i][1].replace(docs[i][1].split()[40], "edited", 1), "en", "s0", 0) for i in range(90) if len(docs[i][1].split()) > 60]
    docs += [(1000 + i, docs[i][1], "en", "s0", 0) for i in range(40)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = {r.doc_id: r for r in out.collect()}
    text = dict((d[0], d[1]) for d in docs)
    assert not [i for i in rows if "badword" in (text[i] or "")]
    assert not [i for i in rows if any(item in (text[i] or "") for item in items)]
    assert not [i for i in rows if 1000 <= i < 1040] and 2000 not in rows
    assert not [i for i, r in rows.items() if "60.153.215.203" in r.text]
    # The stages by hand, on the toxicity stage's result.
    kept = corpus_pipeline.not_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == [c.split()[0] for c in columns.split(", ")]
    clean = {r.doc_id for r in kept.collect()}
    assert clean == {i for i, t in text.items() if "badword" not in (t or "")}
    rows_of = {r.doc_id: (r.text or "").lower().split() for r in kept.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in rows_of.items()}
    dropped = {b for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(dropped) >= 50
    one = corpus_pipeline.one_of_each(spark, kept, str(tmp_path))
    assert one.columns == kept.columns and {r.doc_id for r in one.collect()} == set(rows_of) - dropped
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    firsts = decontaminate.clean(kept.where(~F.col("doc_id").isin(list(dropped))), bench)
    expected = mixing.mix(pii.pseudonymise(firsts.select(kept.columns), pii_key(spark))).where("copies > 0")
    assert sorted(map(tuple, expected.select("doc_id", "text", "copies").collect())) == sorted((i, r.text, r.copies) for i, r in rows.items())


def test_rows_without_ids_repeats_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(None, text, 1, 0.5), (4, text, 2, None), (4, text, 1, 0.1), (4, "another text " + text[:90], 3, 0.2), (5, None, 1, None), (6, "", 1, None), (7, "", 1, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, copies int, score double, source string")
    got = corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == [(4, 1), (4, 3), (5, 1), (6, 1)]
    spark.createDataFrame([(1, text[:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.not_in_benchmark(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r.copies for r in clean.collect()) == [1, 1, 1, 3]
    assert corpus_pipeline.not_toxic(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.mixed(spark, docs, str(tmp_path)).columns == ["doc_id", "text", "score", "source", "size", "copies", "taken"]


def test_rows_that_are_alone_are_not_shuffled(spark):
    """Which of equal rows stays is the same; rows alone in their class stay where they are."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(3, texts[3], "b"), (30, texts[4], "a"), (None, texts[5], "a"), (None, "only one", "a"), (6, "another text", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.one_of_each(spark, docs, "")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([*rows[:20], *rows[23:]], key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_batches_to_python_are_small(spark):
    bounded_batches(spark)
    docs = spark.range(40, numPartitions=1).select(F.expr("repeat(cast(id % 10 AS string), 250000)").alias("text"))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").toArrow().column("n").to_pylist()
    assert sum(sizes) == 40 and max(sizes) * 250_000 <= 3 << 20


def test_workers_give_freed_memory_back():
    code = """
import numpy as np, pyarrow as pa
from tremor.llm.kernels import pieces
held = lambda: next(int(x.split()[1]) for x in open('/proc/self/status') if x.startswith('VmRSS')) / 1024
arrays = [np.ones(12_000) for _ in range(2000)]
del arrays[:-1]
before = held()
rows = [r.num_rows for r, _, _ in pieces([pa.record_batch({'text': ['a b', None]})])]
assert rows == [2]
print(before - held())
"""
    root = str(Path(corpus_pipeline.__file__).parent)
    assert float(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 100
