import random
import zlib

import numpy as np

from tremor.llm import rules as R


def rows(n=500):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "er", "ti", "on", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 90))]
        good = rng.random() < 0.7
        text = " ".join(words)
        if not good:
            text = rng.choice([text.upper() + "!!", " | ".join(words), " ".join(w + "%%%" for w in words), (words[0] + " ") * 60])
        docs.append((i, text, "en"))
        if rng.random() < 0.8:
            labels.append((i, int(good)))
    return docs, labels


def test_paths_of_a_printed_tree():
    printed = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 3.5)\n     If (feature 1 > 2.0)\n      Predict: 0.0\n     Else (feature 1 <= 2.0)\n      Predict: 1.0\n    Else (feature 0 > 3.5)\n     Predict: 1.0\n"
    found = {r.bounds for r in R.paths(printed)}
    inf = float("inf")
    a, b = R.STATISTICS[:2]
    first = ((a, -inf, 3.5),)
    assert found == {first, tuple(sorted([(a, -inf, 3.5), (b, 2.0, inf)])), tuple(sorted([(a, -inf, 3.5), (b, -inf, 2.0)])), ((a, 3.5, inf),)}


def test_finds_held_out_documents(spark):
    docs, labels = rows()
    table = spark.createDataFrame([*docs, (9000, None, "en"), (9001, "", "en"), (9002, "word " * 9000, "en")], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in R.classify(table, spark.createDataFrame([*labels, (3, None)], "doc_id long, quality int")).collect()}
    assert len(got) == 503 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    truth = dict(labels)
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert got[9000].score == got[9001].score


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.predicted for r in R.classify(docs, none).collect()] == [1]
    assert R.classify(docs.limit(0), none).count() == 0
