import random
import zlib

import numpy as np
import pytest

from tremor.llm import toxicity as T


def rows(n=600, seed=4):
    rng = random.Random(seed)
    stems = ["badword", "züglow"]
    out, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "er", "ti", "on", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))]
        toxic = rng.random() < 0.3
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(stems).upper() + rng.choice(["", "s", "er"]))
        out.append((i, " ".join(words), "en"))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    return out, labels


def test_features_are_whole_texts_and_do_not_cross():
    texts = [b"Abc  def", b"", b"x", b"abc\ndef"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    doc, feature = T.features(data, offsets)
    by = [set(feature[doc == d].tolist()) for d in range(4)]
    assert by[0] == by[3] and len(by[0]) == 6 + 5 + 4 and by[1] == set() and by[2] == set()


def test_finds_held_out_documents(spark):
    docs, labels = rows()
    table = spark.createDataFrame([*docs, (9000, None, "en"), (9001, "", "en"), (9002, "word " * 9000, "en")], "doc_id long, text string, score string")
    out = T.classify(table, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 603 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = dict(labels)
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert got[9000].score == got[9001].score and got[9000].predicted == 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in T.classify(docs, none).select("score", "predicted").collect()] == [(pytest.approx(0.0), 0)]
    assert T.classify(docs.limit(0), none).count() == 0
