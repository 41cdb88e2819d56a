import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm import context_tree as C
from tremor.llm.common import fold_of
from tremor.llm.kernels import Words


def tokens(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def sequential(texts, depth):
    """log of the weighted probability of all training bytes, by the textbook recursion over counts."""
    counts = {}
    for text in texts:
        data = b"\n" * depth + b"".join(t + b" " for t in tokens(text)) + b"\n"
        for i in range(depth, len(data)):
            for k in range(8):
                known = (1 << k) | (data[i] >> (8 - k))
                bit = data[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((d, data[i - d : i], known), [0, 0])[bit] += 1
    return counts


def block(a, b):
    p = 0.0
    for k in range(a):
        p += math.log((k + 0.5) / (k + 1))
    for k in range(b):
        p += math.log((k + 0.5) / (a + k + 1))
    return p


def weighted(counts, depth, d, context, known, memo):
    key = (d, context, known)
    if key not in counts:
        return 0.0
    if key not in memo:
        own = block(*counts[key])
        if d == depth:
            memo[key] = own
        else:
            below = sum(weighted(counts, depth, d + 1, bytes([c]) + context, known, memo) for c in range(256))
            memo[key] = np.logaddexp(own, below) - math.log(2)
    return memo[key]


def predict(counts, depth, history, known, memo):
    one, met = 0.5, False
    for d in range(depth, -1, -1):
        context = history[len(history) - d :]
        key = (d, context, known)
        if key in counts:
            a, b = counts[key]
            own = (b + 0.5) / (a + b + 1)
            stop = 1.0 if not met else math.exp(block(a, b) - math.log(2) - weighted(counts, depth, d, context, known, memo))
            one, met = stop * own + (1 - stop) * one, True
    return one


def rows():
    rng = random.Random(3)
    words = ["Aa", "ab", "bé", "the", "x", "zz9"]
    return [(i, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(25)] + [(50, None), (51, ""), (52, "unseen words"), (53, "A" * 300)]


def test_matches_the_recursion(spark):
    depth, data = 2, rows()
    counts = sequential([t for i, t in data if not held(i)], depth)
    seen = Counter(t for i, text in data if not held(i) for t in [*tokens(text), b"\n"])
    total, types, memo = sum(seen.values()), len(seen), {}
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in data], "doc_id long, text string, score double")
    for common in (2, 1000):
        for r in C.score(docs, depth=depth, common=common).collect():
            text = dict(data)[r.doc_id]
            own = [*tokens(text), b"\n"]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(own), total)
            assert r.n_known == sum(t in seen for t in own)
            assert r.base_score == pytest.approx(sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (types + 1))) for t in own))
            stream = b"\n" * depth + b"".join(t + b" " for t in tokens(text)) + b"\n"
            expected = 0.0
            for i in range(depth, len(stream)):
                for k in range(8):
                    one = predict(counts, depth, stream[:i], (1 << k) | (stream[i] >> (8 - k)), memo)
                    expected += math.log10(one if stream[i] >> (7 - k) & 1 else 1 - one)
            assert r.score == pytest.approx(expected, rel=1e-4)


def test_predictions_sum_to_one(spark):
    docs = spark.createDataFrame([(t,) for _, t in rows()], "text string")
    tree = C.grow(*C._trained(C._grams(docs, 4, 3, 5).toArrow()), 4)
    for context in (0x61620A20, 0x7A7A3920, 0xFFFFFFFF):
        every = np.arange(256, dtype=np.uint64) | np.uint64(context << 8)
        assert np.exp2(tree.log2(every)).sum() == pytest.approx(1, abs=1e-5)


def test_the_model_keeps_every_gram(spark, monkeypatch):
    """More grams than any part or block holds; the scores are those of the tree over all of them."""
    monkeypatch.setattr(C, "BLOCK_BYTES", 1 << 18)
    rng = random.Random(8)
    data = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(1000))) for i in range(150)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    code, count = C._trained(C._grams(docs.where(~F.coalesce(fold_of("doc_id", 5) == 1, F.lit(False))), 5, 3, 7).toArrow())
    assert len(code) > 1 << 18
    tree = C.grow(code, count, 5)
    got = {r.doc_id: r.score for r in C.score(docs, depth=5).collect()}
    for i, text in data[::10]:
        raw = text.encode() + b" "
        code, _, _ = C.stream(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), 5)
        assert got[i] == pytest.approx(tree.log2(code).sum() * math.log10(2), rel=1e-5)


def test_empty_table(spark):
    assert C.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_texts_cost_less_than_by_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # With so little to learn from it takes six bytes of context; with ten times as much, five are enough.
    sums = C.score(docs, depth=6).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]
