import hashlib
import random

import pytest

from tremor.llm import fingerprint_index as I


def brute(rows, span=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][k : k + span]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < i:
                gone[k : k + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "a"] + [f"word{n}" for n in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 40))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.2:
            words += ["again"] * rng.randint(5, 40)
        rows.append((i * 3, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1].replace(" ", "\n")), (1002, None), (1003, ""), (2000, "x" * 3000), (2001, "é ü " * 400), (2002, "é ü " * 300)]
    return rows


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 3), (3, 4)])
def test_matches_brute_force(spark, seed, batches):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, marks string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in I.deduplicate(docs, batches=batches).collect()}
    assert got == brute(rows)


def test_empty_table_and_missing_ids(spark):
    assert I.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{n}" for n in range(20))
    got = I.deduplicate(spark.createDataFrame([(None, text), (2, text), (2, text), (3, text), (3, "shares nothing " * 20)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 20, 0), (2, 20, 0), (2, 20, 0), (3, 20, 20), (3, 40, 0)]
