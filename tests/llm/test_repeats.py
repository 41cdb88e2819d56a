import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tremor.llm import repeats as R


def brute(rows, span=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + span] for _, b in texts for k in range(len(b) - span + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("an", "ver", "é", "tion", "x") for b in ("ing", "ü", "ly", "o")]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 90))) for _ in range(8)]
    rows = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            text += rng.choice([p, p[cut:], p[: len(p) - cut]]) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))
            if rng.random() < 0.3 and text:
                k = rng.randrange(len(text))
                text = text[:k] + "#" + text[k + 1 :]
        rows.append((i, text))
    return rows + [(900, rows[3][1]), (901, rows[3][1]), (902, None), (903, ""), (904, "a" * 700), (905, "word " * 90), (906, "z" * 199), (907, "z" * 200), (908, "z" * 200), (909, "\0" * 300)]


@pytest.mark.parametrize(("seed", "group"), [(1, 200), (2, 3), (3, 6)])
def test_matches_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(R, "GROUP", group)
    monkeypatch.setattr(R, "HOT", 3 * group - 8)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, marks string")
    assert sorted(map(tuple, R.deduplicate(docs).collect())) == brute(rows)


def test_intervals_nest():
    assert sorted(R.intervals(np.array([3, 5, 0, 2, 2, 4]))) == [(2, 3, 6), (3, 0, 2), (4, 5, 6), (5, 1, 2)]


def test_empty_table_and_missing_ids(spark):
    assert R.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(400))
    got = R.deduplicate(spark.createDataFrame([(2, text), (2, text), (3, text[:250])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(2, 400), (2, 400), (3, 250)]
    # Rows are documents of their own, whatever their ids are.
    other = "".join(rng.choice("ghijkl") for _ in range(300))
    rows = [(1, text), (2, other), (2, text[:260]), (None, text), (None, other[:50] + "x"), (2, None)]
    got = R.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (51, 0), (260, 260), (300, 0), (400, 400), (400, 400)]
