import random
import re

import numpy as np

from tremor.llm import decontaminate as D


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def greedy(item, text, least):
    """Longest match first over all pairs of places; returns the covered tokens of the item."""
    free_item, free_text, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and free_item[a + n] and free_text[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return total
        total += n
        free_item[a : a + n] = [False] * n
        free_text[b : b + n] = [False] * n


def test_matches_longest_first(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 40))) for _ in range(12)]
    docs = []
    for i in range(90):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if i % 2:
            pieces = items[i % 12].split()
            cut = rng.randint(0, len(pieces))
            pieces = rng.choice([pieces, pieces[cut:] + ["x"] + pieces[:cut], pieces[: len(pieces) // 3]])
            words[len(words) // 2 : len(words) // 2] = pieces
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(500, None), (501, ""), (502, "w " * 30000)]
    table = spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, item string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in D.contaminated(table, bench).collect()}
    expected = {}
    for i, text in docs[:92]:
        for k, item in enumerate(items):
            own = tokens(item)
            share = greedy(own, tokens(text), min(5, len(own))) / len(own)
            if share >= 0.5:
                expected[i, k] = share
    assert got == expected and any(v < 1 for v in got.values())
    assert {r.doc_id for r in D.clean(table, bench).collect()} == {i for i, _ in docs} - {i for i, _ in expected}


def test_tiles_catch_reordered_pieces():
    item = np.arange(1, 31).astype(np.uint64)
    text = np.concatenate([item[20:], [99], item[:10], [98], item[10:20]]).astype(np.uint64)
    assert sorted(D.tiles(item, text, 5)) == [(0, 11, 10), (10, 22, 10), (20, 0, 10)]


def test_tiles_free_parts_of_matches_that_overlap():
    item = np.arange(1, 21).astype(np.uint64)
    text = np.concatenate([item[:7], [98, 99], item[6:14], [97]]).astype(np.uint64)
    assert sorted(D.tiles(item, text, 5)) == [(0, 0, 6), (6, 9, 8)]  # the item's seventh token is in both fragments
    rng = random.Random(4)
    for _ in range(150):
        item = np.array([rng.randint(1, 1 << 30) for _ in range(rng.randint(12, 50))], np.uint64)
        parts = []
        for _ in range(rng.randint(2, 6)):
            a = rng.randrange(len(item) - 5)
            parts += [item[a : a + rng.randint(5, 14)], np.array([rng.randint(1, 1 << 30)], np.uint64)]
        text = np.concatenate(parts)
        got = D.tiles(item, text, 5)
        free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
        for a, b, n in got:
            assert n >= 5 and free_item[a : a + n].all() and free_text[b : b + n].all() and (item[a : a + n] == text[b : b + n]).all()
            free_item[a : a + n] = free_text[b : b + n] = False
        assert sum(n for _, _, n in got) == greedy(item.tolist(), text.tolist(), 5)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert [tuple(r) for r in D.contaminated(some, bench).select("doc_id", "item_id").collect()] == [(3, 1)]
    assert D.contaminated(some, bench.limit(0)).count() == 0
