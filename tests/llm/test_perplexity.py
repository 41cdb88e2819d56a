import math
import random
from collections import Counter

import numpy as np
import pytest

from tremor.llm import perplexity as P


def rows(n=240):
    rng = random.Random(8)
    out = []
    for i in range(n):
        parts = ["an", "er", "ti", "é"] if i % 3 else ["zu", "ge", "ß"]
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 150))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\n", "|", "\t"]) for w in words)
        if i % 40 == 7:
            text = "".join(chr(rng.randint(33, 126)) + rng.choice(["", " "]) for _ in range(600))
        if i % 9 == 0:
            text += "\nsame line\n same line\nsame line\n\n"
        out.append((i, text, "de" if i % 3 == 0 else "en" if i % 3 == 1 else None))
    return [*out, (900, None, "en"), (901, "", None), (902, "x" * 5000, "en"), (903, "a b c " * 100, "only")]


def base(text):
    b = (text or "").encode()
    w = b.split()
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(again)


def test_base_rules_and_bands(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, lang string, n_words int")
    out = {r.doc_id: r for r in P.filter_quality(docs).collect()}
    assert len(out) == len(data)
    logs = {}
    for i, text, lang in data:
        r = out[i]
        stats = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        if not r.base_failed:
            logs.setdefault(lang, {})[i] = int(np.floor(r.log_perplexity * P.BINS))
    lower_median = lambda x: sorted(x)[(len(x) - 1) // 2]
    for bins in logs.values():
        middle = lower_median(bins.values())
        width = max(1.0, 5 * 1.4826 * lower_median([abs(b - middle) for b in bins.values()]))
        assert {i: out[i].kept for i in bins} == {i: middle - width <= b <= middle + width for i, b in bins.items()}
    junk = [i for i, t, _ in data if i % 40 == 7 and not out[i].base_failed]
    assert junk and not any(out[i].kept for i in junk)


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 10, 3000).astype(np.uint64) * np.uint64(16411) & np.uint64((1 << 24) - 1)
    model = P.kneser_ney(*P.counted(code))
    every = np.arange(64, dtype=np.uint64)
    for context in [*(code[:6] >> np.uint64(6)), np.uint64(123456)]:
        total = np.exp(model.log((context << np.uint64(6)) | every)).sum()
        assert total == pytest.approx(1, abs=1e-2)


def test_empty_table(spark):
    assert P.filter_quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def kneser_ney(texts):
    """Plain modified Kneser-Ney of characters of order 4: log perplexity of each text."""
    texts = ["\n" * 3 + (t or "") for t in texts]
    counts = {4: Counter(t[i - 3 : i + 1] for t in texts for i in range(3, len(t)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = {"": 1 / (len(counts[1]) + 1)}
    for k in range(1, 5):
        many = Counter(counts[k].values())
        n1, n2, n3, n4 = (max(many[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, taken = Counter(), Counter()
        for g, n in counts[k].items():
            total[g[:-1]] += n
            taken[g[:-1]] += off[min(n, 3) - 1]
        p |= {g: (n - off[min(n, 3) - 1] + taken[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g, n in counts[k].items()}
    return [-sum(math.log(p[t[i - 3 : i + 1]]) for i in range(3, len(t))) / (len(t) - 3) if len(t) > 3 else None for t in texts]


@pytest.mark.parametrize("more", [{}, {"common": 300}])
def test_perplexity_is_kneser_ney_of_characters(spark, more):
    data = [*rows(60), (904, "ÄäAaBb 漢字 🙂 " * 30, "en"), (905, "ÄäAaCc 漢学 🙁 " * 30, "en"), (906, "\n", None), (906, "🙂", None)]
    out = P.filter_quality(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3), **more).collect()
    expected = {}
    for (i, _, _), value in zip(data, kneser_ney([t for _, t, _ in data]), strict=True):
        expected.setdefault(i, []).append(value)
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r.log_perplexity)
    assert found.keys() == expected.keys()
    for i, values in expected.items():
        assert sorted(found[i], key=str) == [v if v is None else pytest.approx(v, abs=1e-8) for v in sorted(values, key=str)], i


def test_counted_grams_and_invalid_bytes(spark):
    data = np.frombuffer(b"ab\xff\xc3" + "é🙂".encode() + b"x", np.uint8)
    found = P.grams(data, np.array([0, 4, 4, len(data)]))
    shown = ["".join(map(chr, x)) for x in found.shown(np.arange(len(found.begins)))]
    assert list(found.sizes) == [4, 0, 3]
    assert shown == ["\n\n\na", "\n\nab", "\nab�", "ab��", "\n\n\né", "\n\né🙂", "\né🙂x"]
    docs = spark.createDataFrame([(t,) for _, t, _ in rows(30)], "text string")
    whole = {r.gram: r.n for r in P.count(docs).collect()}
    assert whole == Counter(t[i - 3 : i + 1] for t in ("\n" * 3 + (t or "") for _, t, _ in rows(30)) for i in range(3, len(t)))
