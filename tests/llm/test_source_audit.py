import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tremor.llm import oracles
from tremor.llm import source_audit as S

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def terms(text):
    return [t.lower().decode() if t.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), t).decode() for t in TERM.findall((text or "").encode())]


def brute(rows, least, top):
    docs, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = terms(text)
        langs[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        q = {t: sum(n[s][t] for s in sources) for t in kept}

        def share(c):
            return {t: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * len(kept)) for t, k in c.items()}

        p, q = {s: share(n[s]) for s in sources}, share(q)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            best = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, r + 1) for part, found in (("pair", pairs), ("term", best)) for r, (v, item) in enumerate(found)]
    return sorted(out)


def random_rows(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "é", "École", "of", "x" * 300, "日本", "a1b", "under_score", "z", *(f"w{chr(97 + k)}{chr(97 + k % 7)}" for k in range(20))]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "en", "fr", None, "rare"] if i % 50 == 0 else ["en", "en", "fr"]), rng.choice(["src0", "src0", "B", "é", None])) for i in range(n)]
    return [*rows, *rows[:9], (None, "en", "silent"), ("", None, None), ("tie tie", "en", "src0")]


def check(spark, rows, least=10, top=4):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, docs int, term string").repartition(4)
    got = [tuple(r) for r in S.divergence(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute(rows, least, top)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    check(spark, random_rows(seed))


def test_languages_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 2)
    check(spark, random_rows(3))


def test_matches_sql(spark):
    rows = random_rows(4, 900)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({oracles.OP11})").fetchall()) == brute(rows, 30, 50)


def test_trie_walks_in_byte_order():
    rng = random.Random(5)
    some = list({bytes(rng.choices(b"ab\xc3\xff", k=rng.randrange(1, 9))) for _ in range(400)})
    trie = S.Trie()
    numbers = {t: trie.add(t) for t in [*some, *some]}
    assert sorted(numbers.values()) == list(range(len(some)))
    assert list(trie.walk()) == [(t, numbers[t]) for t in sorted(some)]


def test_tries_written_early_fold_to_the_same(monkeypatch):
    rows = random_rows(6)
    batch = pa.RecordBatch.from_pydict({"text": [r[0] or "" for r in rows], "lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows]})

    def folded(parts):
        table = pa.Table.from_batches(list(parts)).sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks().to_batches()[0]
        return {(r["lang"], r["term"]): (r["docs"], dict(zip(r["sources"], r["counts"], strict=True))) for r in S._folded(table).to_pylist()}

    once = folded(S._count([batch]))
    monkeypatch.setattr(S, "LEAVES", 5)
    assert folded(S._count([batch.slice(k, 7) for k in range(0, batch.num_rows, 7)])) == once


def test_strips_give_the_pairs_of_all_sources(monkeypatch):
    rng = np.random.default_rng(7)
    sources, n = [f"s{k}" for k in range(7)], 50
    counts = rng.integers(0, 4, (n, 7))
    rows = S._batch(["en"] * n, [f"t{k:02}" for k in range(n)], np.ones(n, np.int64), pa.array(sources * n), counts.reshape(-1), np.full(n, 7))
    totals = counts.sum(0).tolist()

    def results(strips):
        out = []
        for strip in range(strips):
            audit = S._Audit("en", strip, sources, totals, n, 5)
            audit.add(rows)
            out += [tuple(r.values()) for r in audit.result().to_pylist()]
        return sorted(out)

    whole = results(1)
    monkeypatch.setattr(S, "STRIP", 3)
    monkeypatch.setattr(S, "CELLS", 60)
    assert results(3) == whole


def test_shares_are_exact():
    count, total = np.array([0, 1, 10**15, 8 * 10**15 - 5]), 8 * 10**15
    assert S.share(count, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in count]


def test_empty_table(spark):
    check(spark, [])
