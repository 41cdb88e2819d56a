import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm import jaccard_join as J
from tremor.llm import oracles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset()


def brute(rows, percent=85):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and 100 * shared >= percent * (len(a) + len(sets[j]) - shared) and sets[j]:
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[top(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in least[top(i)] if x is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def random_rows(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "Straße", "x" * 500]
    passage = " ".join(rng.choices(vocabulary, k=60))
    bases = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 40, 90, 200]))) for _ in range(12)]
    texts = []
    for i in range(n):
        base = rng.choice(bases[:3] if rng.random() < 0.6 else bases).split()
        if rng.random() < 0.2:
            base = rng.choices(vocabulary, k=50) + passage.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            base[rng.randrange(len(base))] = f"n{rng.randrange(5)}"
        texts.append(rng.choice([" ", "\n", "\t "]).join(base).upper() if rng.random() < 0.1 else " ".join(base))
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, *rows[:5], (None, texts[0]), (None, "only without an id here"), (900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two\x0bWORDS"), (905, "two wordz")]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, region string").repartition(4)
    got = [tuple(r) for r in J.join_classes(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == brute(rows)


@pytest.mark.parametrize("small, block, pivots", [(64, 256, 8), (2, 3, 3)])
def test_matches_brute_force(spark, monkeypatch, small, block, pivots):
    for name, value in (("SMALL", small), ("BLOCK", block), ("PIVOTS", pivots)):
        monkeypatch.setattr(J, name, value)
    check(spark, random_rows(1))


def test_matches_sql(spark):
    rows = [r for r in random_rows(2, 120) if r[0] is not None]
    rows = list(dict.fromkeys(rows))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({oracles.OP12})").fetchall(), key=repr) == brute(rows)


def test_cells_find_all_links_without_the_first_steps(spark, monkeypatch):
    """One region of all sets, no class known: pivots and blocks alone give the same classes, across several rounds."""
    for name, value in (("BLOCK", 4), ("PIVOTS", 2)):
        monkeypatch.setattr(J, name, value)
    rows = [r for r in dict.fromkeys(random_rows(3, 90)) if grams(r[1])]
    distinct = list({grams(t): (i, t) for i, (_, t) in enumerate(rows)}.values())
    ids = {}
    data = [(i, sorted(ids.setdefault(g, len(ids)) for g in grams(t))) for i, t in distinct]
    sets = spark.createDataFrame(data, "name long, grams array<long>").cache()
    none = spark.createDataFrame([], "name long, class long")
    cells = sets.select(F.lit(5).cast("long").alias("cell"), "name", F.size("grams").cast("long").alias("n"), F.lit(True).alias("own"))
    found = {r["name"]: r["class"] for r in J._split(cells, sets, none, 85).collect()}
    got = sorted(((i, len(g), found.get(i, i)) for i, g in data), key=repr)
    assert got == brute([(i, t) for i, t in distinct])


def test_shared_counts_common_grams():
    rng = np.random.default_rng(4)
    some = [np.unique(rng.integers(0, 12000, k)).astype(np.uint64) for k in (0, 1, 700, 9000, 9000)]
    assert J._shared(some[:3], some).tolist() == [[len(np.intersect1d(a, b)) for b in some] for a in some[:3]]


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "")])


def seen(monkeypatch, name):
    """The rows of the first argument of each call of a function of the module."""
    calls, function = [], getattr(J, name)

    def noted(first, *more, **named):
        calls.append(first.collect())
        return function(first, *more, **named)

    monkeypatch.setattr(J, name, noted)
    return calls


def test_sets_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    """Texts of 60 words, each of which shares one n-gram with each of twelve others, are no candidates; those of few n-grams that link by one or two are."""
    pairs = seen(monkeypatch, "_by_counts")
    both = lambda i, j: " ".join(f"p{min(i, j)}x{max(i, j)}{c}" for c in "abcd")
    unrelated = [(i, " ".join(f"{both(i, j)} own{i}x{j}" for j in range(i - 6, i + 7) if j != i)) for i in range(40)]
    base = [f"b{k}" for k in range(60)]
    linked = [(100, " ".join(base)), (101, " ".join([*base[:-1], "other"]))]
    few = [(200, "one two"), (201, "a b c d e"), (202, "a b c d e a b c d e"), (203, "p q r s t u"), (204, "p q r s t u q r s t u p")]
    rows = [*unrelated, *linked, *few]
    check(spark, rows)
    assert len(pairs[0]) < 6


def test_near_copies_that_meet_in_many_regions_come_to_few_cells(spark, monkeypatch):
    """Regions of many near copies differ by those that an edit takes out; each text goes to about one cell, not to one for each n-gram, and sets to no other rows."""
    cells, asked, of = seen(monkeypatch, "_split"), [], J._of
    monkeypatch.setattr(J, "_of", lambda rows, names: asked.append((rows.columns, of(rows, names).count(), rows.count())) or of(rows, names))
    rng = random.Random(7)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), 1 + i % 9):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{i % 40}x{k}" for k in range(50)) + f" end{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n"], r["component_id"]) for r in J.classes_of(docs, 85, 4, few=3).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert 40 <= len(cells[0]) <= 180
    assert all(kept <= 70 for columns, kept, n in asked if columns == ["name", "grams"]) and any(n >= 100 for columns, kept, n in asked if columns == ["name", "grams"])
