import random

import xxhash
from pyspark.sql import functions as F

from tremor.llm import jaccard_join
from tremor.llm import simhash as S


def fingerprint(text):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = (text or "").encode().translate(table).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", top(i)) for i in ids}


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(60)]
    rows = []
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    return rows + ["", None, " \n\t", "One", "one", "ÉCOLE é", "x" * 100 + " " + "y" * 40]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_large_buckets_take_the_other_paths(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 4)
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = random.Random(2)
    base = [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(400)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_thresholds_cover_the_distance():
    cost, chosen = S.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 500, 1: 900}, {-1: 0, 0: 6, 1: 40}, {-1: 0, 0: 7, 1: 90}], 0)
    assert sum(chosen) == 0 and chosen[1] == -1 and cost == 5 + 40 + 7


def test_empty_table_and_missing_ids(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = S.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 4), (4, 4), (4, 4)]


def test_similar_texts_are_linked_and_no_others(spark):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("la", "mi", "so", "re")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    for k in range(60):
        own = texts[k].split()
        for _ in range(k % 4):
            if len(own) > 20:
                own[rng.randrange(len(own))] = "edited"
        texts.append(" ".join(own).upper())
    texts += [None, "", "   ", texts[3], texts[3] + " "]
    sets = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts if t is not None}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("name", S.F.xxhash64("text"))
    name = {r.text: r.name for r in docs.collect() if r.text is not None}
    found = {r["name"]: r["class"] for r in S.similar(docs.drop("name")).collect()}
    linked = [(a, b) for a in name for b in name if a < b and sets[a] and alike(a, b)]
    assert len(linked) > 30
    # Linked texts are alike to another one of their class, and nearly all that are alike are linked.
    for text, n in name.items():
        if n in found:
            assert any(alike(text, other) for other, m in found.items() for other in [next(t for t in name if name[t] == other)] if m == found[n] and other != text)
    assert sum(found.get(name[a]) is not None and found.get(name[a]) == found.get(name[b]) for a, b in linked) >= 0.9 * len(linked)
    assert S.similar(spark.createDataFrame([], "text string")).count() == 0


def test_texts_without_words(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string").coalesce(1)
    assert {tuple(r) for r in S.near_duplicates(rows).select("doc_id", "component_id").collect()} == {(1, 1), (2, 1), (3, 1)}


def test_similar_finds_what_an_exact_join_links(spark):
    """On the driver's table: of the links that an exact join needs for its classes, 0.95 and more, and none beyond."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    one = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    exact = jaccard_join.join_classes(one, percent=80, words=5).select("doc_id", "component_id")
    named = one.select("doc_id", F.xxhash64("text").alias("name")).join(exact, "doc_id")
    found = named.join(S.similar(docs.select("text")), "name", "left").withColumn("class", F.coalesce("class", "name")).cache()
    classes = found.groupBy("component_id").agg(F.count("*").alias("n"), F.count_distinct("class").alias("k"))
    needed, missed = classes.agg(F.sum(F.col("n") - 1), F.sum(F.col("k") - 1)).first()
    assert needed >= 40 and missed <= 0.05 * needed
    assert found.groupBy("class").agg(F.count_distinct("component_id").alias("k")).where("k > 1").isEmpty()


def test_large_buckets_lose_no_links(spark, monkeypatch):
    """Pairs of alike texts whose pair with the least text of the bucket is not: all lie in one bucket of fingerprints."""
    monkeypatch.setattr(S, "FULL", 4)
    rng = random.Random(5)
    common = [f"c{k}" for k in range(60)]
    texts = []
    for _ in range(12):
        own = common + [f"w{rng.randrange(10**9)}" for _ in range(40)]
        texts += [" ".join(own), " ".join([*own[:-2], "edited", "here"])]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    # One bucket holds all texts, as if their fingerprints were near.
    one = lambda distinct, distance=3: distinct.agg(S.F.min("rep").alias("v")).join(distinct.select(S.F.col("rep").alias("u"))).select("u", "v")
    monkeypatch.setattr(S, "links", one)
    found = {r["name"]: r["class"] for r in S.similar(rows, buckets=1).collect()}
    name = {r["text"]: r["name"] for r in rows.withColumn("name", S.F.xxhash64("text")).collect()}
    assert len(found) == 24 and len(set(found.values())) == 12
    assert all(found[name[a]] == found[name[b]] for a, b in zip(texts[::2], texts[1::2], strict=True))


def test_links_do_not_depend_on_buckets(spark):
    """Pairs just above the similarity, of which one MinHash value would bring only some together."""
    rng = random.Random(8)
    rows = []
    for _ in range(40):
        own = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        rows += [" ".join(own), " ".join([*own[:45], "edited", *own[46:90]])]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(map(shingles, rows[::2]), map(shingles, rows[1::2]), strict=True))
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    name = {r["text"]: r["name"] for r in docs.withColumn("name", F.xxhash64("text")).collect()}
    found = {r["name"]: r["class"] for r in S.similar(docs, buckets=1).collect()}
    assert len(set(found.values())) == 40 and all(found[name[a]] == found[name[b]] for a, b in zip(rows[::2], rows[1::2], strict=True))


def test_near_copies_come_to_few_cells(spark, monkeypatch):
    """Texts of one large group meet in regions of many n-grams, which the exact join puts together: 40 texts go to a few cells each, not to one for each n-gram."""
    cells, split = [], jaccard_join._split
    monkeypatch.setattr(S, "FULL", 3)
    monkeypatch.setattr(jaccard_join, "_split", lambda first, *more: cells.append(first.count()) or split(first, *more))
    rng = random.Random(9)
    rows = [" ".join(f"e{i}x{k}" if k in edited else f"b{k}" for k in range(150)) for i in range(40) for edited in [set(rng.sample(range(150), 2 + i % 5))]]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    S.similar(docs).collect()
    assert len(cells) == 1 and 0 < cells[0] <= 200
