"""Splits and folds against plain versions of the same rules."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import strategies as S


def die(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def make(seed, n=300, references=12):
    rng = random.Random(seed)
    return [(i, f"L{rng.randrange(3)}", f"R{rng.randrange(references)}", f"S{rng.randrange(70)}", rng.choices(["ok", "noise", "tick"], [8, 3, 1])[0]) for i in range(n)]


SCHEMA = "id long, line string, reference string, sn string, label string"


def penalty(full, seen, rows, target):
    total = sum(full.values())
    score = 2 * abs(rows - target) / max(target, 1)
    for x, n in full.items():
        expected = n * target / total
        score += 3 * abs(seen[x] / max(rows, 1) - n / total) + 1.5 * abs(seen[x] - expected) / max(expected, 1) + (8 if expected >= 0.75 and not seen[x] else 0)
    return score


def best_groups(rows, share, trials, seed, group, line=None):
    groups = sorted({group(r) for r in rows})
    full, best = Counter(r[4] for r in rows), None
    k = min(max(math.ceil(len(groups) * share - 1e-9), 1), len(groups) - 1)
    for trial in range(trials):
        test = set(sorted(groups, key=lambda g: (die(g, seed, trial), g))[:k])
        t, r = Counter(x[4] for x in rows if group(x) in test), Counter(x[4] for x in rows if group(x) not in test)
        target = len(rows) * share
        score = penalty(full, r, sum(r.values()), len(rows) - target) + penalty(full, t, sum(t.values()), target)
        if line:
            for name in {line(x) for x in rows}:
                of = {group(x) for x in rows if line(x) == name}
                if len(of) > 1:
                    score += 2 * (not of & test) + 2 * (not of - test)
        best = min(best, (round(score, 9), trial, test)) if best else (round(score, 9), trial, test)
    return best[2]


def test_names_of_strategies():
    assert [S.strategy(x) for x in ("Reference-In", "lineout", None, "what", " SAMPLE level ", "nan")] == ["reference_in", "line_out", "reference_out", "reference_out", "stratified", "reference_out"]


def test_sides_by_score(spark):
    rows = make(1)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["split"] for r in S.split_rows(frame, "reference_out", "label", F.col("id"), trials=10, seed=3).collect()}
    key = lambda r: f"{r[1]}::{r[2]}"
    test = best_groups(rows, 0.1, 10, 3, key, lambda r: r[1])
    pool = [r for r in rows if key(r) not in test]
    check = best_groups(pool, 0.125, 10, 3, key)
    assert got == {r[0]: "test" if key(r) in test else "validation" if key(r) in check else "train" for r in rows}


def test_too_few_groups(spark):
    one = spark.createDataFrame([(i, "L", "R", f"S{i}", "ok") for i in range(9)], SCHEMA)
    with pytest.raises(ValueError, match="two groups"):
        S.split_rows(one, "line_out", "label", F.col("id"))
    two = spark.createDataFrame([(i, f"L{i % 2}", "R", f"S{i}", "ok") for i in range(20)], SCHEMA)
    out = S.split_rows(two, "line_out", "label", F.col("id")).collect()
    assert {r["split"] for r in out} == {"train", "validation", "test"}
    assert len({r["line"] for r in out if r["split"] == "test"}) == 1 and len({r["line"] for r in out if r["split"] != "test"}) == 1
    blank = spark.createDataFrame([(i, None, " none ", f"S{i}", "ok") for i in range(30)], SCHEMA)
    assert {r["split"] for r in S.split_rows(blank, "reference_out", "label", F.col("id")).collect()} == {"train", "validation", "test"}


def test_serials_stay_together_with_their_copies(spark):
    rows = [(i, "L", f"R{i % 2}", f"S{i}" if i < 40 else f"S{i - 40}aug", "ok", "" if i < 40 else f"S{i - 40}") for i in range(80)]
    frame = spark.createDataFrame(rows, SCHEMA + ", source_sn string")
    out = S.split_rows(frame, "reference_in", "label", F.col("id"), trials=8, source_sn="source_sn").collect()
    sides = defaultdict(set)
    for r in out:
        sides[r["source_sn"] or r["sn"]].add(r["split"])
    assert all(len(x) == 1 for x in sides.values()) and len(set().union(*sides.values())) == 3


def test_folds_within_references(spark):
    rows = make(2, 400, 4) + [(1000 + i, "L9", "one", f"T{i // 3}", "ok") for i in range(12)]
    k, seed = 3, 5
    got = {r["serial"]: r["fold"] for r in S.folds_within(spark.createDataFrame(rows, SCHEMA), F.concat_ws("::", "line", "reference"), F.concat_ws("::", "line", "reference", "sn"), "label", k, seed).collect()}
    serials = defaultdict(Counter)
    for _, line, reference, sn, label in rows:
        serials[f"{line}::{reference}", f"{line}::{reference}::{sn}"][label] += 1
    outer = defaultdict(list)
    for (reference, serial), counts in serials.items():
        outer[reference].append((serial, min(counts, key=lambda x: (-counts[x], x)), sum(counts.values())))
    expected = {}
    for members in outer.values():
        n = Counter(label for _, label, _ in members)
        even = len(n) > 1 and min(n.values()) >= k
        of, sizes = defaultdict(lambda: [0] * k), [0] * k
        for turn, (serial, label, rows_of) in enumerate(sorted(members, key=lambda m: (m[1] if even else "", die(m[0], seed), m[0]))):
            fold = turn % k if even else min(range(k), key=lambda f: (of[label][f], sizes[f], f))
            of[label][fold] += rows_of
            sizes[fold] += rows_of
            expected[serial] = fold
    assert got == expected


def test_empty_folds_are_repaired(spark):
    rows = spark.createDataFrame([(i, "L", f"R{i}", "S", "ok") for i in range(6)], SCHEMA)
    sizes = Counter(r["fold"] for r in S.folds_within(rows, F.col("reference"), F.col("reference"), "label", 4).collect())
    assert sizes == {0: 3, 1: 1, 2: 1, 3: 1}


def test_group_folds(spark):
    rows = make(3, 500, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["group"]: r["fold"] for r in S.group_folds(frame, F.concat_ws("::", "line", "reference"), "label", 4, 1).collect()}
    counts = defaultdict(Counter)
    for r in rows:
        counts[f"{r[1]}::{r[2]}"][r[4]] += 1
    names = ["noise", "ok", "tick"]
    every = np.array([sum(c[x] for c in counts.values()) for x in names], float)
    rarest = min(sum(x in c for c in counts.values()) for x in names)
    k = min(4, rarest)
    have, sizes, expected = np.zeros((k, 3)), [0] * k, {}
    for g in sorted(counts, key=lambda g: (-np.std([counts[g][x] for x in names]), die(g, 1), g)):
        own = np.array([counts[g][x] for x in names])
        scores = []
        for f in range(k):
            have[f] += own
            scores.append((round(float(np.mean(np.std(have / every, axis=0))), 12), sizes[f], f))
            have[f] -= own
        best = min(scores)[2]
        have[best] += own
        sizes[best] += own.sum()
        expected[g] = best
    assert found == expected
    lone = spark.createDataFrame([(i, "L", f"R{i % 5}", "S", "ok" if i else "tick") for i in range(30)], SCHEMA)
    assert Counter(r["fold"] for r in S.group_folds(lone, F.col("reference"), "label", 3).collect()) == {0: 2, 1: 2, 2: 1}
    with pytest.raises(ValueError, match="too few"):
        S.folds(lone, "stratified", "label", F.col("id"), 3)


def test_row_folds(spark):
    rows = make(4, 200)
    out = S.folds(spark.createDataFrame(rows, SCHEMA), "stratified", "label", F.col("id"), 4).collect()
    for label in ("ok", "noise", "tick"):
        sizes = Counter(r["fold"] for r in out if r["label"] == label)
        assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 1


def test_core_pool_and_drawn_sides(spark):
    rows = make(5, 400, 5)
    group = lambda r: f"{r[1]}::{r[2]}::{r[3]}"
    frame = spark.createDataFrame(rows, SCHEMA)
    counts = frame.groupBy(F.concat_ws("::", "line", "reference", "sn").alias("group"), "label").agg(F.count("*").alias("n"))
    targets, seed = {"ok": 60, "noise": 20, "tick": -1, "never": 5}, 4
    got = {r["group"] for r in S.core_pool(counts, targets, 0.1, 0.125, 8, seed).collect()}
    table = defaultdict(Counter)
    for r in rows:
        table[group(r)][r[4]] += 1
    names, have = ["ok", "noise", "tick"], Counter(r[4] for r in rows)
    target = np.array([min(have["ok"], math.ceil(60 / (0.9 * 0.875))), min(have["noise"], math.ceil(20 / (0.9 * 0.875))), have["tick"]])
    must = {g for g, c in table.items() if c["tick"]}
    vector = lambda g: np.array([table[g][x] for x in names])
    best = None
    for trial in range(8):
        sums, taken = sum(vector(g) for g in must), []
        for g in sorted(set(table) - must, key=lambda g: (die(g, seed, trial), g)):
            missing = sums < target
            if missing.any() and vector(g)[missing].sum():
                taken.append(g)
                sums = sums + vector(g)
        kept = set(must)
        for g in reversed(taken):
            if (sums - vector(g) >= target).all():
                sums = sums - vector(g)
            else:
                kept.add(g)
        score = (np.maximum(target - sums, 0).sum(), np.maximum(sums - target, 0).sum(), trial)
        best = min(best, (score, kept), key=lambda x: x[0]) if best else (score, kept)
    assert got == best[1]

    def other(test):
        t, r = Counter(x[4] for x in rows if group(x) in test), Counter(x[4] for x in rows if group(x) not in test)
        a, b = sum(t.values()), sum(r.values())
        score = abs(a - len(rows) * 0.2) / len(rows)
        for x, n in have.items():
            score += abs(r[x] / max(b, 1) - n / len(rows)) + abs(t[x] / max(a, 1) - n / len(rows)) + abs(t[x] - n * 0.2) / len(rows) + (5 if not r[x] else 0)
        return round(score, 9)

    draws = [{g for g in table if die(g, seed, trial) < 0.2} for trial in range(8)]
    least = min(range(8), key=lambda k: (other(draws[k]), k))
    assert {r["group"] for r in S.drawn_sides(counts, 0.2, 8, seed).where("test").collect()} == draws[least]
    nothing = S.drawn_sides(counts, 1e-9, 8, seed).where("test").collect()
    assert len(nothing) == 1


def test_pooled_split_and_what_is_left(spark):
    frame = spark.createDataFrame(make(6, 400, 5), SCHEMA).withColumn("sample_id", F.col("id").cast("string"))
    out = S.pooled_split(frame, F.concat_ws("::", "line", "sn"), "label", {"ok": 50, "noise": -1}, trials=8).persist()
    assert {r["label"] for r in out.select("label").distinct().collect()} == {"ok", "noise"}
    assert out.groupBy(F.concat_ws("::", "line", "sn")).agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    rest = S.rest_for_evaluation(frame, out)
    assert rest.count() == frame.count() - out.where("split IN ('train', 'test')").count()
