import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tremor.llm import oracles
from tremor.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, key string, path int"


def brute(rows, family=5, heads=9):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(turns)] for c, turns in convs.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        now = [*convs.get(c - c % family, [])[:h], *turns[h:]]
        for d in range(len(now) + 1):
            nodes[tuple(now[:d])].append(c)
        ends[tuple(now)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items()),
        key=repr,
    )


def trie(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    return P.prefix_trie(*P.rebuilt(*P.placed(turns)))


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), 97, 104, 1001]:
        for turn in rng.sample(range(20), rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é€", "", None, "b" * 30])))
    return [*rows, *rows[:7], (None, 0, "user", "nobody's"), (2003, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_and_sql(spark, seed):
    rows = random_rows(seed)
    got = sorted((tuple(r) for r in trie(spark, rows).collect()), key=repr)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert sorted(con.execute(f"SELECT {names} FROM ({oracles.OP13})").fetchall(), key=repr) == got


def test_long_paths_cross_blocks_and_runs(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "RUN", 4)
    rows = [(c, t, "user", f"{t}") for c in (0, 1, 2) for t in range(100 + 40 * c)]
    rows += [(c, t, "user", f"{c if t > 90 else t}") for c in range(5, 60) for t in range(95)]
    assert sorted((tuple(r) for r in trie(spark, rows).collect()), key=repr) == brute(rows)


def test_empty_and_turnless(spark):
    assert trie(spark, []).count() == 0
    rows = [(c, 0, "user", "x") for c in (11, 12, 13, 16, 17)]
    assert sorted((tuple(r) for r in trie(spark, rows).collect()), key=repr) == brute(rows)
