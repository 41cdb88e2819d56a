"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and bytes beyond ASCII, with A-Z in lower case. Documents and
benchmark items are joined on the hashes of their shared seeds, `least` tokens in a row; a Bloom filter
of fixed size over the items' seeds keeps all other tokens of the documents out of the join. Each joined
pair is tiled: running Karp-Rabin hashes of the unmarked tokens find matches of a search length, the
longest ones are marked first and never overlap, what a tile leaves of another match is marked in its
turn, and the search length falls to `least`. The tiles cover a passage also where its pieces come in
another order; a document is contaminated by an item if they cover at least `coverage` of the item's
tokens.

Items with fewer than `least` tokens are looked for as wholes. Defined results. Null or empty texts
share nothing. Rows without an id are not judged. Rows that repeat an id are judged each, and the most
covered one counts. Items that repeat an id are items each, named by it. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import carried, unpack
from .common import bounded_batches, settle
from .kernels import U64, Rolling, Words, lower, mix, pieces

#: Bits of the filter over seeds (a quarter of a megabyte per 2^21).
SEED_BITS = 24
_TOKEN = np.full(256, 0x20, np.uint8)
for _range in (range(48, 58), range(97, 123), range(128, 256)):
    _TOKEN[list(_range)] = list(_range)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(_TOKEN[lower(data)], offsets)
    return words, words.hashes()


def seeds_of(data: np.ndarray, offsets: np.ndarray, least: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(document, seed) for every `least` tokens in a row; short: texts of fewer tokens have one seed for each length below too."""
    words, hashes = tokens_of(data, offsets)
    codes, doc = Rolling(hashes), words.doc_of()
    docs, seeds = [], []
    for width in range(1, least + 1):
        own = codes.every(width)
        at = np.arange(len(own))
        inside = at + width <= words.first[doc[: len(own)] + 1]
        if short and width < least:
            inside &= words.counts[doc[: len(own)]] == width
        if width == least or short:
            docs.append(doc[: len(own)][inside])
            seeds.append(mix(own[inside] + U64(width)))
    return np.concatenate(docs), np.concatenate(seeds)


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of greedy string tiling by running Karp-Rabin matching."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    item_codes, text_codes = Rolling(item), Rolling(text)
    out: list[tuple[int, int, int]] = []
    length = max(least, len(item))
    while True:
        found = _matches(item, text, free_item, free_text, item_codes, text_codes, length)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, a, b) for a, b, n in found]
        heapq.heapify(queue)
        while queue:
            n, a, b = heapq.heappop(queue)
            free = free_item[a : a - n] & free_text[b : b - n]
            if free.all():
                free_item[a : a - n] = free_text[b : b - n] = False
                out.append((a, b, -n))
                continue
            # Tokens were taken meanwhile: what is left of the match waits for its turn by its own length.
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for start, end in edges.reshape(-1, 2).tolist():
                if end - start >= length:
                    heapq.heappush(queue, (start - end, a + start, b + start))
        if length <= least:
            return out
        length = max(least, length // 2)


def _matches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, item_codes: Rolling, text_codes: Rolling, length: int) -> list[tuple[int, int, int]]:
    """Matches of at least `length` unmarked tokens, each as long as it goes, from every start that matches."""
    if len(item) < length or len(text) < length:
        return []

    def open_at(free: np.ndarray) -> np.ndarray:
        taken = np.append(0, np.cumsum(~free))
        return np.flatnonzero(taken[length:] == taken[:-length])

    at_item, at_text = open_at(free_item), open_at(free_text)
    hash_item, hash_text = item_codes.every(length)[at_item], text_codes.every(length)[at_text]
    shared = np.isin(hash_text, hash_item)
    where: dict[int, list[int]] = {}
    for a, h in zip(at_item.tolist(), hash_item.tolist(), strict=True):
        where.setdefault(h, []).append(a)
    out = []
    for b, h in zip(at_text[shared].tolist(), hash_text[shared].tolist(), strict=True):
        for a in where[h]:
            n = 0
            while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and free_item[a + n] and free_text[b + n]:
                n += 1
            if n >= length:
                out.append((a, b, n))
    return out


def near_seeds(item: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """The text's tokens that lie in a seed it shares with the item, runs of them parted by a token no text has."""
    width = min(least, len(item))
    if len(text) < width or not width:
        return text[:0]
    hit = np.isin(Rolling(text).every(width), Rolling(item).every(width))
    steps = np.zeros(len(text) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + width, 1)
    inside = np.cumsum(steps[:-1]) > 0
    starts = inside & ~np.append(False, inside[:-1])
    return np.insert(text[inside], np.flatnonzero(starts[inside]), U64(0))


def candidates(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(doc_id, item) pairs that share a seed."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            item, seed = seeds_of(data, offsets, least, True)
            yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(item)), pa.array(seed.view(np.int64))], ["item", "seed"])

    seeds = settle(items.select("item", "text").mapInArrow(of_items, "item long, seed long").distinct())
    place = F.shiftrightunsigned("seed", 64 - SEED_BITS)
    words = seeds.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("word")).toPandas()
    table = np.zeros(1 << (SEED_BITS - 6), np.int64)
    table[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    short = not items.where(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")) < least).isEmpty()

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for rows, data, offsets in pieces(batches):
            words, hashes = tokens_of(data, offsets)
            codes, doc = Rolling(hashes), words.doc_of()
            docs_, seeds_ = [], []
            for width in range(1 if short else least, least + 1):
                own = codes.every(width)
                inside = np.arange(len(own)) + width <= words.first[doc[: len(own)] + 1]
                seed = mix(own + U64(width))
                inside &= bits[(seed >> U64(64 - SEED_BITS)).astype(np.int64)]
                docs_.append(doc[: len(own)][inside])
                seeds_.append(seed[inside])
            ids = rows.column("doc_id").take(pa.array(np.concatenate(docs_)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(seeds_).view(np.int64))], ["doc_id", "seed"])

    found = docs.select("doc_id", "text").mapInArrow(of_docs, "doc_id long, seed long")
    return settle(found.where("doc_id IS NOT NULL").join(seeds, "seed").select("doc_id", "item").distinct())


_TILED = "doc_id long, item long, item_tokens int, covered int, tiles int"


def tiled(docs: DataFrame, items: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item, item_tokens, covered, tiles) for every pair that shares a seed."""
    pairs = candidates(docs, items, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(raw: bytes) -> np.ndarray:
            data = np.frombuffer(raw, np.uint8)
            return tokens_of(data, np.array([0, len(data)]))[1]

        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, U64))
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            sums: list[list[int]] = [[], [], []]
            for item, text, packed in zip(*(batch.column(c).to_pylist() for c in ("item", "item_text", "packed")), strict=True):
                if last[0] != packed:
                    last = (packed, hashed(unpack(packed)))
                if item not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[item] = hashed((text or "").encode())
                own = known[item]
                near = near_seeds(own, last[1], least)
                # What no seed touches cannot be tiled: most pairs end here.
                marks = tiles(own, near, min(least, len(own))) if len(own) and np.isin(own, near).sum() >= coverage * len(own) else []
                for k, x in enumerate((len(own), sum(n for _, _, n in marks), len(marks))):
                    sums[k].append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item"), *(pa.array(x, pa.int32()) for x in sums)], ["doc_id", "item", "item_tokens", "covered", "tiles"])

    texts = carried(docs, pairs)
    joined = pairs.join(texts, "doc_id").join(items.select("item", F.col("text").alias("item_text")), "item")
    return joined.select("doc_id", "item", "item_text", "packed").mapInArrow(run, _TILED)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, tiles, coverage): pairs whose tiles cover enough of the item."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = settle(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    share = F.col("covered") / F.col("item_tokens")
    found = tiled(docs, items, least, coverage).where(F.col("item_tokens") > 0).withColumn("coverage", share).where(F.col("coverage") >= coverage)
    best = found.groupBy("doc_id", "item").agg(F.max(F.struct("coverage", "covered", "item_tokens", "tiles")).alias("b"))
    return best.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "b.item_tokens", "b.covered", "b.tiles", "b.coverage")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; each row is judged by its own text, whatever its id."""
    named = docs.withColumn("__row", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    bad = contaminated(named.select(F.col("__row").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark, **options)
    return named.join(bad.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").drop("__row")
