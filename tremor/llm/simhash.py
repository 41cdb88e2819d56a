"""SimHash near-duplicates: a Hamming self-join by the generalised pigeonhole principle.

Fingerprints that differ in at most `distance` bits are linked; a document's class is the connected
component of its fingerprint. The bits are grouped into partitions so that correlated bits share
one. If the thresholds of m partitions sum to distance - m + 1, two linked fingerprints agree within
the threshold of at least one partition (a partition with threshold -1 is not looked at). The number
of partitions and the unequal thresholds come from dynamic programming over candidate counts that
are estimated from all fingerprints. Buckets that stay large are cut by a second pigeonhole step on
their other bits, and what is still large is compared block by block, emitting a forest of links
instead of all pairs.

`similar` goes on from there to texts that share 0.8 or more of their five-word shingles. Every text of a class of near
fingerprints (over two words, which an edit changes less) is compared with the least one of its class, exactly, where enough
MinHash values agree. An edited word changes five shingles, so such texts may differ in many more than 3 bits, beyond what
partitions can find at this length: `jaccard_join.classes_of` therefore goes on from these classes and compares across them
all that can still be linked, whatever a bucket's size. No pair is missed.

Defined results. A null or empty text has fingerprint zero and is linked like any other. A row
without an id gets its text's fingerprint and component but never names one. Repeated rows stay.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import some_of, wanted_ids
from .common import bounded_batches, components, filled, settle
from .jaccard_join import classes_of
from .kernels import U64, Words, lower, mix, pieces, shingle_sets, xxh64

#: Members of a bucket up to which its pairs are joined as they are.
BUCKET = 128
#: Fingerprints in one block of the block-wise comparison.
BLOCK = 512
#: Texts of a region of the exact join whose pairs are joined as they are, where their classes differ.
FULL = 64


def simhash(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: lower-cased A-Z, word shingles with repeats, XXH64 with seed 42."""
    words = Words(lower(data), offsets)
    joined, begins = words.joined()
    spans = np.where(words.counts >= shingle, words.counts - shingle + 1, np.minimum(words.counts, 1))
    doc = np.repeat(np.arange(len(spans)), spans)
    first = np.cumsum(spans) - spans
    word = words.first[doc] + np.arange(len(doc)) - first[doc]
    until = word + np.minimum(words.counts[doc], shingle)
    hashes = xxh64(joined, begins[word], begins[until] - 1 - begins[word])
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(len(spans), U64)
    for d in np.flatnonzero(spans):
        ones = bits[first[d] : first[d] + spans[d]].sum(0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > spans[d], bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row, the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(simhash(data, offsets, shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for part in np.array_split(bits, max(1, len(bits) // 65536)):
                both += part.T @ part
            n += len(bits)
        i, j = np.indices((64, 64)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both.reshape(-1), n).astype(np.int64))], ["i", "j", "n"])

    sums = distinct.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros((64, 64)), 0
    for i, j, k in sums:
        if i < 0:
            n = k
        else:
            counts[i, j] = k
    return n, counts


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, each grown from the most uneven bit left by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [max(sorted(left), key=lambda b: abs(p[b] - 0.5))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: correlation[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def as_mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that sum to total at the least summed cost, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for (so_far, (cost, chosen)), (t, extra) in product(best.items(), options.items()):
            if so_far + t not in following or cost + extra < following[so_far + t][0]:
                following[so_far + t] = (cost + extra, [*chosen, t])
        best = following
    return best[total]


def plan(distinct: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The partitions to probe, as (bits, threshold)."""
    choices = range((distance + 2) // 2, distance + 2)
    n, both = bit_counts(distinct)
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9)
    options = {m: correlated_groups(n, both, m) for m in choices}
    masks = [(m, k, as_mask(bits)) for m, groups in options.items() for k, bits in enumerate(groups)]
    keys = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for m, k, mask in masks)))
    equal = distinct.select(keys.alias("x")).groupBy("x").agg(F.count("*").alias("c")).groupBy("x.m", "x.k").agg(F.sum(F.expr("c * (c - 1) / 2D"))).collect()
    pairs = {(m, k): c for m, k, c in equal}
    found = []
    for m, groups in options.items():
        costs = []
        for k, bits in enumerate(groups):
            near = pairs.get((m, k), 0.0)
            one, size = odds[bits].sum(), len(bits)
            two = (one**2 - (odds[bits] ** 2).sum()) / 2
            ball = {-1: 0.0, 0: n + near, 1: n * (2 + size) + near * (1 + one), 2: n * (2 + size * (size + 1) / 2) + near * (1 + one + two)}
            costs.append({t: c for t, c in ball.items() if t <= distance - m + 1})
        found.append((*allocate(costs, distance - m + 1), m))
    _, thresholds, m = min(found)
    return [(bits, t) for bits, t in zip(options[m], thresholds, strict=True) if t >= 0]


def _keys(bits: list[int], threshold: int, fp: str = "fp") -> Column:
    """The values of a partition within the threshold of a fingerprint's own."""
    own = F.col(fp).bitwiseAND(F.lit(as_mask(bits)))
    flips = [own.bitwiseXOR(F.lit(as_mask(list(some)))) for k in range(1, threshold + 1) for some in combinations(bits, k)]
    return F.array(own, *flips)


def _blocks(rows: DataFrame, distance: int) -> DataFrame:
    """Links within large buckets: every pair of blocks is compared once, by one group of rows."""
    sized = rows.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    own = sized.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.withColumn("o", other).select("part", "key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "fp", "rep")

    def run(group: pa.Table) -> pa.Table:
        fp, rep = (group.column(c).to_numpy() for c in ("fp", "rep"))
        order = np.unique(rep, return_index=True)[1]
        fp, rep = fp.view(np.uint64)[order], rep[order]
        root = np.arange(len(rep))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for i in range(len(rep)):
            for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance) + i + 1:
                a, b = top(i), top(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((rep[i], rep[j]))
        u, v = zip(*links, strict=True) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("part", "key", "lo", "hi").applyInArrow(run, "u long, v long")


def _pairs(members: DataFrame, probes: DataFrame, distance: int) -> DataFrame:
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance
    on = (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") != F.col("r.rep")) & near
    return members.alias("l").join(probes.alias("r"), on).select(F.col("l.rep").alias("u"), F.col("r.rep").alias("v"))


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v) links that connect the same fingerprints as all pairs within `distance` bits do.

    distinct has one row per fingerprint: fp and rep, the number that stands for it."""
    parts = plan(distinct, distance)
    probing = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), _keys(bits, t).alias("keys")) for k, (bits, t) in enumerate(parts))))
    probes = distinct.select("fp", "rep", probing.alias("p")).select("fp", "rep", "p.part", F.explode("p.keys").alias("key"))
    probes = probes.withColumn("own", F.col("key") == F.col("fp").bitwiseAND(_mask_of(parts)))
    sizes = probes.where("own").groupBy("part", "key").agg(F.count("*").alias("n"))
    probes = settle(probes.join(sizes.where("n > 1") if all(t == 0 for _, t in parts) else sizes, ["part", "key"]))
    small = probes.where(F.col("n") <= BUCKET)
    found = _pairs(small.where("own"), small, distance)
    large = probes.where(F.col("n") > BUCKET)
    if large.isEmpty():
        return found
    # What a large bucket's other bits hold is cut in distance + 1 again: two linked rows agree in one piece.
    rest = [[b for b in range(64) if b not in bits] for bits, _ in parts]
    pieces_of = [[as_mask(other[q :: distance + 1]) for q in range(distance + 1)] for other in rest]
    cuts = F.element_at(F.array(*(F.array(*(F.lit(x) for x in masks)) for masks in pieces_of)), F.col("part") + 1)
    cut = large.select("fp", "rep", "own", "part", "key", F.posexplode(cuts).alias("q", "mask"))
    cut = cut.select("fp", "rep", "own", (F.col("part") * (distance + 1) + F.col("q")).alias("part"), F.struct("key", F.col("fp").bitwiseAND(F.col("mask")).alias("sub")).alias("key"))
    sizes = cut.groupBy("part", "key").agg(F.count("*").alias("n"))
    cut = settle(cut.join(sizes.where("n > 1"), ["part", "key"]))
    fine = cut.where(F.col("n") <= BUCKET)
    found = found.union(_pairs(fine.where("own"), fine, distance))
    return found.union(_blocks(cut.where(F.col("n") > BUCKET), distance))


def _mask_of(parts: list[tuple[list[int], int]]) -> Column:
    return F.element_at(F.array(*(F.lit(as_mask(bits)) for bits, _ in parts)), F.col("part") + 1)


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    prints = settle(fingerprints(docs, id_col, text_col, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = distinct.where("rep is not null")
    roots = components(links(named, distance))
    classes = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "fp").select("doc_id", text, "component_id")


def _alike(pairs: DataFrame, similarity: float, buckets: int) -> DataFrame:
    """Pairs (name, other) whose sizes and MinHash values allow the similarity.

    Two texts as similar as that agree in 0.8 of the values on average; in less than 3 of 8 once in 800 times."""
    agree = F.size(F.expr("filter(zip_with(least, theirs, (a, b) -> a = b), x -> x)"))
    near = pairs.where(F.least("n", "m") >= similarity * F.greatest("n", "m")).where(agree * 3 >= buckets)
    return filled(near.select("name", "other").distinct())


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(name, shingles) of the wanted texts; wanted: name."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(some_of(batches, shared)):
            hashes, ends = shingle_sets(data, offsets, words)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["name", "shingles"])

    wanted = filled(wanted)
    shared = wanted_ids(texts, wanted.withColumnRenamed("name", "doc_id"))
    return texts.mapInArrow(sets, "name long, shingles array<long>").groupBy("name").agg(F.first("shingles").alias("shingles")).join(wanted, "name", "left_semi")


def _verified(texts: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs as links (u, v) whose texts share that part of their shingles, exactly."""
    shingles = _sets(texts, pairs.select("name").union(pairs.select("other")).distinct(), words)
    both = pairs.join(shingles, "name").join(shingles.select(F.col("name").alias("other"), F.col("shingles").alias("theirs")), "other")
    common = F.size(F.array_intersect("shingles", "theirs"))
    linked = both.where(common >= similarity * (F.size("shingles") + F.size("theirs") - common))
    return linked.select(F.col("name").alias("u"), F.col("other").alias("v"))


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, distance: int = 3, shingle: int = 2, buckets: int = 8) -> DataFrame:
    """(name, class) for each distinct text that is similar to another one: name is xxhash64 of the text, class the least name.

    docs has a column text. Texts without a word have no shingles and are similar to none but equal ones."""
    bounded_batches(docs.sparkSession)
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("doc_id"), "text")
    seeds = mix(np.arange(1, buckets + 1).astype(U64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            hashes, ends = shingle_sets(data, offsets, words)
            some = np.flatnonzero(np.diff(ends))
            least = np.stack([np.minimum.reduceat(mix(hashes ^ s), ends[some]) for s in seeds], 1) if len(some) else np.zeros((0, buckets), U64)
            at = pa.array(np.arange(0, buckets * len(some) + 1, buckets, dtype=np.int32))
            fp = simhash(data, offsets, shingle)[some].view(np.int64)
            size = np.diff(ends)[some].astype(np.int32)
            names = rows.column("doc_id").take(pa.array(some))
            yield pa.RecordBatch.from_arrays([names, pa.array(fp), pa.array(size), pa.ListArray.from_arrays(at, pa.array(least.reshape(-1).view(np.int64)))], ["name", "fp", "n", "least"])

    sketches = filled(texts.mapInArrow(sketch, "name long, fp long, n int, least array<long>").groupBy("name").agg(*(F.first(c).alias(c) for c in ("fp", "n", "least"))))
    prints = filled(sketches.groupBy("fp").agg(F.count("*").alias("k")))
    roots = components(links(prints.select("fp", F.col("fp").alias("rep")), distance))
    near = prints.join(roots, F.col("fp") == F.col("node"), "left").where("k > 1 OR root IS NOT NULL").select("fp", F.coalesce("root", "fp").alias("key"))
    dealt = filled(sketches.join(near, "fp").select("name", "n", "least", "key"))
    first = dealt.groupBy("key").agg(F.min(F.struct("name", "n", "least")).alias("one"))
    pairs = dealt.join(first, "key").where("name <> one.name").select("name", "n", "least", F.col("one.name").alias("other"), F.col("one.n").alias("m"), F.col("one.least").alias("theirs"))
    known = filled(_verified(texts, _alike(pairs, similarity, buckets), similarity, words))
    # Whatever that leaves apart is compared by the exact join, across classes.
    found = classes_of(texts, round(100 * similarity), words, known, FULL).where("NOT alone")
    return found.select(F.col("doc_id").alias("name"), F.col("component_id").alias("class")).distinct()
