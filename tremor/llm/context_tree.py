"""Context-tree weighting over bytes: code lengths of texts, beside a word-count baseline.

A text is its tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, a space behind each, and one
end (a line feed). Each byte is eight binary decisions; each decision has one node per depth, the
context of 0 to `depth` bytes before it (line feeds before the text) together with the bits known so
far. A node estimates by Krichevsky-Trofimov from its counts and is weighted half against its
children, one byte deeper: log Pw = log(1/2 exp(log Pe) + 1/2 exp(sum of the children's log Pw)). The
share of the first term in the sum is the posterior weight of stopping there, and the model predicts
by mixing the estimates of all depths with these weights. Contexts that training never met are no part
of the tree: the longest one that it met gets what weight is left, and without any the estimate is 1/2.

Spark counts the (depth + 1)-grams of the training texts, all of them, in a table that grows with the
corpus. It is dealt by the last SHARED bytes of the context, so that all nodes of that depth and below
lie in one part and are grown there; what they weigh for their parents is summed, and only the nodes
of fewer than SHARED bytes, whose number has a bound whatever the corpus, are gathered and broadcast.
Texts are put together in blocks; the distinct codes of a block are dealt like the grams, answered
where the nodes are, and brought back to the block's texts.

The baseline counts are exact: training tokens are counted by their 64-bit hashes, the `common` most
frequent ones (a bounded table) are scored where the text is read and all others by a join.

Defined results. A null or empty text has one token, the end. Repeated rows are scored and learnt as
often as they occur; extra columns are ignored; without training texts all nodes predict 1/2 and the
baseline is log10(0.5 / 0.5) = 0 for the one unknown type. A null id is in no fold and is trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold_of, settle, stored
from .kernels import U64, Words, distinct, lower, mix, pieces
from .ngrams import by_document, codes, counted, look_up, rows_within, summed

END = 0x0A
#: Bytes of context that the nodes of one part share; nodes of fewer are gathered, 255 * 2^16 of the longest at most.
SHARED = 3
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20


def stream(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of depth + 1 bytes for all coded bytes of the texts, their documents, and the token hashes' order."""
    joined, begins = words.joined()
    n = len(words.counts)
    sizes = np.diff(begins[words.first])
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(sizes + 1 + depth, out=starts[1:])
    out = np.full(starts[-1], END, np.uint8)
    own = np.ones(starts[-1], bool)
    lead = (starts[:-1, None] + np.arange(depth)).reshape(-1)
    own[lead] = False
    own[starts[1:] - 1] = False
    out[own] = joined
    own[starts[1:] - 1] = True
    doc = np.repeat(np.arange(n), sizes + 1)
    return codes(out, depth + 1, 8)[own], doc, starts


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2, by Stirling's series after shifting x up by 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


@dataclass
class Tree:
    """For each depth the sorted nodes (context << 8 | bits known, led by a one), their weight of stopping and estimate of a one."""

    depth: int
    nodes: list[np.ndarray]
    stop: list[np.ndarray]
    one: list[np.ndarray]
    known: np.ndarray | None = None  # sorted codes of full length whose answers are kept
    answers: np.ndarray | None = None
    up: tuple[np.ndarray, np.ndarray] | None = None  # where nodes begin at some depth: the nodes above, and what these add to them

    def keep(self, code: np.ndarray) -> None:
        """Keep the answers for these codes."""
        code = distinct(code)
        parts = np.array_split(code, max(1, len(code) >> 16))
        self.known, self.answers = code, np.concatenate([self._log2(c) for c in parts]).astype(np.float32)

    def log2(self, code: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last byte of each code after the bytes before it."""
        if self.known is None:
            return self._log2(code)
        at, found = look_up(self.known, code)
        out = np.zeros(len(code))
        out[found] = self.answers[at[found]]
        out[~found] = self._log2(code[~found])
        return out

    def _log2(self, code: np.ndarray) -> np.ndarray:
        total = np.zeros(len(code))
        byte, context = code & U64(255), code >> U64(8)
        for k in range(8):
            known = (U64(1) << U64(k)) | (byte >> U64(8 - k))
            bit = ((byte >> U64(7 - k)) & U64(1)).astype(bool)
            one, met = np.full(len(code), 0.5), np.zeros(len(code), bool)
            for d in range(self.depth, -1, -1):
                key = ((context & U64((1 << 8 * d) - 1)) << U64(8)) | known
                where, found = look_up(self.nodes[d], key)
                if found.any():
                    stop, own = np.where(met, self.stop[d][where], 1.0), self.one[d][where]
                    one = np.where(found, stop * own + (1 - stop) * one, one)
                    met |= found
            total += np.log2(np.where(bit, one, 1 - one))
        return total


def _nodes(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth with their counts of zeros and ones, from ascending counted codes of depth + 1 bytes."""
    context, byte = code >> U64(8), code & U64(255)
    keys, zeros, ones = [], [], []
    for k in range(8):
        # The codes ascend, so the nodes of one number of known bits do as well.
        node = (context << U64(8)) | (U64(1) << U64(k)) | (byte >> U64(8 - k))
        new = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        bit = ((byte >> U64(7 - k)) & U64(1)).astype(bool)
        keys.append(node[new])
        zeros.append(np.add.reduceat(count * ~bit, new) if len(new) else np.zeros(0))
        ones.append(np.add.reduceat(count * bit, new) if len(new) else np.zeros(0))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def grow(code: np.ndarray, count: np.ndarray, depth: int, least: int = 0, below: tuple[np.ndarray, np.ndarray] | None = None) -> Tree:
    """The weighted tree of counted grams of depth + 1 bytes.

    least: the depth where to end; below: what the nodes of depth + 1 add to those of depth, where there are any."""
    nodes, stop, one = [np.zeros(0, U64)] * (depth + 1), [np.zeros(0)] * (depth + 1), [np.zeros(0)] * (depth + 1)
    deepest = below is None
    below_key, below = (np.zeros(0, U64), np.zeros(0)) if below is None else below
    for d in range(depth, least - 1, -1):
        short, where = np.unique(code & U64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        node, zeros, ones = _nodes(short, np.bincount(where, count, len(short)))
        own = kt_block(zeros, ones)
        children = np.zeros(len(node))
        at, found = look_up(node, below_key)
        np.add.at(children, at[found], below[found])
        leaf = d == depth and deepest
        both = own if leaf else np.logaddexp(own, children) - math.log(2)
        nodes[d], one[d] = node, ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)
        stop[d] = (np.ones(len(node)) if leaf else np.exp(own - math.log(2) - both)).astype(np.float32)
        # A node's parent drops the oldest byte of its context and keeps the known bits.
        below_key, below = (((node >> U64(8)) & U64((1 << 8 * max(d - 1, 0)) - 1)) << U64(8)) | (node & U64(255)), both
    return Tree(depth, nodes, stop, one, up=(below_key, below))


def _token_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out() -> pa.RecordBatch:
            token, n = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(np.append(token, U64(0)).view(np.int64)), pa.array(np.append(n, ends))], ["token", "c"])

        for _, data, offsets in pieces(batches):
            held.append(counted(Words(lower(data), offsets).hashes()))
            ends += len(offsets) - 1
            size += len(held[-1][0])
            if size > 500_000:
                yield out()
                held, size, ends = [], 0, 0
        if ends:
            yield out()

    return docs.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _packed(codes: np.ndarray) -> bytes:
    """Ascending codes as compressed differences, equal bytes of all of them together."""
    steps = np.diff(codes, prepend=U64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(U64).reshape(-1), dtype=U64)


def _rounded(log2: np.ndarray) -> bytes:
    """Single floats to 13 binary places of their mantissas (one part in 16,000), compressed by equal bytes of all of them."""
    raw = (log2.astype("<f4").view("<u4") + np.uint32(0x200)) & np.uint32(0xFFFFFC00)
    return zstandard.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4)[:, 1:].T).tobytes(), 1)


def _restored(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(3, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, 1:] = planes.T
    return out.view("<f4").reshape(-1)


def _dealt(code: np.ndarray, shared: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where the codes of each part stand, in their order; a part has all codes of its contexts' last `shared` bytes."""
    part = (mix((code >> U64(8)) & U64((1 << 8 * shared) - 1)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    for k in np.unique(part):
        yield int(k), order[ends[k - 1] if k else 0 : ends[k]]


_PART = "part int, block long, codes binary, counts binary"


def _part_rows(code: np.ndarray, n: np.ndarray, shared: int, parts: int) -> pa.RecordBatch:
    """Ascending codes and their counts as one row for each part."""
    rows = [(k, _packed(code[at]), zstandard.compress(n[at].astype(np.int64).tobytes(), 1)) for k, at in _dealt(code, shared, parts)]
    part, codes_, counts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([-1] * len(rows), pa.int64()), pa.array(codes_, pa.binary()), pa.array(counts, pa.binary())], ["part", "block", "codes", "counts"])


def _grams(docs: DataFrame, depth: int, shared: int, parts: int) -> DataFrame:
    """The counted grams of depth + 1 bytes of all texts, one row for each part; summed in steps before they are exchanged."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, offsets in pieces(batches):
            held.append(counted(stream(Words(lower(data), offsets), depth)[0]))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield _part_rows(*summed(held), shared, parts)
                held, size = [], 0
        if held:
            yield _part_rows(*summed(held), shared, parts)

    def merge(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_part_rows(*_trained(group), shared, parts)])

    return docs.select("text").mapInArrow(count, _PART).groupBy("part").applyInArrow(merge, _PART)


def _blocks(docs: DataFrame, depth: int, shared: int, parts: int) -> DataFrame:
    """Texts in blocks named by their first row: a row with the texts, and one for each part with the block's distinct codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, size = [], [], 0

        def out() -> pa.RecordBatch:
            block = held[0].column("row")[0].as_py()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for rows in held:
                    writer.write_batch(rows)
            code = distinct(np.concatenate(own))
            dealt = [(k, _packed(code[at])) for k, at in _dealt(code, shared, parts)]
            n = len(dealt)
            return pa.RecordBatch.from_arrays(
                [pa.array([*(k for k, _ in dealt), -1], pa.int32()), pa.array([block] * (n + 1), pa.int64()), pa.array([*(c for _, c in dealt), None], pa.binary()), pa.array([None] * n + [sink.getvalue().to_pybytes()], pa.binary())],
                ["part", "block", "codes", "texts"],
            )

        for rows, data, offsets in pieces(batches):
            held.append(rows)
            own.append(distinct(stream(Words(lower(data), offsets), depth)[0]))
            size += len(data) + 64 * rows.num_rows
            if size > BLOCK_BYTES:
                yield out()
                held, own, size = [], [], 0
        if held:
            yield out()

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, "part int, block long, codes binary, texts binary")


def _trained(group: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a part, ascending, with their counts."""
    codes_, counts = group.column("codes").to_pylist(), group.column("counts").to_pylist()
    return summed([(_unpacked(c), np.frombuffer(zstandard.decompress(n), np.int64)) for c, n in zip(codes_, counts, strict=True) if n is not None])


def _top(grams: DataFrame, depth: int, shared: int) -> Tree:
    """The nodes of fewer than `shared` bytes of context, from all counts and what the nodes below add."""
    if not shared:
        return Tree(0, [], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            code, count = _trained(row)
            key, below = grow(code, count, depth, shared).up
            key, where = np.unique(key, return_inverse=True)
            short, at = np.unique(code & U64((1 << 8 * shared) - 1), return_inverse=True)
            both = np.append(np.bincount(where, below, len(key)), np.bincount(at, count, len(short)))
            node = np.append(np.ones(len(key), bool), np.zeros(len(short), bool))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.append(key, short).view(np.int64)), pa.array(both)], ["node", "key", "x"])

    sums = grams.mapInArrow(run, "node boolean, key long, x double").groupBy("node", "key").agg(F.sum("x").alias("x")).toPandas()
    node = sums["node"].to_numpy(bool)
    key, x = sums["key"].to_numpy(np.int64).view(U64), sums["x"].to_numpy(np.float64)
    return grow(key[~node], x[~node], shared - 1, 0, (key[node], x[node]))


def _answered(rows: DataFrame, depth: int, shared: int, top) -> DataFrame:
    """(block, part, answers): for the codes that each block asks for, in their order, the model's log2."""

    def run(group: pa.Table) -> pa.Table:
        own = grow(*_trained(group), depth, shared)
        above = top.value
        tree = Tree(depth, above.nodes + own.nodes[shared:], above.stop + own.stop[shared:], above.one + own.one[shared:])
        asked = group.filter(pc.is_null(group.column("counts")))
        wanted = [_unpacked(c) for c in asked.column("codes").to_pylist()]
        if wanted:
            tree.keep(np.concatenate(wanted))
        found = [_rounded(tree.answers[look_up(tree.known, w)[0]]) for w in wanted]
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "answers": pa.array(found, pa.binary())})

    return rows.groupBy("part").applyInArrow(run, "block long, part int, answers binary")


def _score(answered: DataFrame, texts: DataFrame, depth: int, shared: int, parts: int, common) -> DataFrame:
    """Per document (row id): the model's log2, sums over common tokens, and the tokens left for a join."""
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<struct<token:bigint,k:bigint>>"

    def run(group: pa.Table) -> pa.Table:
        tokens, log_count, seen = common.value
        steps = []
        for batch in (b for raw in group.column("texts").to_pylist() if raw is not None for b in pa.ipc.open_stream(raw)):
            for rows, data, offsets in pieces([batch]):
                for a, b in rows_within(rows.num_rows, 8 * (depth + 1)):
                    words = Words(lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                    steps.append((rows.slice(a, b - a), words, *stream(words, depth)[:2]))
        # The block's codes as they were dealt; each part has answered its own in their order.
        code_of = distinct(np.concatenate([distinct(code) for _, _, code, _ in steps]))
        answers = {k: x for k, x in zip(group.column("part").to_pylist(), group.column("answers").to_pylist(), strict=True) if x is not None}
        log2 = np.zeros(len(code_of))
        for k, at in _dealt(code_of, shared, parts):
            log2[at] = _restored(answers.pop(k))
        done = []
        for part, words, code, doc in steps:
            n = part.num_rows
            owner, code, count = by_document(code, doc, 8 * (depth + 1))
            score = np.bincount(owner, log2[look_up(code_of, code)[0]] * count, n) * math.log10(2)
            # Tokens by document: the end is a token of every text.
            token = np.append(words.hashes(), np.zeros(n, U64))
            owner = np.append(words.doc_of(), np.arange(n))
            order = np.lexsort((token, owner))
            token, owner = token[order], owner[order]
            new = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
            k = np.diff(np.append(new, len(token)))
            token, owner = token[new], owner[new]
            at, hit = look_up(tokens, token)
            known = np.bincount(owner[hit], k[hit] * seen[at[hit]], n).astype(np.int64)
            logs = np.bincount(owner[hit], k[hit] * log_count[at[hit]], n)
            rest = ~hit
            ends = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(owner[rest], minlength=n), out=ends[1:])
            rare = pa.StructArray.from_arrays([pa.array(token[rest].view(np.int64)), pa.array(k[rest].astype(np.int64))], ["token", "k"])
            done.append(
                pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(words.counts + 1), pa.array(known), pa.array(logs), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), rare)],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare"],
                )
            )
        return pa.Table.from_batches(done)

    both = answered.select("block", "part", "answers", F.lit(None).cast("binary").alias("texts")).union(texts.select("block", "part", F.lit(None).cast("binary").alias("answers"), "texts"))
    return both.groupBy("block").applyInArrow(run, schema)


def frequent(tokens: DataFrame, most: int) -> int:
    """The least count that at most `most` tokens reach, from the counts of counts."""
    levels = tokens.groupBy("c").agg(F.count("*").alias("k")).withColumn("power", F.floor(F.log2("c")).cast("int"))
    left, above = most, None
    for r in levels.groupBy("power").agg(F.sum("k").alias("k")).orderBy(F.desc("power")).collect():
        if r.k > left:
            # Within this power of two: its counts from above, in 64 steps.
            low = 1 << r.power
            size = max(1, low // 64)
            steps = levels.where(F.col("power") == r.power).groupBy(F.floor((F.col("c") - low) / size).alias("s")).agg(F.sum("k").alias("k")).orderBy(F.desc("s")).collect()
            for q in steps:
                if q.k > left:
                    break
                left, above = left - q.k, low + int(q.s) * size
            break
        left, above = left - r.k, 1 << r.power
    return above if above is not None else (1 << 62)


def score(docs: DataFrame, folds: int = 5, held: int = 1, depth: int = 5, common: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row; texts whose id's crc32 modulo folds is not `held` train the models."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)))
    train = docs.where(~F.col("held_out"))
    sc, shared = spark.sparkContext, min(SHARED, depth)
    # A part answers what about eight blocks ask for.
    parts = 64 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (8 * BLOCK_BYTES)
    grams = stored(_grams(train, depth, shared, parts), "grams")
    above = _top(grams, depth, shared)
    blocks = stored(_blocks(docs.withColumn("row", F.monotonically_increasing_id()), depth, shared, parts), "blocks")
    tokens = settle(_token_counts(train))
    total, types = tokens.agg(F.sum("c"), F.count("*")).first()
    total, types = total or 0, types or 0
    top = tokens.where(F.col("c") >= frequent(tokens, common)).toPandas().sort_values("token", key=lambda s: s.to_numpy().view(np.uint64))
    table = (top["token"].to_numpy().view(np.uint64), np.log10(top["c"].to_numpy(np.float64) + 0.5), np.ones(len(top), np.int64))
    asked = blocks.where("part >= 0").select("part", "block", "codes", F.lit(None).cast("binary").alias("counts"))
    answered = _answered(grams.union(asked), depth, shared, sc.broadcast(above))
    scored = settle(_score(answered, blocks.where("part < 0"), depth, shared, parts, sc.broadcast(table)))
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(tokens, "token", "left")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs2"))
    norm = math.log10(total + 0.5 * (types + 1))
    base = F.col("logs") + F.coalesce("logs2", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return scored.drop("rare").join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
