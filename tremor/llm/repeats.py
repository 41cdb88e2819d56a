"""Repeated byte strings: maximal repeats from enhanced suffix arrays around shared anchors.

A byte is removed if a string of `span` bytes over it also starts anywhere else, in the same
document or another. Only suffixes that begin at anchors (anchors.py) are arranged: a gram that
occurs in one context only needs nothing, equal contexts are repeats as a whole, and for a gram with
several contexts the suffixes from it are sorted into an enhanced suffix array. A stack scan over its
common prefixes gives the tree of intervals; within an interval, whose members agree to the right,
the bytes to the left are tested for diversity: members that agree far enough to the left form a
maximal repeat, reported with all its occurrences. The windows around a gram are cut into a few parts,
each keyed by all bytes that its windows share, so a suffix array only holds what may be equal. Keys
of very many parts are cut on, to distinct parts and then to single windows, so that no task holds an
unbounded group.

Defined results. A null or empty text has no bytes. Every row is a document of its own, whether its id
is missing or repeated: rows are told apart by a 64-bit hash of id and text, equal rows being places of
one another. Texts of any length are taken whole, one at a time. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors as A
from .carry import carried, unpack, unpacked
from .common import bounded_batches, small, stored
from .kernels import U64, byte_rolling, covered, mix, pieces, repeated

#: Bytes in the gram that anchors a window. Short grams recur by chance the oftener the larger the corpus is, and
#: every context of a gram that recurs is exchanged; long ones make more anchors, 2 / (span - GRAM + 2) of all places.
GRAM = 96
#: Parts of one key that one suffix array holds.
GROUP = 200
#: Parts into which the windows around an anchor are cut.
PARTS = 3
#: Places of a gram up to which they are decided together.
HOT = 1000
#: Marks of a class: its windows are repeats; its one window range is to be compared; both, for others to compare with.
REPEAT, OPEN, SOURCE = 0, 1, 2
_RESULT = "doc_id long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> A.Anchors:
    return A.find(byte_rolling(data), offsets, span, GRAM)


def fingerprints(docs: DataFrame, span: int) -> DataFrame:
    """(gram, kind, sides, doc_id, n): the anchored classes of each document, and how often each occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            found = _anchors(data, offsets, span)
            own, counts = A.distinct(found)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)[found.doc[own]]
            sides = (found.left[own] << U64(32)) | found.right[own]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (found.gram[own], found.kind[own], sides)), pa.array(ids), pa.array(counts)], ["gram", "kind", "sides", "doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "gram long, kind long, sides long, doc_id long, n long")


def marks_of(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, mark): what each class of windows in a document is, for classes that may hold repeats.

    Grams of up to HOT places are decided by window functions in one stage; the places of more frequent
    grams, few grams but perhaps many places, by aggregates and joins that may be split."""
    rows = fingerprints(docs, span)
    often = stored(rows.groupBy("gram").agg(F.sum("n").alias("m")).where("m > 1"), "grams")
    hot = small(often.where(F.col("m") > HOT).select("gram"))
    some = rows.join(hot, "gram", "left_anti").join(often.where(F.col("m") <= HOT).select("gram"), "gram")
    own, left, right = (Window.partitionBy("gram", c) for c in ("kind", "left", "right"))
    some = some.withColumns({"left": F.shiftrightunsigned("sides", 32), "right": F.col("sides").bitwiseAND(F.lit((1 << 32) - 1))})
    some = some.withColumns({"total": F.sum("n").over(own), "rep": F.min("doc_id").over(own)})
    for side, by in (("left", left), ("right", right)):
        some = some.withColumn(f"{side}_open", (F.col(side) != 0) & (F.min("kind").over(by) < F.max("kind").over(by)))
    marks = _marked(some.withColumn("open", F.col("left_open") | F.col("right_open")))
    if not hot.isEmpty():
        rows = stored(rows.join(hot, "gram", "left_semi"), "hot")
        classes = rows.groupBy("gram", "kind").agg(F.sum("n").alias("total"), F.min("doc_id").alias("rep"), F.first("sides").alias("sides"))
        both = F.array(F.shiftrightunsigned("sides", 32), -F.col("sides").bitwiseAND(F.lit((1 << 32) - 1)))
        side = classes.select("gram", "kind", F.explode(both).alias("side")).where("side <> 0")
        shared = side.groupBy("gram", "side").agg(F.count("*").alias("k")).where("k > 1")
        opened = side.join(shared, ["gram", "side"], "left_semi").select("gram", "kind").distinct().withColumn("open", F.lit(True))
        classes = classes.join(opened, ["gram", "kind"], "left").withColumn("open", F.col("open").isNotNull())
        marks = marks.union(_marked(rows.join(classes.drop("sides"), ["gram", "kind"])))
    return stored(marks, "marks")


def _marked(rows: DataFrame) -> DataFrame:
    mark = F.when(F.col("total") == 1, OPEN).when(F.col("doc_id").eqNullSafe(F.col("rep")) & F.col("open"), SOURCE).otherwise(REPEAT)
    return rows.where("total > 1 OR open").select("doc_id", (A.name() + mark).alias("mark"))


_PART = "key:bigint,at:int,lo:int,hi:int,low:int,least:int,ends:binary"
_OPENED = f"doc_id long, spans array<int>, parts array<struct<{_PART}>>"


def _open(docs: DataFrame, marks: DataFrame, span: int) -> DataFrame:
    """Each marked document with its repeated spans and the parts to compare.

    A part holds those windows of an open class that begin `low` to `low` + `least` bytes before the gram.
    All of them share the bytes that its key hashes; `ends` are the bytes on either side that only some cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            codes = byte_rolling(data)
            found = A.find(codes, offsets, span, GRAM)
            lists = rows.column("marks")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = A.marked(found, marks, np.repeat(np.arange(len(sizes)), sizes))
            n, base = len(sizes), offsets[found.doc]
            begin, end = found.at - found.hi, found.at - found.lo + span
            hit = np.flatnonzero((bits == REPEAT) | (bits == SOURCE))
            spans = np.stack([begin[hit] - base[hit], end[hit] - base[hit]], axis=1).reshape(-1)
            ends = np.zeros(n + 1, np.int32)
            np.cumsum(2 * np.bincount(found.doc[hit], minlength=n), out=ends[1:])
            asked = np.flatnonzero((bits == OPEN) | (bits == SOURCE))
            asked = asked[np.sort(np.unique(A.in_document(found.kind[asked], found.doc[asked]), return_index=True)[1])]
            size = -(-(span - GRAM + 1) // PARTS)
            first = found.lo[asked] // size
            count = found.hi[asked] // size - first + 1
            row = np.repeat(asked, count)
            part = np.repeat(first, count) + repeated(count)
            low = part * size
            high = np.minimum(low + size - 1, span - GRAM)
            lo, hi, at = np.maximum(found.lo[row], low), np.minimum(found.hi[row], high), found.at[row]
            key = mix(codes.spans(at - low, at - high + span) + mix(found.gram[row] + part.astype(U64)))
            part_ends = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(found.doc[row], minlength=n), out=part_ends[1:])
            raw = data.tobytes()
            cuts = zip((at - hi).tolist(), (at - low).tolist(), (at - high + span).tolist(), (at - lo + span).tolist(), strict=True)
            parts = pa.StructArray.from_arrays(
                [pa.array(key.view(np.int64))]
                + [pa.array(x, pa.int32()) for x in (np.where(bits[row] == OPEN, at - offsets[found.doc[row]], -1), lo, hi + 1, low, high - low)]
                + [pa.array([raw[a:b] + raw[c:d] for a, b, c, d in cuts], pa.binary())],
                ["key", "at", "lo", "hi", "low", "least", "ends"],
            )
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(spans, pa.int32())), pa.ListArray.from_arrays(pa.array(part_ends), parts)], ["doc_id", "spans", "parts"])

    listed = marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    return carried(docs, marks).join(listed, "doc_id").mapInArrow(lambda batches: run(unpacked(batches)), _OPENED)


def finished(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The results of documents without a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            zero = pa.array(np.zeros(len(texts), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), zero, zero, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, _RESULT).join(marks.select("doc_id").distinct(), "doc_id", "left_anti")


def _padded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), max(int(sizes.max(initial=1)), 1)), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return out, sizes


def _agree(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the next."""
    differ = rows[:-1] != rows[1:]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[:-1], sizes[1:]))


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The intervals of a suffix array as (common prefix, first, last), by a stack scan; common[i] belongs to i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(groups: np.ndarray, contexts: list[bytes], left: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(members, right, lefts): members agree in `right` bytes behind what their group shares, and each
    with another one in lefts bytes before it, right + lefts being the group's least or more.

    groups: sorted numbers of the groups whose suffixes are arranged together."""
    right_of = [c[k:] for c, k in zip(contexts, left.tolist(), strict=True)]
    left_of = [c[:k][::-1] for c, k in zip(contexts, left.tolist(), strict=True)]
    order = np.array(sorted(range(len(contexts)), key=lambda i: (groups[i], right_of[i])), np.int64)
    rights, sizes = _padded([right_of[i] for i in order])
    lefts, left_sizes = _padded([left_of[i] for i in order])
    # One more than the bytes that agree, so that groups, which share their key, end where 0 stands.
    common = _agree(rights, sizes) + 1
    common[groups[order[:-1]] != groups[order[1:]]] = 0
    before = _agree(lefts, left_sizes)
    for depth, lo, hi in intervals(common):
        right = depth - 1
        need = int(least[order[lo]]) - right
        if hi == lo + 1:
            if before[lo] >= need:
                yield order[lo : hi + 1], right, before[[lo, lo]]
            continue
        members = np.arange(lo, hi + 1)
        if left_sizes[members].max() < need:
            continue
        ranked = members[sorted(range(len(members)), key=lambda i: left_of[order[members[i]]])]
        agree = np.zeros(len(ranked) + 1, np.int64)
        agree[1:-1] = _agree(lefts[ranked], left_sizes[ranked])
        # Diversity to the left: where neighbours part before `need`, a maximal repeat ends and another may begin.
        own = np.maximum(agree[:-1], agree[1:])
        good = (own >= need) & (np.maximum(agree[:-1] >= need, agree[1:] >= need))
        if good.any():
            yield order[ranked[good]], right, own[good]


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same spans with those of a document that touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Documents one behind the other in one long range: a span starts a new one beyond all ends so far.
    base = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.append(True, (start + base)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach - base)[last]


def _spans(rows: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end) of repeats found within each key; the rows of a key fit one task."""

    def answer(key: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        doc, at, lo, hi, low, least = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "at", "lo", "hi", "low", "least"))
        groups = np.cumsum(np.append(0, key[1:] != key[:-1]))
        out: list[list[np.ndarray]] = [[], [], []]
        for members, right, lefts in maximal_repeats(groups, table.column("ends").to_pylist(), hi - 1 - low, least) if len(key) > 1 else ():
            # A window that begins l before the gram needs l - low bytes on the left and low + least - l on the right.
            first, last = np.maximum(lo[members], low[members] + least[members] - right), np.minimum(hi[members] - 1, low[members] + lefts)
            use = (first <= last) & (at[members] >= 0)
            m = members[use]
            for k, x in enumerate((doc[m], at[m] - last[use], at[m] - first[use] + span)):
                out[k].append(x)
        doc, start, end = joined(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * GROUP:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if cut:
                yield answer(key[:cut], table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield answer(table.column("key").to_numpy(), table)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, start int, end int")


def compare(parts: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end) of all repeats between parts of one key."""
    sizes = stored(parts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "keys")
    hot = small(sizes.where(F.col("k") > GROUP).select("key"))
    found = _spans(parts.join(hot, "key", "left_anti"), span)
    if hot.isEmpty():
        return found
    # Large groups: parts that are equal as a whole are repeats, and stand for each other from there on.
    large = stored(parts.join(hot, "key", "left_semi"), "large")
    same = ["key", "lo", "hi", "ends"]
    whole = large.groupBy(*same, "low", "least").agg(F.count("*").alias("k"), F.max(F.struct("at", "doc_id")).alias("one"))
    equal = large.where("at >= 0").join(whole.where("k > 1").select(*same), same, "left_semi")
    found = found.union(equal.select("doc_id", (F.col("at") - F.col("hi") + 1).alias("start"), (F.col("at") - F.col("lo") + span).alias("end")))
    rows = stored(whole.select("key", "lo", "hi", "low", "least", "ends", F.when(F.col("k") == 1, F.col("one.at")).otherwise(-1).alias("at"), "one.doc_id"), "whole")
    hot = small(stored(rows.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > GROUP).select("key"), "hot_keys"))
    found = found.union(_spans(rows.join(hot, "key", "left_anti"), span))
    # Groups that are still large: window by window, those that occur twice are repeats.
    single = rows.join(hot, "key", "left_semi").withColumn("l", F.explode(F.sequence("lo", F.col("hi") - 1)))
    left, right = "substring(ends, hi - 1 - l + 1, l - low)", "substring(ends, hi - low, low + least - l)"
    single = single.withColumn("name", F.xxhash64("key", "l", F.expr(left), F.expr(right)))
    twice = single.groupBy("name").agg(F.count("*").alias("k")).where("k > 1")
    single = single.where("at >= 0").join(twice, "name", "left_semi")
    return found.union(single.select("doc_id", (F.col("at") - F.col("l")).alias("start"), (F.col("at") - F.col("l") + span).alias("end")))


def _close(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Removes the bytes of each document's spans (doc_id, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests, sizes = [], [], [], []
            for packed, found in zip(batch.column("packed"), batch.column("found"), strict=True):
                text, found = unpack(packed.as_py()), found.values
                out = covered(len(text), *(np.asarray(found.field(k), np.int64) for k in (0, 1)))
                removed.append(int(out.sum()))
                runs.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~out].tobytes()).hexdigest())
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())], ["doc_id", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return carried(docs, spans, ("id",)).join(listed, "doc_id").mapInArrow(run, _RESULT)


def deduplicate(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select(F.xxhash64("id", "text").alias("doc_id"), "id", "text")
    spans = repeated_spans(docs, span)
    return _close(docs, spans).union(finished(docs, spans)).drop("doc_id").withColumnRenamed("id", "doc_id")


def repeated_spans(docs: DataFrame, span: int = 200) -> DataFrame:
    """(doc_id, start, end): byte spans that are covered by strings of `span` bytes with another occurrence."""
    opened = stored(_open(docs, marks_of(docs, span), span), "opened")
    pairs = F.explode(F.expr("transform(sequence(0, size(spans) div 2 - 1), i -> struct(spans[2 * i] AS start, spans[2 * i + 1] AS end))"))
    whole = opened.where(F.size("spans") > 0).select("doc_id", pairs.alias("s")).select("doc_id", "s.*")
    parts = opened.where(F.size("parts") > 0).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*")
    return stored(whole.union(compare(parts, span)), "spans")
