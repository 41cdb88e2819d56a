"""Substring deduplication with a log-structured index of window fingerprints.

A window is `span` consecutive words of one document. A word is removed if a window over it also
starts in a document with a smaller id. The index holds the fingerprints of historical windows (of
their anchors, see anchors.py: gram hash, class hash, document) in immutable runs: bucketed tables,
sorted by fingerprint, in the shared folder. A new batch becomes a run of its own and is merge-joined
with the older runs, bucket by bucket and without another shuffle. When `fanout` runs have gathered,
they are merged into one. What the merge leaves open, windows around the same gram in different
contexts, is verified by the hashes of the whole windows.

Documents must reach the index in ascending order of their ids.

Defined results. A null or empty text has no words; a document of fewer than `span` words loses
nothing. Rows without an id lose nothing and make nobody else lose anything. Rows that repeat an id
are judged each by its own text and are no reason to remove anything from each other. Texts of any
length are taken whole, one at a time. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import anchors as A
from .carry import carried, unpack, unpacked
from .common import bounded_batches, settle, shared_path, stored
from .kernels import U64, Rolling, Words, covered, mix, pieces, repeated

#: Words in the gram that anchors a window.
GRAM = 4
#: Marks in the two low bits of a class: its windows are repeats; or its windows are still to be compared.
REPEAT, OPEN = 0, 1
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _words(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[Words, Rolling, A.Anchors]:
    words = Words(data, offsets)
    codes = Rolling(words.hashes())
    found = A.find(codes, words.first, span, GRAM)
    found.kind = _kind(found)
    return words, codes, found


def _kind(found: A.Anchors) -> np.ndarray:
    """The class in 40 bits behind 12 bits for either side, so that a run needs no columns for the sides."""
    left, right = (np.where(x > 0, x % U64(4095) + U64(1), U64(0)) for x in (found.left, found.right))
    return (left << U64(52)) | (right << U64(40)) | ((found.kind >> U64(26)) << U64(2))


def fingerprints(docs: DataFrame, span: int) -> DataFrame:
    """(gram, kind, doc_id): the anchored classes of windows in each document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            found = _words(data, offsets, span)[2]
            own, _ = A.distinct(found)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(found.gram[own].view(np.int64)), pa.array(found.kind[own].view(np.int64)), pa.array(ids[found.doc[own]].astype(np.int64))], ["gram", "kind", "doc_id"])

    return docs.mapInArrow(run, "gram long, kind long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs of historical fingerprints; `ingest` answers for a batch and remembers it."""

    def __init__(self, spark: SparkSession, span: int = 13, fanout: int = 2, buckets: int | None = None):
        self.spark, self.span, self.fanout = spark, span, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"fingerprints_{uuid.uuid4().hex[:12]}"
        self.runs: list[str] = []
        self.made = 0
        # Runs are bucketed by gram: joins on (gram, kind) then need no shuffle either.
        self.before = spark.conf.get(_CO_PARTITION)
        spark.conf.set(_CO_PARTITION, "false")
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{shared_path(spark, 'fingerprints')}'")

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.database}.run{self.made}"
        self.made += 1
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "gram").sortBy("gram", "kind").saveAsTable(name)
        return name

    def _classes(self, run: str) -> DataFrame:
        return self.spark.table(run).groupBy("gram", "kind").agg(F.min("doc_id").alias("rep"))

    def ingest(self, docs: DataFrame) -> DataFrame:
        """(doc_id, mark): the classes of the batch's documents whose windows repeat those of a smaller id."""
        name = self._write(fingerprints(docs, self.span).repartition(self.buckets, "gram"))
        sources = self._classes(name)
        for k, run in enumerate(self.runs):
            older = self._classes(run).withColumnRenamed("rep", f"rep{k}")
            sources = sources.join(older, ["gram", "kind"], "left").select("gram", "kind", F.least("rep", f"rep{k}").alias("rep"))
        self.runs.append(name)
        return settle(self.spark.table(name).join(sources, ["gram", "kind"]).where("doc_id > rep").select("doc_id", (A.name() + REPEAT).alias("mark")))

    def undecided(self) -> DataFrame:
        """(doc_id, mark): classes whose windows must be compared, each at the least document that has it."""
        self.compact()
        if not self.runs:
            return self.spark.createDataFrame([], "doc_id long, mark long")
        classes = self._classes(self.runs[0])
        around = Window.partitionBy("gram")
        several = classes.withColumns({"lo": F.min("kind").over(around), "hi": F.max("kind").over(around)}).where("lo < hi")
        several = settle(several.select("gram", "kind", "rep"))
        # Of several classes of a gram only those that agree on one side can share a window.
        left, right = F.shiftrightunsigned("kind", 52), F.shiftrightunsigned("kind", 40).bitwiseAND(F.lit(4095))
        side = several.select("gram", "kind", "rep", F.explode(F.array(left, -right)).alias("side")).where("side <> 0")
        shared = side.groupBy("gram", "side").agg(F.count("*").alias("k")).where("k > 1")
        return settle(side.join(shared, ["gram", "side"], "left_semi").select(F.col("rep").alias("doc_id"), (A.name() + OPEN).alias("mark")).distinct())

    def compact(self) -> None:
        """Merge the gathered runs into one, by merge joins of their buckets."""
        if len(self.runs) < self.fanout:
            return
        merged = self._classes(self.runs[0])
        for run in self.runs[1:]:
            more = self._classes(run).withColumnRenamed("rep", "rep1")
            merged = merged.join(more, ["gram", "kind"], "full").select("gram", "kind", F.least("rep", "rep1").alias("rep"))
        name = self._write(merged.withColumnRenamed("rep", "doc_id"))
        for run in self.runs:
            self.spark.sql(f"DROP TABLE {run}")
        self.runs = [name]

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")
        self.spark.conf.set(_CO_PARTITION, self.before)


_OPENED = "doc_id long, packed binary, n_words long, spans array<int>, hashes array<long>, checks array<int>, starts array<int>"


def _ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _open(docs: DataFrame, marks: DataFrame, span: int) -> DataFrame:
    """Each marked document with its repeated spans and its windows to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(unpacked(batches)):
            words, codes, found = _words(data, offsets, span)
            lists = rows.column("marks")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = A.marked(found, marks, np.repeat(np.arange(len(sizes)), sizes))
            n = len(sizes)
            hit = np.flatnonzero(bits == REPEAT)
            doc = found.doc[hit]
            base = words.first[doc]
            spans = np.stack([found.at[hit] - found.hi[hit] - base, found.at[hit] - found.lo[hit] + span - base], axis=1).reshape(-1)
            asked = np.flatnonzero(bits == OPEN)
            count = found.hi[asked] - found.lo[asked] + 1
            row = np.repeat(asked, count)
            start = found.at[row] - found.hi[row] + repeated(count)
            hashes = mix(codes.spans(start, start + span))
            other = Rolling(mix(np.diff(codes.sums) * codes.down[:-1] ^ U64(0x5851F42D4C957F2D)))
            checks = mix(other.spans(start, start + span)).astype(np.uint32).view(np.int32)
            wdoc = found.doc[row]
            windows = np.bincount(wdoc, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("packed"), pa.array(words.counts), _ragged(spans, 2 * np.bincount(doc, minlength=n), pa.int32())]
                + [_ragged(x, windows, t) for x, t in ((hashes.view(np.int64), pa.int64()), (checks, pa.int32()), (start - words.first[wdoc], pa.int32()))],
                ["doc_id", "packed", "n_words", "spans", "hashes", "checks", "starts"],
            )

    listed = marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    return carried(docs, marks).join(listed, "doc_id").mapInArrow(run, _OPENED)


def _finished(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The results of documents without a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(np.zeros(len(words), np.int64)), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(run, _RESULT).join(marks.select("doc_id").distinct(), "doc_id", "left_anti")


def _close(opened: DataFrame, span: int) -> DataFrame:
    """Removes the words of repeated spans and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for packed, n, spans, starts in zip(*(batch.column(c) for c in ("packed", "n_words", "spans", "found")), strict=True):
                pairs = np.asarray(spans.values if spans.is_valid else [], np.int64).reshape(-1, 2)
                begin = np.asarray(starts.values if starts.is_valid else [], np.int64)
                out = covered(n.as_py(), np.append(pairs[:, 0], begin), np.append(pairs[:, 1], begin + span))
                removed.append(int(out.sum()))
                digests.append(hashlib.sha256(b" ".join(compress(unpack(packed.as_py()).split(), ~out))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return opened.select("doc_id", "packed", "n_words", "spans", "found").mapInArrow(run, _RESULT)


def deduplicate(docs: DataFrame, span: int = 13, batches: int = 2, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    index = FingerprintIndex(spark, span, fanout)
    found = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs.where("doc_id IS NOT NULL")
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        index.compact()
        found.append(index.ingest(part))
    index.fanout = 2
    found.append(index.undecided())
    marks = reduce(DataFrame.union, found)
    index.drop()
    # Rows that repeat an id are told apart by their texts.
    opened = stored(_open(docs, marks, span), "opened").withColumn("row", F.xxhash64("packed"))
    windows = opened.where(F.size("hashes") > 0).select("doc_id", "row", F.explode(F.arrays_zip("hashes", "checks", "starts")).alias("w")).select("doc_id", "row", "w.*")
    sources = windows.groupBy("hashes", "checks").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last")
    hits = windows.join(sources, ["hashes", "checks"]).where("doc_id > source").groupBy("doc_id", "row").agg(F.collect_list("starts").alias("found"))
    closed = _close(opened.select("doc_id", "row", "packed", "n_words", "spans").join(hits, ["doc_id", "row"], "left"), span)
    return closed.union(_finished(docs, marks))
