"""Moving the texts of some documents to a join, and no others.

A Bloom filter of fixed size over the wanted ids is gathered and broadcast; it only spares the
shuffle texts that the join would drop anyway, so it may be as full as it likes. Texts travel
compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix

#: Bits of the filter: half a megabyte, whatever the number of documents.
FILTER_BITS = 22
_NULL = -(1 << 62)


def pack(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text)


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the column text to batches with packed texts."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        if batch.num_rows:
            texts = pa.array([opener.decompress(x) for x in batch.column("packed").to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return (h >> U64(64 - FILTER_BITS)).astype(np.int64), (h & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL).to_numpy(zero_copy_only=False)


def wanted_ids(docs: DataFrame, wanted: DataFrame) -> Broadcast:
    """The filter over the ids in wanted, as every task gets it."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for place in _places(_ids(batch.column("doc_id"))):
                bits[place] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    words = wanted.select("doc_id").mapInArrow(collect, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return docs.sparkSession.sparkContext.broadcast(table)


def some_of(batches: Iterator[pa.RecordBatch], shared: Broadcast, through: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id the filter lets through, or all others."""
    bits = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
    for batch in batches:
        first, second = _places(_ids(batch.column("doc_id")))
        yield batch.filter(pa.array((bits[first] & bits[second]) == through))


def carried(docs: DataFrame, wanted: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, packed, the columns named by also) of all documents whose id is in wanted, and perhaps of some others."""
    shared = wanted_ids(docs, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for some in some_of(batches, shared):
            packed = [packer.compress((t or "").encode()) for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(packed, pa.binary()), *(some.column(c) for c in also)], ["doc_id", "packed", *also])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*also).schema)
    return docs.select("doc_id", "text", *also).mapInArrow(run, f"doc_id long, packed binary{more}")
