"""Array helpers for text that arrives in Arrow batches.

All functions work on whole batches of documents at once: the bytes of the texts lie behind each
other in one array and `offsets` tells where each text begins. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one array step works on. A longer document makes a step of its own.
STEP_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256).astype(U64)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: a Python worker is kept for other tasks, and what it has freed counts as its own until then."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices with about `step` bytes of text each, with the bytes and the offsets of their texts; gives freed memory back behind the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        texts = pc.fill_null(texts.cast(pa.string()) if texts.type != pa.string() else texts, "")
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    give_back()


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in ascending order, by sorting: for 64-bit codes this is several times as fast as hashing them."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of rolling hashes, and of its inverse."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, U64)
            factors[0] = 1
            _powers[key] = np.cumprod(factors, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any spans of a sequence of codes, by differences of prefix sums."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, width: int) -> np.ndarray:
        """Of all spans of `width` codes."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, U64)


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE_CODES[data])


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch, or runs of the bytes in solid: byte spans, and the index of each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        solid = ~_WHITE[data] if solid is None else solid
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        begins = offsets[:-1]
        before[begins[begins < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        ends = offsets[1:]
        after[ends[ends > 0] - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return mix(byte_rolling(self.data).spans(self.starts, self.ends) + (self.ends - self.starts).astype(U64))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space behind each, and where each word begins."""
        lengths = self.ends - self.starts
        begins = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths + 1, out=begins[1:])
        out = np.full(begins[-1], 0x20, np.uint8)
        take = np.ones(begins[-1], bool)
        take[begins[1:] - 1] = False
        solid = ~_WHITE[self.data]
        out[take] = self.data[solid]
        return out, begins


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, and where each text's begin; a shorter text is one shingle."""
    found = Words(lower(data), offsets)
    every = Rolling(found.hashes())
    spans = np.where(found.counts >= words, found.counts - words + 1, np.minimum(found.counts, 1))
    doc = np.repeat(np.arange(len(spans)), spans)
    start = found.first[doc] + np.arange(len(doc)) - (np.cumsum(spans) - spans)[doc]
    hashes = mix(every.spans(start, start + np.minimum(found.counts[doc], words)))
    sets = [distinct(x) for x in np.split(hashes, np.cumsum(spans)[:-1])]
    ends = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=ends[1:])
    return np.concatenate(sets), ends


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over every window of `width` values, by doubling."""
    out, have = values, 1
    while have < width and len(out):
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def repeated(counts: np.ndarray) -> np.ndarray:
    """For each row its number within its group, where counts tells the groups' sizes."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, ends, 1)
    return np.cumsum(steps[:-1]) > 0


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of bytes; spans of one length are hashed together."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    n = len(data) + 1
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    four = np.ndarray((n,), "<u4", padded, strides=(1,))
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    order = np.argsort(lengths.astype(np.uint16 if lengths.max(initial=0) < 65536 else np.int64), kind="stable")
    sizes, begins = np.unique(lengths[order], return_index=True)
    seed = U64(seed)
    with np.errstate(over="ignore"):
        for size, rows in zip(sizes.tolist(), np.split(order, begins[1:]), strict=True):
            at = starts[rows]
            if size >= 32:
                lanes = [np.full(len(at), x, U64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                for _ in range(size // 32):
                    for k in range(4):
                        lanes[k] = _turn(lanes[k] + eight[at] * _P2, 31) * _P1
                        at = at + 8
                h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
                for lane in lanes:
                    h = (h ^ (_turn(lane * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(at), seed + _P5, U64)
            h = h + U64(size)
            left = size % 32
            while left >= 8:
                h = _turn(h ^ (_turn(eight[at] * _P2, 31) * _P1), 27) * _P1 + _P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _turn(h ^ (four[at].astype(U64) * _P1), 23) * _P2 + _P3
                at, left = at + 4, left - 4
            for _ in range(left):
                h = _turn(h ^ (padded[at].astype(U64) * _P5), 11) * _P1
                at = at + 1
            h = (h ^ (h >> U64(33))) * _P2
            h = (h ^ (h >> U64(29))) * _P3
            out[rows] = h ^ (h >> U64(32))
    return out
