"""Anchors: content-chosen places from which equal windows of text are found.

A window of `span` units (words or bytes) has span - gram + 1 runs of `gram` units. Its anchors are
those of least hash among them, a rule that looks at nothing but the window, so equal windows have
equal anchors at equal places. Only anchors are exchanged between tasks, about 2 / (span - gram + 2)
of all places, instead of every window.

The windows of an anchor begin `lo` to `hi` units before it. Its context is what these windows cover.
Anchors of one gram fall into classes of equal contexts and equal lo and hi: within a class all
windows are equal; between classes of one gram some may be, but only if the classes agree in the
`half` + 1 units left of the gram or in the units that a window with less on its left must have on its
right. A class is named by a number of 62 bits above two low bits that are free for marks; these
sides by 32 bits each, 0 where no window of the class has that much on that side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import U64, Rolling, mix, sliding

_ODD = U64(0xD6E8FEB86659FD93)


@dataclass
class Anchors:
    """Places in one step's texts; all arrays have one entry per anchor."""

    doc: np.ndarray  # index of the document in the step
    at: np.ndarray  # first unit of the gram
    lo: np.ndarray  # the windows begin lo to hi units before it
    hi: np.ndarray
    gram: np.ndarray  # hash of the gram
    kind: np.ndarray  # the class, with both low bits zero
    left: np.ndarray  # its sides
    right: np.ndarray


def find(codes: Rolling, first: np.ndarray, span: int, gram: int) -> Anchors:
    """Anchors of texts whose units have rolling hashes `codes`; first: index of each text's first unit."""
    n, width, half = len(codes.sums) - 1, span - gram + 1, (span - gram) // 2
    none = np.zeros(0, np.int64)
    if n < span:
        return Anchors(none, none, none, none, *([none.astype(U64)] * 4))
    hashes = mix(codes.every(gram))
    rank = hashes | U64(1)
    ends = np.repeat(first[1:], np.diff(first))
    least = np.where(np.arange(n - span + 1) + span <= ends[: n - span + 1], sliding(rank, width), U64(0))
    shown = np.zeros(len(least) + 2 * (width - 1), U64)
    shown[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(sliding(shown, width, np.maximum) == rank)
    doc = np.searchsorted(first, at, "right") - 1
    if not len(at):
        return Anchors(doc, at, at, at, *([hashes[at]] * 4))
    # A run of windows with one least rank belongs to the anchor of that rank that lies in all of them.
    start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(start[1:], len(least)) - 1
    real = least[start] > 0
    start, last = start[real], last[real]
    lo, hi = np.maximum(0, at + span - first[doc + 1]), np.minimum(width - 1, at - first[doc])
    anchor, wanted = np.searchsorted(at, last), np.arange(len(start))
    while len(wanted):
        inside = (anchor < len(at)) & (at[np.minimum(anchor, len(at) - 1)] < start[wanted] + width)
        wanted, anchor = wanted[inside], anchor[inside]
        same = rank[at[anchor]] == least[start[wanted]]
        own, run = anchor[same], wanted[same]
        lo[own], hi[own] = at[own] - last[run], at[own] - start[run]
        wanted, anchor = wanted[~same], anchor[~same] + 1
    context = codes.spans(at - hi, at - lo + span)
    full = mix(context + mix(hashes[at] * _ODD + (lo * 1009 + hi).astype(U64)))
    left = mix(codes.spans(at - np.minimum(half + 1, hi), at)) >> U64(32) | U64(1)
    right = mix(codes.spans(at + gram, at + gram + np.minimum(span - gram - half, span - gram - lo))) >> U64(32) | U64(1)
    return Anchors(doc, at, lo, hi, hashes[at], full & ~U64(3), np.where(hi > half, left, U64(0)), np.where(lo <= half, right, U64(0)))


def in_document(kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for a class in a document of the step."""
    return mix(kind + mix(doc.astype(U64) * _ODD))


def distinct(found: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """One anchor for each class in each document, and how many anchors it stands for."""
    name = mix(in_document(found.kind, found.doc) ^ found.gram)
    _, rows, counts = np.unique(name, return_index=True, return_counts=True)
    return rows, counts


def marked(found: Anchors, marks: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each anchor the low bits of the mark that names its class in its document, -1 where none does."""
    if not len(marks):
        return np.full(len(found.at), -1)
    names = in_document(marks & ~U64(3), doc)
    order = np.argsort(names)
    names, bits = names[order], (marks & U64(3)).astype(np.int64)[order]
    own = in_document(name_of(found.gram, found.kind), found.doc)
    where = np.minimum(np.searchsorted(names, own), len(names) - 1)
    return np.where(names[where] == own, bits[where], -1)


def name_of(gram: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """One number for gram and class, with both low bits zero: what a mark carries back to the document."""
    return (gram ^ kind) & ~U64(3)


def name() -> Column:
    """The same from columns."""
    return F.col("gram").bitwiseXOR(F.col("kind")).bitwiseAND(F.lit(-4))
