"""Counting and looking up n-grams of symbols, shared by the language models."""

from __future__ import annotations

import numpy as np

from .kernels import U64

def rows_within(n: int, bits: int = 48) -> list[tuple[int, int]]:
    """Row ranges of so few documents that their number fits above a code of `bits` bits."""
    most = 1 << min(16, 64 - bits)
    return [(a, min(n, a + most)) for a in range(0, n, most)]


def codes(symbols: np.ndarray, order: int, bits: int) -> np.ndarray:
    """For each place the code of the `order` symbols that end there, the last one in the low bits."""
    if bits == 8 and order <= 8:
        padded = np.zeros(len(symbols) + 7, np.uint8)
        padded[7:] = symbols
        return np.ndarray((len(symbols),), ">u8", padded, strides=(1,)).astype(U64) & U64((1 << 8 * order) - 1)
    out = symbols.astype(U64)
    for back in range(1, order):
        out[back:] |= symbols[:-back].astype(U64) << U64(bits * back)
    return out


def by_document(code: np.ndarray, doc: np.ndarray, bits: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, code) with their counts; codes have `bits` bits at most, documents the rest."""
    key = np.sort((doc.astype(U64) << U64(bits)) | code)
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, counts = key[new], np.diff(np.append(new, len(key)))
    return (key >> U64(bits)).astype(np.int64), key & U64((1 << bits) - 1), counts


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their counts."""
    return np.unique(code, return_counts=True)


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several tables of ascending codes with their counts as one."""
    if not counts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    code, n = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.add.reduceat(n, new) if len(new) else n


def look_up(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted code stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    where = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return where, table[where] == wanted
