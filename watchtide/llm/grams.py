"""Hashed byte n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint32(0x9E3779B1)


def folded(data: np.ndarray, letters_only: bool = False) -> np.ndarray:
    """A-Z in lower case; with ``letters_only``, every other ASCII byte becomes a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if letters_only:
        table[:128] = np.where((table[:128] >= 97) & (table[:128] < 123), table[:128], 32)
    return table[data]


def gram_codes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A code of ``bits`` bits for the n bytes from each place on; n up to 4."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.uint32)
    for i in range(n):
        code = (code << np.uint32(8)) | data[i : len(data) - n + 1 + i]
    code = (code ^ np.uint32(n * 0x01000193)) * _MIX
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - bits)).astype(np.int64)


def gram_rows(offsets: np.ndarray, data: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and code of every n-gram that lies inside one text."""
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, codes = [], []
    for n in orders:
        if len(data) < n:
            continue
        inside = row_of[: len(data) - n + 1] == row_of[n - 1 :]
        rows.append(row_of[: len(data) - n + 1][inside])
        codes.append(gram_codes(data, n, bits)[inside])
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def gram_counts(offsets: np.ndarray, data: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts by text and code, dense."""
    n = len(offsets) - 1
    rows, codes = gram_rows(offsets, data, orders, bits)
    return np.bincount(rows << bits | codes, minlength=n << bits).reshape(n, 1 << bits)
