"""Incidence matrices as compressed sparse rows, and their products row by row.

A matrix has ``ptr`` (n + 1 offsets) and ``idx`` (columns, ascending in each row); every entry is one. A product
A B takes, for every entry (i, k) of A, row k of B and adds it to row i (Gustavson's order). Rows go in blocks
whose expansion stays near ``BLOCK`` entries, so that memory follows the result and not the work; only a single
row that expands to more is taken whole. ``product_sizes`` is the symbolic half: the number of pairs of each
row without forming them. Matrices without rows, columns or entries are matrices like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 20


@dataclass
class Csr:
    ptr: np.ndarray
    idx: np.ndarray
    cols: int

    @property
    def rows(self) -> int:
        return len(self.ptr) - 1

    def transpose(self) -> Csr:
        """Rows and columns exchanged, by a stable counting order of the columns."""
        owner = np.repeat(np.arange(self.rows), np.diff(self.ptr))
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.idx, minlength=self.cols))]) if self.cols else np.zeros(1, np.int64)
        return Csr(ptr, owner[np.argsort(self.idx, kind="stable")], self.rows)


def spans(sizes: np.ndarray) -> Csr:
    """Row i holds the next ``sizes[i]`` columns: tokens by the bytes they cover."""
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    total = int(ptr[-1])
    return Csr(ptr, np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64), total)


def owners(sizes: np.ndarray) -> Csr:
    """The transpose of ``spans``: row k holds the one token that covers byte k."""
    total = int(np.sum(sizes))
    kind = np.int32 if total < 1 << 31 else np.int64
    return Csr(np.arange(total + 1, dtype=kind), np.repeat(np.arange(len(sizes), dtype=kind), sizes), len(sizes))


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Pairs (k of a row of A, entry of row k of B) of every row of A."""
    width = np.diff(b.ptr)[a.idx]
    return np.diff(np.concatenate([[0], np.cumsum(width)])[a.ptr])


def product(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of A B block by block: rows, columns and values, ascending by row, then column."""
    work = np.concatenate([[0], np.cumsum(product_sizes(a, b))])
    start = 0
    while start < a.rows:
        stop = max(start + 1, int(np.searchsorted(work, work[start] + block, "right")) - 1)
        sizes = np.diff(a.ptr[start:stop + 1])
        inner = a.idx[a.ptr[start]:a.ptr[stop]]
        row = np.repeat(np.arange(start, stop), sizes)
        first, width = b.ptr[inner], b.ptr[inner + 1] - b.ptr[inner]
        if len(inner) and width.min() == width.max() == 1:
            col = b.idx[first]
        else:
            ends = np.cumsum(width)
            total = int(ends[-1]) if len(ends) else 0
            col = b.idx[np.repeat(first - ends + width, width) + np.arange(total)]
            row = np.repeat(row, width)
        key = row * b.cols + col
        if len(key):
            if np.any(key[1:] < key[:-1]):
                key = np.sort(key)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            row, col = np.divmod(key[new], b.cols)
            yield row, col, np.diff(np.append(new, len(key)))
        start = stop
