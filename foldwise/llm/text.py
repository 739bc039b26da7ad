"""Words and text buffers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six characters that separate words; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20_011)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it occurs in ``use``."""
    return F.transform(F.array(value), use)[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``limit`` bytes; a longer single text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, ends = text_bytes(batch.column(column))
        cut, start = ends // limit, 0
        for stop in [*(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), batch.num_rows]:
            if stop > start:
                yield batch.slice(start, stop - start)
                start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _powers[name] = table = np.multiply.accumulate(table)
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts ``data[offsets[i]:offsets[i + 1]]`` start and end; ``data`` isn't empty."""
    n = len(data)
    inside = ~_IS_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power_table("up", _BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table("down", _BASE_INVERSE, n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column of texts, and n + 1 offsets of the texts into them."""
    data, offsets = text_bytes(column)
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_spans(data, offsets)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width`` consecutive words of each text, ascending, and their offsets.

    A text with fewer words has its whole sequence as the one shingle; without words it has none.
    """
    sizes = np.diff(offsets)
    total = len(hashes)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    value = np.zeros(total, np.uint64)
    room = offsets[doc + 1] - np.arange(total)
    for k in range(width):
        at = np.minimum(np.arange(total) + k, total - 1)
        value = np.where(room > k, mix(value * np.uint64(0x100000001B3) + hashes[at] + np.uint64(k + 1)), value)
    keep = (room >= width) | ((np.arange(total) == offsets[doc]) & (sizes[doc] < width))
    value, doc = value[keep], doc[keep]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(sizes) + 1))
