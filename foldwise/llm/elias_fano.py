"""Monotone sequences in about 2 + log2(u / n) bits a value, read in place.

Low bits stand packed behind one another. High bits are a bit string with one set bit per value and one clear bit per
step of the high part; running counts of set and of clear bits per 64-bit word serve the selections.
"""

from __future__ import annotations

import json

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(k for k in range(8) if _b >> k & 1):
        _SELECT[_b, _r] = _p


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` in each word."""
    octets = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    sums = np.cumsum(_POP[octets], axis=1, dtype=np.uint8)
    at = np.minimum((sums <= rank[:, None]).sum(axis=1), 7)
    row = np.arange(len(words))
    before = np.where(at > 0, sums[row, at - 1], 0)
    return at * 8 + _SELECT[octets[row, at], np.minimum(rank - before, 7)]


class EliasFano:
    """Built by ``arrays``; reads from views of a mapped file."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.high, self.ones, self.zeros = n, bits, high, ones, zeros
        self.low_words = np.ndarray((max(0, low.nbytes - 7),), "<u8", low, strides=(1,)) if low.nbytes >= 8 else np.zeros(1, "<u8")
        self.mask = np.uint64((1 << bits) - 1)

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        """Header and arrays of an ascending sequence of unsigned numbers."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        low = []
        for i in range(0, n, 1 << 17):
            part = values[i:i + (1 << 17)] & np.uint64((1 << bits) - 1)
            planes = (part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(planes.astype(np.uint8).ravel(), bitorder="little"))  # 2^17 * bits is a whole number of bytes
        high = np.zeros((n + (top >> bits) + 1 + 63) // 64 * 64, np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(high, bitorder="little").view("<u8")
        pops = _POP[words.view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(pops)])
        zeros = np.arange(len(ones)) * 64 - ones
        kind = "<u4" if 2 * n < 1 << 31 and len(words) < 1 << 25 else "<i8"
        return {"n": n, "bits": bits}, {"low": np.concatenate([*low, np.zeros(8, np.uint8)]), "high": words,
                                        "ones": ones.astype(kind), "zeros": zeros.astype(kind)}

    def _select(self, rank: np.ndarray, clear: bool) -> np.ndarray:
        counts = self.zeros if clear else self.ones
        word = np.clip(np.searchsorted(counts, rank.astype(counts.dtype), "right") - 1, 0, len(self.high) - 1)
        bits = self.high[word]
        return word * 64 + _in_word(~bits if clear else bits, rank - counts[word].astype(np.int64))

    def low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.bits
        return (self.low_words[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def get(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        high = (self._select(at, False) - at).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.low(at)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        bits = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        at = np.arange(self.n)
        return ((np.flatnonzero(bits)[: self.n] - at).astype(np.uint64) << np.uint64(self.bits)) | self.low(at)

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is at least the wanted one, and whether it equals it."""
        if not self.n or not len(wanted):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        steps = len(self.high) * 64 - self.n  # clear bits
        high = (wanted >> np.uint64(self.bits))
        inside = high < np.uint64(steps)
        h = np.where(inside, high, 0).astype(np.int64)
        low = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - (h - 1), 0)
        top = np.minimum(self._select(h, True) - h, self.n)
        low = np.minimum(low, top)
        end, key = top.copy(), wanted & self.mask
        span = int((top - low).max(initial=0))
        while span > 0:
            active = low < top
            middle = (low + top) >> 1
            less = active & (self.low(np.minimum(middle, self.n - 1)) < key)
            low = np.where(less, middle + 1, low)
            top = np.where(active & ~less, middle, top)
            span >>= 1
        there = inside & (low < end)
        there &= self.low(np.minimum(low, self.n - 1)) == key
        return np.where(inside, low, self.n), there


def packed(header: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """One file: header with the arrays' places, then the arrays on 8-byte borders."""
    places, at, parts = {}, 0, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        places[name] = [at, len(data), array.dtype.str]
        data += b"\0" * (-len(data) % 8)
        parts.append(data)
        at += len(data)
    head = json.dumps({"header": header, "places": places}).encode()
    head += b" " * (-len(head) % 8)
    return np.array([len(head)], "<u8").tobytes() + head + b"".join(parts)


def opened(data: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and arrays of a file mapped as bytes."""
    size = int(data[:8].view("<u8")[0])
    head = json.loads(bytes(data[8:8 + size]))
    start = 8 + size
    return head["header"], {k: data[start + at:start + at + n].view(d) for k, (at, n, d) in head["places"].items()}
