"""Seeded hashes that give the same number on every cluster and engine.

Sampling, random folds and random vectors are keyed by content, so a lost task
that is recomputed draws the same rows again.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK31 = 0x7FFFFFFF


def md5_int(text: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex digits of the md5 of ``text`` as a bigint (at most 15)."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def seeded(seed: int, *parts: Column) -> Column:
    """``seed:part:part`` as text, the input of every keyed hash."""
    return F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])


def mix31(x: Column) -> Column:
    """A 31-bit avalanche of a bigint in plain arithmetic (fast inside codegen)."""
    x = x.bitwiseAND(F.lit(_MASK31).cast("bigint"))
    for shift, factor in ((15, 739982445), (12, 695872825)):
        x = x.bitwiseXOR(F.shiftright(x, shift))
        x = (x * F.lit(factor).cast("bigint")).bitwiseAND(F.lit(_MASK31).cast("bigint"))
    return x.bitwiseXOR(F.shiftright(x, 15))


def gaussian(key: Column) -> Column:
    """One standard normal number per key: Box-Muller on two slices of its md5."""
    u1 = (md5_int(key, 1, 8) + F.lit(1)) / F.lit(float(2**32 + 1))
    u2 = md5_int(key, 9, 8) / F.lit(float(2**32))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gaussian_vector(dim: int, seed: int, *parts: Column) -> Column:
    """A fixed N(0,1) vector of ``dim`` numbers for one key."""
    head = seeded(seed, *parts)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: gaussian(F.concat_ws(":", head, i.cast("string"))),
    )


def gaussian_matrix(dim: int, seed: int, *parts) -> np.ndarray:
    """The vectors of :func:`gaussian_vector` in numpy, a row for each number of the last part; the others are fixed."""
    head = ":".join(str(p) for p in (seed, *parts[:-1]))
    tails = [f":{i}".encode() for i in range(dim)]
    out = np.empty((len(parts[-1]), dim))
    for row, last in zip(out, parts[-1], strict=True):
        key = f"{head}:{last}".encode()
        words = np.frombuffer(b"".join([hashlib.md5(key + t).digest() for t in tails]), ">u4").reshape(dim, 4)
        u1, u2 = (words[:, 0] + 1.0) / float(2**32 + 1), words[:, 1] / float(2**32)
        row[:] = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)
    return out
