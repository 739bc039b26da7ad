"""Two-sided p values of the signed-rank statistic, as expressions on summary rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES = 60  # terms of the series below the turn
FRACTION = 120  # steps of the continued fraction above it
TURN = 2.5


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about 13 digits: a series of positive terms, beyond ``TURN`` a continued fraction."""
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(SERIES), F.lit(1.0), lambda a, k: 1 + a * 2 * x * x / (2 * k + 1))
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * x * series
    fraction = F.aggregate(down(FRACTION), x, lambda a, k: x + k / F.lit(2.0) / a)
    return F.when(x < TURN, near).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction)


def signed_rank_p(n: Column, w: Column, z: Column, exact: Column) -> Column:
    """Exact null distribution where asked for (up to 50 ranks, no ties), else the normal one.

    ``w`` is the smaller of the two rank sums. The number of sign patterns that give each sum is convolved rank by rank; the counts
    are whole numbers below 2^53, so the exact p has no rounding in its sums.
    """
    none = lambda r: F.array_repeat(F.lit(0.0), r)
    ways = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.array(F.lit(1.0)),
                       lambda a, r: F.zip_with(F.concat(a, none(r)), F.concat(none(r), a), lambda p, q: p + q))
    below = F.aggregate(F.slice(ways, 1, F.round(w).cast("int") + 1), F.lit(0.0), lambda a, v: a + v)
    tail = F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))
    normal = F.when(F.isnan(z), None).otherwise(erfc(F.abs(z) / math.sqrt(2.0)))
    return F.when(n >= 1, F.when(exact, tail).otherwise(normal))
