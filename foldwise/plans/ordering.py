"""Ranks and running positions inside groups of any size.

A window partitioned by a dataset puts the whole dataset into one task. The
functions here use that form only when the group is known to be small: either
the caller passes a bound that holds by construction (``group_rows``), or one
counting pass shows that the whole input is below ``slice_rows``. Beyond that
the values are cut into ordered slices at quantiles of the whole column. A
slice holds about ``slice_rows`` rows of all groups together, so no group of
(key, slice) can be larger, however skewed the keys are. Positions inside a
slice come from a window over (key, slice); the start of a slice comes from a
window over the slice totals, at most ``MAX_SLICES`` rows per key. The cut
points are plain numbers, so recomputed tasks put every row in the same slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.substitutions import finite
from foldwise.plans.keyjoin import join_keys
from foldwise.session import materialise

SLICE_ROWS = 1_000_000
MAX_SLICES = 65_536


def slice_points(df: DataFrame, value: str, slice_rows: int = SLICE_ROWS,
                 group_rows: int | None = None) -> list[float]:
    """Inner cut points of the ordered slices; empty when one slice is enough."""
    if group_rows is not None and group_rows <= slice_rows:
        return []
    n = df.agg(F.count(value)).first()[0]
    slices = min(MAX_SLICES, math.ceil(n / slice_rows))
    if slices <= 1:
        return []
    probs = [i / slices for i in range(1, slices)]
    return sorted(set(df.approxQuantile(value, probs, 0.25 / slices)))


def with_slice(df: DataFrame, value: str, points: Sequence[float], out: str = "_slice") -> DataFrame:
    """Number of the ordered slice of a value: NULL before all others, NaN after, as in a sort."""
    if not points:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[-math.inf, *points, math.inf], inputCol=value, outputCol="_cut", handleInvalid="keep")
    number = F.when(F.col(value).isNull(), -1).otherwise(F.col("_cut").cast("int"))
    return cut.transform(df).withColumn(out, number).drop("_cut")


def _starts(per_slice: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """Rows before each slice of a key, and rows of the key in all."""
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *keys, "_slice",
        F.coalesce(F.sum(rows).over(before), F.lit(0)).alias("_start"),
        F.sum(rows).over(Window.partitionBy(*keys)).alias("total"),
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, *, slice_rows: int = SLICE_ROWS, group_rows: int | None = None,
                 count: Column | None = None, also: Sequence[Column] = ()) -> tuple[DataFrame, list[float]]:
    """Distinct values of each group with their place in the order, and the cut points used.

    Gives keys, value, ``n`` (rows with this value), ``below`` (rows with a
    smaller value), ``total`` (rows of the group) and the slice. Ties are counted
    before anything is ordered, so a value shared by a third of the rows is one
    row here. NULL, NaN and infinite values are left out; a NULL key is a key. Without a bound the counts are written once, because choosing the
    slices and using them both read them. ``count`` takes the place of the count of rows; the aggregates ``also`` come along.
    """
    number = F.count(F.lit(1)) if count is None else count
    counted = df.filter(finite(F.col(value)).isNotNull()).groupBy(*keys, value).agg(number.alias("n"), *also)
    if group_rows is None or group_rows > slice_rows:
        counted = materialise(counted)
    points = slice_points(counted, value, slice_rows, group_rows)
    counted = with_slice(counted, value, points)
    inner = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counted.withColumn("below", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    if not points:
        return local.withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "_slice"))), points
    per_slice = counted.groupBy(*keys, "_slice").agg(F.sum("n").alias("_rows"))
    placed = (
        join_keys(local, _starts(per_slice, keys, "_rows"), [*keys, "_slice"])
        .withColumn("below", F.col("below") + F.col("_start"))
        .drop("_start")
    )
    return placed, points


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, *, ties: str | None = None,
                 slice_rows: int = SLICE_ROWS, group_rows: int | None = None) -> DataFrame:
    """Rank inside the group, ties sharing their mean rank. Values must not be NULL.

    Without ``group_rows`` the input is read more than once, so it should be a
    table or a materialised frame. ``ties`` names a column for the number of rows that share the value.
    """
    if group_rows is None:
        group_rows = df.count()
    if group_rows <= slice_rows:
        order = Window.partitionBy(*keys).orderBy(value)  # ties are the peers of one order: rows are dealt and sorted once
        tied = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        first = F.rank().over(order)
        ranked = df.withColumn("_tied", tied).withColumn(
            out, (first + (F.col("_tied") - 1) / F.lit(2.0)).cast("double")
        )
    else:
        placed, _ = value_counts(df, keys, value, slice_rows=slice_rows)
        ranks = placed.select(
            *keys, value, F.col("n").alias("_tied"),
            (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).cast("double").alias(out),
        )
        ranked = join_keys(df, ranks, [*keys, value])
    return ranked.withColumnRenamed("_tied", ties) if ties else ranked.drop("_tied")


def group_index(df: DataFrame, keys: Sequence[str], value: str, tiebreak: Sequence[str | Column], out: str, *,
                total: str | None = None, slice_rows: int = SLICE_ROWS,
                group_rows: int | None = None) -> DataFrame:
    """1-based place of each row in its group, ordered by a number that is nearly unique."""
    if group_rows is None:
        df = materialise(df)
    points = slice_points(df, value, slice_rows, group_rows)
    sliced = with_slice(df, value, points)
    part = [*keys, "_slice"]
    local = sliced.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(value, *tiebreak)))
    if not points:
        if total:
            local = local.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*part)))
        return local.drop("_slice")
    starts = _starts(sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows")
    starts = starts.withColumnRenamed("total", total) if total else starts.drop("total")
    return join_keys(local, starts, part).withColumn(out, F.col(out) + F.col("_start")).drop("_start", "_slice")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *,
                    slice_rows: int = SLICE_ROWS, group_rows: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group, from counts instead of a collected group."""
    placed, _ = value_counts(df, keys, value, slice_rows=slice_rows, group_rows=group_rows)
    aggs = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("total") - 1)
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            holds = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{side}"))
    picked = placed.groupBy(*keys).agg(F.max("total").alias("_total"), *aggs)
    cols = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return picked.select(*keys, *cols)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
                  spread: Column, salts: int = 64) -> DataFrame:
    """Exactly the first ``n`` rows of each group.

    First the best ``n`` of each of ``salts`` shares of a group, then the best
    ``n`` of those: the last window sees at most ``salts * n`` rows of a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    for part in ([*keys, "_salt"], list(keys)):
        place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        salted = salted.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
    return salted.drop("_salt")


def sorted_index(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """0-based place of each row in a total order of any column type.

    The sorted rows are written once, because the starts of the partitions and the
    rows themselves must come from the same sort; the starts are one row per
    partition.
    """
    ids = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ids.withColumn("_part", part).withColumn("_in", inside)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_in") + F.col("_start")).drop(
        "_id", "_part", "_in", "_start"
    )
