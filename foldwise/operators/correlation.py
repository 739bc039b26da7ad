"""Rank and linear correlation per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.substitutions import finite
from foldwise.plans.keyjoin import join_keys
from foldwise.plans.ordering import SLICE_ROWS, average_rank, value_counts
from foldwise.session import written


MANY = 32  # the largest of so many equal groups, or a smaller one, is ranked in one task


def linear(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL when one side is constant."""
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(scale, F.lit(0.0))


def pearson(df: DataFrame, keys: list[str], x: str, y: str, out: str = "r") -> DataFrame:
    return df.groupBy(*keys).agg(linear(F.col(x), F.col(y)).alias(out))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 10, *,
             slice_rows: int = SLICE_ROWS, group_rows: int | None = None) -> DataFrame:
    """Rank correlation with shared ranks for ties: keys, ``rho``, ``n``.

    Pairs with a missing or non-finite side are left out. ``rho`` is NULL below
    ``min_n`` pairs or for a constant side; ``n`` is kept. ``group_rows`` may
    carry a bound that holds by construction, e.g. the row cap of a dataset. Groups of at most ``slice_rows`` rows are
    ranked where they meet if none has more than one row in ``MANY``.
    """
    pairs = df.select(*keys, finite(F.col(x)).alias("_x"), finite(F.col(y)).alias("_y"))
    pairs = pairs.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    if group_rows is None:
        # written once: counting and both rankings read the pairs
        pairs = written(pairs, "pairs")
        sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c").alias("most"), F.sum("_c").alias("all")).first()
        group_rows = sizes["most"] or 0
        if (sizes["all"] or 0) > slice_rows and group_rows * MANY > sizes["all"]:
            group_rows = sizes["all"]  # few groups have most of the rows: they would keep few tasks busy
    if group_rows > slice_rows:
        scored = _spread_out(pairs, keys, slice_rows)
    else:
        bound = {"slice_rows": slice_rows, "group_rows": group_rows}
        ranked = average_rank(average_rank(pairs, keys, "_x", "_rx", **bound), keys, "_y", "_ry", **bound)
        scored = ranked.groupBy(*keys).agg(
            linear(F.col("_rx"), F.col("_ry")).alias("rho"), F.count(F.lit(1)).alias("n")
        )
    return scored.withColumn("rho", F.when(F.col("n") >= min_n, F.col("rho")))


def _spread_out(pairs: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """The same for groups of any size, from sums per distinct x of the ranks of y: only these ranks meet the rows."""
    off = F.col("below") + F.col("n") / 2.0 - F.col("total") / 2.0  # rank less the mean rank
    by_y, _ = value_counts(pairs, keys, "_y", slice_rows=slice_rows)
    ranked = join_keys(pairs, by_y.select(*keys, "_y", off.alias("_off")), [*keys, "_y"])
    by_x, _ = value_counts(ranked, keys, "_x", slice_rows=slice_rows,
                           also=[F.sum("_off").alias("_s"), F.sum(F.col("_off") * F.col("_off")).alias("_q")])
    sums = by_x.groupBy(*keys).agg(F.sum(off * F.col("_s")).alias("_c"), F.sum(F.col("n") * off * off).alias("_vx"),
                                   F.sum("_q").alias("_vy"), F.sum("n").alias("n"))
    scale = F.sqrt(F.col("_vx")) * F.sqrt(F.col("_vy"))
    return sums.select(*keys, (F.col("_c") / F.nullif(scale, F.lit(0.0))).alias("rho"), "n")
