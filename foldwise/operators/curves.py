"""Aggregates over the long table of scores (dataset, condition, layer, rho)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.plans.ordering import exact_quantiles


def layer_curve(results: DataFrame, by: list[str], min_datasets: int | None = None) -> DataFrame:
    """Mean score per layer over datasets; NULL scores do not count."""
    curve = results.groupBy(*by, "layer").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n"))
    return curve if min_datasets is None else curve.filter(F.col("n") >= min_datasets)


def _best(value: str, arg: str) -> Column:
    """Argument of the largest value; ties go to the lowest argument."""
    return F.max_by(arg, F.struct(F.col(value), -F.col(arg)))


def best_layer(scores: DataFrame, by: list[str]) -> DataFrame:
    """Layer with the highest score: of a curve, or of each dataset when ``by`` names it."""
    seen = scores.filter(F.col("rho").isNotNull())
    return seen.groupBy(*by).agg(_best("rho", "layer").alias("best"), F.max("rho").alias("best_rho"))


def dataset_mean(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by, "dataset").agg(F.avg("rho").alias("rho"))


def extremes(results: DataFrame, by: list[str]) -> DataFrame:
    """Lowest and highest layer per dataset and their distance."""
    seen = results.filter(F.col("rho").isNotNull())
    return seen.groupBy(*by, "dataset").agg(
        F.min_by("layer", F.struct("rho", "layer")).alias("min_layer"), F.min("rho").alias("min_rho"),
        _best("rho", "layer").alias("max_layer"), F.max("rho").alias("max_rho"),
        (F.max("rho") - F.min("rho")).alias("spread"),
    )


def spread_summary(results: DataFrame, by: list[str], small: float = 0.01, large: float = 0.02, **sizes) -> DataFrame:
    """How far the layers of a dataset lie apart: mean, median, max, shares."""
    spread = results.groupBy(*by, "dataset").agg((F.max("rho") - F.min("rho")).alias("spread"))
    spread = spread.filter(F.col("spread").isNotNull())
    totals = spread.groupBy(*by).agg(
        F.avg("spread").alias("mean"), F.max("spread").alias("max"), F.count(F.lit(1)).alias("n"),
        F.avg((F.col("spread") < small).cast("double")).alias("share_small"),
        F.avg((F.col("spread") > large).cast("double")).alias("share_large"),
    )
    return totals.join(exact_quantiles(spread, by, "spread", {"median": 0.5}, **sizes), by)


def invariance(curve: DataFrame, by: list[str]) -> DataFrame:
    """Population sd of the layer means."""
    return curve.groupBy(*by).agg(F.stddev_pop("rho").alias("invariance"))


def strategy_range(means: DataFrame, by: list[str], value: str = "rho") -> DataFrame:
    return means.groupBy(*by).agg((F.max(value) - F.min(value)).alias("range"))


def summary(df: DataFrame, by: list[str], value: str, ddof: int) -> DataFrame:
    """Mean, sd and count; ``ddof`` is always stated by the caller."""
    sd = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), sd(value).alias("sd"), F.count(value).alias("n")
    )


def delta_shares(deltas: DataFrame, by: list[str], value: str = "d", small: float = 0.002) -> DataFrame:
    """Wins, their share, and the share of negligible differences."""
    d = F.col(value)
    return deltas.groupBy(*by).agg(
        F.count_if(d > 0).alias("wins"), F.count(value).alias("n"),
        F.avg((d > 0).cast("double")).alias("share_positive"),
        F.avg((F.abs(d) < small).cast("double")).alias("share_small"),
    )


def performers(means: DataFrame, by: list[str], low: float = 0.2, high: float = 0.5) -> DataFrame:
    return means.groupBy(*by).agg(
        F.count_if(F.col("rho") < low).alias("n_low"), F.count_if(F.col("rho") > high).alias("n_high"),
        F.count("rho").alias("n"),
    )


def split_pivot(results: DataFrame, by: list[str], splits: list[str], value: str = "rho") -> DataFrame:
    """One column of means per split; the split list is given, so no extra pass finds it."""
    return results.groupBy(*by).pivot("split", splits).agg(F.avg(value))


def ranges(values: DataFrame, by: list[str], value: str = "rho") -> DataFrame:
    return values.groupBy(*by).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))


def inflation(means: DataFrame, by: list[str], leaky: str = "random") -> DataFrame:
    """Mean score of the leaky split minus that of every other split."""
    ref = means.filter(F.col("split") == leaky).select(*by, F.col("rho").alias("_leaky"))
    return means.filter(F.col("split") != leaky).join(ref, by).select(
        *by, "split", (F.col("_leaky") - F.col("rho")).alias("inflation")
    )


def relative_gain(best: Column, final: Column, floor: float = 1e-6) -> Column:
    """Gain of best over final in percent of the final value, NULL near zero."""
    return F.when(F.abs(final) > floor, (best - final) / F.nullif(F.abs(final), F.lit(0.0)) * 100)


def sampled_curve(curve: DataFrame, by: list[str], every: int = 4) -> DataFrame:
    """Every n-th layer of a curve as one ordered array (at most one entry per layer)."""
    picked = curve.filter(F.col("layer") % every == 0)
    return picked.groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("layer", "rho"))), lambda s: s["rho"]
        ).alias("curve")
    )


def primary_source(full: DataFrame, single: DataFrame, arm: str = "mutant", leaky: str = "random") -> DataFrame:
    """Single-site results for the mutant arm under leak-free splits, full results elsewhere."""
    routed = (F.col("arm") == arm) & (F.col("split") != leaky)
    return full.filter(~routed).withColumn("source", F.lit("full")).unionByName(
        single.filter(routed).withColumn("source", F.lit("single"))
    )


def storage_cost(sizes: DataFrame, dims: dict[str, int], baseline: str, bytes_per_value: int = 4) -> DataFrame:
    """Bytes that each feature layout of ``dims`` needs for the rows of each dataset (n_rows)."""
    layouts = F.explode(
        F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(v).cast("bigint").alias("dim")) for k, v in dims.items()])
    )
    return sizes.withColumn("_l", layouts).select(
        "dataset", "_l.strategy", "_l.dim",
        (F.col("_l.dim") * F.col("n_rows") * bytes_per_value).alias("bytes"),
        (F.col("_l.dim") / F.lit(float(dims[baseline]))).alias("ratio"),
    )
