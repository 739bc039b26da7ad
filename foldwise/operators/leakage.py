"""How many test rows share a variant with a training row, and what the data is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.folds import contiguous_fold, modulo_fold

POSITION_SCHEMES = ("modulo", "contiguous", "position_groupkfold")


def leakage_report(rows: DataFrame, schemes=POSITION_SCHEMES) -> DataFrame:
    """Leaked test rows per dataset and in all (dataset NULL).

    ``rows`` has one column ``fold_<scheme>`` per scheme. A row leaks when its
    variant also has a row in another fold, so a variant that spans two folds or
    more leaks all its rows: smallest and largest fold per variant decide, no
    join of test on train rows is needed. The rows of a variant meet only as
    partial aggregates.
    """
    spans = [
        (F.min(f"fold_{s}") < F.max(f"fold_{s}")).alias(f"_span_{s}") for s in schemes
    ]
    per_variant = rows.groupBy("dataset", "variant_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("n_parsed").alias("_parsed"), *spans
    )
    leaks = [
        F.coalesce(F.sum(F.when(F.col(f"_span_{s}"), F.col("_rows"))), F.lit(0)).alias(f"leaked_{s}")
        for s in schemes
    ]
    report = per_variant.rollup("dataset").agg(
        F.sum("_rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_parsed") > 1, F.col("_rows"))), F.lit(0)).alias("rows_multi"),
        F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias("rows_with_sibling"),
        *leaks,
    )
    return report.withColumn("pct_multi", 100.0 * F.col("rows_multi") / F.col("n_rows")).withColumn(
        "pct_with_sibling", 100.0 * F.col("rows_with_sibling") / F.col("n_rows")
    )


def with_straddle(variants: DataFrame, n_folds: int = 5) -> DataFrame:
    """Whether the substitutions of a variant fall in more than one fold."""
    mod = F.array_distinct(F.transform("subs", lambda s: modulo_fold(s["pos"], n_folds)))
    con = F.array_distinct(F.transform("subs", lambda s: contiguous_fold(s["pos"], F.col("seq_len"), n_folds)))
    return variants.withColumn("straddle_modulo", F.size(mod) > 1).withColumn(
        "straddle_contiguous", F.size(con) > 1
    )


def composition(variants: DataFrame, max_variants: int = 10_000, max_rows: int = 5_000) -> DataFrame:
    """Variants, rows, multi-site shares, straddling and cap flags, with a grand total."""
    v = with_straddle(variants).select(
        "dataset", F.size("subs").alias("_n"), "straddle_modulo", "straddle_contiguous"
    )
    multi = F.col("_n") > 1

    def count(cond):
        return F.count_if(cond)

    out = v.rollup("dataset").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.sum("_n").alias("n_rows"),
        count(multi).alias("multi_variants"),
        F.coalesce(F.sum(F.when(multi, F.col("_n"))), F.lit(0)).alias("multi_rows"),
        count(multi & F.col("straddle_modulo")).alias("straddle_modulo"),
        count(multi & F.col("straddle_contiguous")).alias("straddle_contiguous"),
    )
    return (
        out.withColumn("pct_multi_variants", 100.0 * F.col("multi_variants") / F.col("n_variants"))
        .withColumn("pct_multi_rows", 100.0 * F.col("multi_rows") / F.col("n_rows"))
        .withColumn("capped", F.when(F.col("dataset").isNotNull(), F.col("n_variants") > max_variants))
        .withColumn("subsampled", F.when(F.col("dataset").isNotNull(), F.col("n_rows") > max_rows))
    )
