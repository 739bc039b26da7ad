"""From raw variant records to per-substitution rows: gates, caps, explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import md5_int, seeded
from foldwise.functions.substitutions import finite, parse_substitutions
from foldwise.plans.keyjoin import beside
from foldwise.plans.ordering import top_per_group

MIN_VARIANTS = 5
MIN_ROWS = 10


def valid_variants(variants: DataFrame, refs: DataFrame, single_site_only: bool = False) -> DataFrame:
    """Parsed variants that can be used.

    Keeps variants with a finite fitness and at least one substitution inside
    ``1..seq_len``, drops indels, and (optionally) multi-site variants. Adds
    ``subs``, ``n_parsed`` (substitutions before the range filter) and
    ``seq_len``. The lengths are broadcast where the references are counted to be few.
    """
    lengths = refs.select("dataset", "seq_len")
    return _valid(variants, beside(lengths)(lengths), single_site_only)


def _valid(variants: DataFrame, lengths: DataFrame, single_site_only: bool) -> DataFrame:
    parsed = variants.select(
        "dataset", "variant_id", "seq",
        finite(F.col("fitness")).alias("fitness"),
        parse_substitutions(F.col("mut_info")).alias("subs"),
    ).filter(F.col("fitness").isNotNull() & (F.size("subs") > 0))
    placed = parsed.join(lengths, "dataset").withColumn(
        "n_parsed", F.size("subs")
    )
    in_range = placed.withColumn(
        "subs", F.filter("subs", lambda s: (s["pos"] >= 1) & (s["pos"] <= F.col("seq_len")))
    )
    kept = in_range.filter(
        (F.size("subs") > 0) & (F.col("seq").isNull() | (F.length("seq") == F.col("seq_len")))
    )
    return single_site(kept) if single_site_only else kept


def single_site(variants: DataFrame) -> DataFrame:
    return variants.filter(F.size("subs") == 1)


def min_size(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keep the groups with at least ``n`` rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(big.select(*keys), keys, "left_semi")


def capped(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 42, flag: str | None = None) -> DataFrame:
    """Exactly ``n`` rows of every group that has more, drawn by a seeded hash of the id."""
    draw = df.withColumn("_draw", md5_int(seeded(seed, F.col(id_col))))
    kept = top_per_group(draw, keys, ["_draw", id_col], n, F.col(id_col)).drop("_draw")
    if flag is None:
        return kept
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) > n).alias(flag))
    return kept.join(sizes, keys)


def explode_substitutions(variants: DataFrame) -> DataFrame:
    """One row per substitution; all rows of a variant share its label."""
    keep = [c for c in variants.columns if c not in ("subs", "seq")]
    return variants.select(*keep, F.posexplode("subs").alias("_i", "_s")).select(
        *keep,
        F.concat_ws(":", F.col("variant_id"), (F.col("_i") + 1).cast("string")).alias("row_id"),
        F.col("_s.pos").alias("pos"),
        F.col("_s.from_aa").alias("from_aa"),
        F.col("_s.to_aa").alias("to_aa"),
    )


def substitution_rows(variants: DataFrame, refs: DataFrame, max_variants: int | None = None,
                      max_rows: int | None = None, seed: int = 42,
                      single_site_only: bool = False) -> DataFrame:
    """The rows every later step works on.

    The order of the steps is part of the meaning: filters, size gate, variant
    cap, explode, row subsample, row gate. Nothing is capped unless asked for.

    Both gates and the cap flag come from one count per dataset. That is exact
    because a dataset too small for the row gate has fewer than ``MIN_ROWS``
    variants and is never touched by a cap of at least that size.
    """
    for cap in (max_variants, max_rows):
        if cap is not None and cap < MIN_ROWS:
            raise ValueError(f"caps below {MIN_ROWS} would empty every dataset")
    lengths = refs.select("dataset", "seq_len")
    small = beside(lengths)
    used = _valid(variants, small(lengths), single_site_only)
    sizes = used.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_variants"), F.sum(F.size("subs")).alias("_rows")
    ).filter((F.col("_variants") >= MIN_VARIANTS) & (F.col("_rows") >= MIN_ROWS))
    over = F.lit(False) if max_variants is None else F.col("_variants") > max_variants
    used = used.join(small(sizes.select("dataset", over.alias("capped"))), "dataset")
    if max_variants is not None:
        used = capped(used, ["dataset"], "variant_id", max_variants, seed)
    rows = explode_substitutions(used)
    return rows if max_rows is None else capped(rows, ["dataset"], "row_id", max_rows, seed)


def bookkeeping(rows: DataFrame) -> DataFrame:
    """Rows, distinct variants after the row subsample, and the cap flag per dataset."""
    per_variant = rows.groupBy("dataset", "variant_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("capped").alias("capped")
    )
    return per_variant.groupBy("dataset").agg(
        F.sum("_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_variants"),
        F.max("capped").alias("capped"),
    )


def valid_vector(vec: Column) -> Column:
    """True when no element is NULL, NaN or infinite."""
    return ~F.coalesce(
        F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(True)
    )


def difference_gate(df: DataFrame, keys: list[str], a: str, b: str, tol: float = 1e-3) -> DataFrame:
    """Largest absolute difference of two columns per group and whether it is below ``tol``."""
    return df.groupBy(*keys).agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_diff")).withColumn(
        "gate_pass", F.col("max_diff") < tol
    )


def long_enough(refs: DataFrame, min_len: int = 60, n_positions: int = 50) -> DataFrame:
    """References with the wanted length and enough candidate positions (2 .. L-2)."""
    return refs.filter((F.col("seq_len") >= min_len) & (F.col("seq_len") - 3 >= n_positions))


def position_sample(refs: DataFrame, n_positions: int = 50, seed: int = 42) -> DataFrame:
    """``n_positions`` distinct positions of ``2 .. L-2`` per dataset."""
    cand = long_enough(refs, 0, n_positions).select(
        "dataset", F.explode(F.sequence(F.lit(2), F.col("seq_len") - 2)).alias("pos")
    )
    cand = cand.withColumn("_key", F.concat_ws(":", "dataset", F.col("pos").cast("string")))
    return capped(cand, ["dataset"], "_key", n_positions, seed).drop("_key")
