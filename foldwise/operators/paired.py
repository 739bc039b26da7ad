"""Paired comparisons of conditions over datasets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.hashing import md5_int, mix31
from foldwise.functions.signed_rank import signed_rank_p
from foldwise.functions.substitutions import finite
from foldwise.functions.tdist import t_cdf, t_quantile
from foldwise.operators.curves import best_layer, layer_curve
from foldwise.plans.keyjoin import FEW_KEYS, join_keys
from foldwise.plans.moments import key_fields
from foldwise.plans.ordering import SLICE_ROWS, average_rank, value_counts
from foldwise.session import materialise

MARGIN = 0.01
ARRAY_ROWS = 65_536
_REP_STEP = 2_654_435_761
_SLOT_STEP = 1_640_531_527
_SLICE_STEP = 1_013_904_223
_DRAWN = 1 << 20  # draws looked up at a time


# ------------------------------------------------------------------ pairing


def paired_conditions(results: DataFrame, on: list[str], vary: str, a: str, b: str) -> DataFrame:
    """Scores of two conditions side by side for the keys that have both; ``d = a - b``.

    One aggregate instead of a self-join: the input is read and shuffled once.
    """
    picked = results.filter(F.col(vary).isin(a, b)).groupBy(*on).agg(
        F.max(F.when(F.col(vary) == a, F.col("rho"))).alias("a"),
        F.max(F.when(F.col(vary) == b, F.col("rho"))).alias("b"),
    )
    both = picked.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.withColumn("d", F.col("a") - F.col("b"))


def best_vs_final(results: DataFrame, by: list[str], final_layer: int) -> DataFrame:
    """Score at the best layer of the mean curve minus score at the final layer, per dataset.

    ``best == final_layer`` marks a degenerate comparison; such rows are kept.
    """
    best = best_layer(layer_curve(results, by), by).select(*by, "best")
    near = results.join(best, by).filter(F.col("layer").isin(final_layer) | (F.col("layer") == F.col("best")))
    pairs = near.groupBy(*by, "best", "dataset").agg(
        F.max(F.when(F.col("layer") == F.col("best"), F.col("rho"))).alias("best_rho"),
        F.max(F.when(F.col("layer") == final_layer, F.col("rho"))).alias("final_rho"),
    )
    return pairs.filter(F.col("best_rho").isNotNull() & F.col("final_rho").isNotNull()).withColumn(
        "d", F.col("best_rho") - F.col("final_rho")
    )


def versus_reference(results: DataFrame, on: list[str], vary: str, reference: str,
                     by: list[str], min_pairs: int = 5) -> DataFrame:
    """Every level of ``vary`` minus the reference level, for the keys that have both.

    ``by`` (with ``vary``) names the comparison; those with fewer than
    ``min_pairs`` pairs are left out.
    """
    seen = results.filter(F.col("rho").isNotNull())
    ref = seen.filter(F.col(vary) == reference).select(*on, F.col("rho").alias("_ref"))
    d = seen.filter(F.col(vary) != reference).join(ref, on).select(
        *on, vary, (F.col("rho") - F.col("_ref")).alias("d")
    )
    enough = d.groupBy(*by, vary).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pairs)
    return d.join(enough.drop("_n"), [*by, vary], "left_semi")


def layer_pairs(results: DataFrame, by: list[str]) -> DataFrame:
    """Differences of all layer pairs i < j of a dataset.

    The layers of a dataset are first brought into one row, so the pairs are made
    without a join; their number depends on the layers, not on the data.
    """
    rows = results.filter(F.col("rho").isNotNull()).groupBy(*by, "dataset").agg(
        F.sort_array(F.collect_list(F.struct("layer", "rho"))).alias("_c")
    )
    left = rows.select(*by, "dataset", "_c", F.explode("_c").alias("_a"))
    right = left.select(*by, "dataset", "_a", F.explode(F.filter("_c", lambda x: x["layer"] > F.col("_a.layer"))).alias("_b"))
    return right.select(
        *by, "dataset", F.col("_a.layer").alias("i"), F.col("_b.layer").alias("j"),
        (F.col("_a.rho") - F.col("_b.rho")).alias("d"),
    )


# ------------------------------------------------------------------ summaries


def delta_summary(deltas: DataFrame, keys: list[str], value: str = "d") -> DataFrame:
    """n, mean, sd, se (ddof 1) and paired effect size."""
    base = deltas.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    return base.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn(
        "dz", F.col("mean") / (F.col("sd") + 1e-12)
    )


def pooled_effect(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Unpaired effect size over the pooled sd; 0 for no spread."""
    sd = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return df.groupBy(*keys).agg(
        F.when(sd > 0, (F.avg(a) - F.avg(b)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0).alias("effect")
    )


def _draw(rep_state: Column, slot: Column, n: Column) -> Column:
    """Place 0 .. n-1 drawn for one slot of one replicate."""
    return mix31(rep_state + slot * F.lit(_SLOT_STEP).cast("bigint")) % n


def _rep_state(rep: Column, seed: int) -> Column:
    return mix31(F.lit(seed).cast("bigint") * 7919 + rep.cast("bigint") * F.lit(_REP_STEP).cast("bigint"))


def _means_small(deltas: DataFrame, keys: list[str], unit: str, value: str, n_boot: int, seed: int,
                 blocks: int) -> DataFrame:
    packed = deltas.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_h", unit, value))), lambda s: s[value]
        ).alias("_arr")
    ).withColumn("_n", F.size("_arr").cast("bigint"))
    per = -(-n_boot // blocks)
    block = F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // per) - 1)))
    spread = packed.withColumn("_b", block).repartition(*keys, "_b")
    reps = F.explode(F.sequence(F.col("_b") * per, F.least((F.col("_b") + 1) * per, F.lit(n_boot)) - 1))
    draws = (
        spread.withColumn("rep", reps)
        .withColumn("_s", _rep_state(F.col("rep"), seed))
        .select(*keys, "rep", "_arr", "_n", "_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_slot"))
    )
    picked = F.get("_arr", _draw(F.col("_s"), F.col("_slot"), F.col("_n")).cast("int"))
    return draws.select(*keys, "rep", picked.alias("_v")).groupBy(*keys, "rep").agg(F.avg("_v").alias("m"))


def _slice_paths(per_slice: DataFrame, keys: list[str]) -> DataFrame:
    """``per_slice`` (keys, ``_slice``, ``_bits``, ``_rows``) with ``_path``: for every halving from the whole down to the slice,
    the rows of the node and of its lower half, from sums over the nodes of a level."""
    steps = F.when(F.col("_bits") > 0, F.sequence(F.lit(0), F.col("_bits") - 1)).otherwise(F.array().cast("array<int>"))
    levels = per_slice.select(*keys, "_slice", "_bits", "_rows", F.explode(steps).alias("_level"))
    levels = levels.withColumn("_node", F.expr("shiftright(_slice, _bits - _level)")).withColumn("_low", F.expr("shiftright(_slice, _bits - _level - 1)") % 2 == 0)
    nodes = levels.groupBy(*keys, "_level", "_node").agg(F.sum("_rows").alias("_all"), F.sum(F.when(F.col("_low"), F.col("_rows")).otherwise(0)).alias("_lower"))
    told = join_keys(levels.drop("_rows"), nodes, [*keys, "_level", "_node"])
    paths = told.groupBy(*keys, "_slice").agg(F.sort_array(F.collect_list(F.struct("_level", "_node", "_low", "_all", "_lower"))).alias("_path"))
    return join_keys(per_slice, paths, [*keys, "_slice"], "left")


def slice_draws(path: list[dict], n: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of a replicate's n draws fall into a slice, for every replicate.

    The draws are halved again and again: of a node's draws a binomial share goes to its lower half. A node's numbers come from a
    generator seeded by the node, so that every slice below it finds the same ones by itself, and the counts of all slices add up to n.
    """
    here = np.full(n_boot, n, np.int64)
    for step in path:
        draw = np.random.Generator(np.random.Philox(key=[seed, step["_level"] << 40 | step["_node"]]))
        lower = draw.binomial(here, step["_lower"] / step["_all"])
        here = lower if step["_low"] else here - lower
    return here


def _mix31(x: np.ndarray) -> np.ndarray:
    """``mix31`` of whole numbers in numpy."""
    x = x & 0x7FFFFFFF
    for shift, factor in ((15, 739982445), (12, 695872825)):
        x = ((x ^ x >> shift) * factor) & 0x7FFFFFFF
    return x ^ x >> 15


def _slice_sums(values: np.ndarray, times: np.ndarray, number: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """Sum of each replicate's draws inside one slice; a slice that is the whole draws like the packed form."""
    ends = np.cumsum(times)
    whole = values if ends[-1] == len(values) else np.repeat(values, times)
    slots = np.arange(int(draws.max()) if len(draws) else 0, dtype=np.int64) * _SLOT_STEP
    out = np.empty(len(draws))
    for rep, m in enumerate(draws.tolist()):
        state = int(_mix31(np.array(seed * 7919 + rep * _REP_STEP)))
        if number:
            state = int(_mix31(np.array(state + number * _SLICE_STEP)))
        total = 0.0
        for at in range(0, m, _DRAWN):
            total += whole[_mix31(slots[at:min(m, at + _DRAWN)] + state) % len(whole)].sum()
        out[rep] = total
    return out


def _means_sliced(deltas: DataFrame, keys: list[str], unit: str, value: str, n_boot: int, seed: int, slice_units: int,
                  small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replicate means of comparisons of any size: one vector of sums per slice is all that moves.

    Equal rows of a unit count as one with a number, slices are dealt by hash: none grows with a hot unit. ``small`` marks tables of
    one row per comparison for the joins with their rows.
    """
    counted = deltas.groupBy(*keys, "_h", unit, value).agg(F.count(F.lit(1)).alias("_times"))
    sizes = deltas.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bits = F.when(F.col("_n") > slice_units, F.ceil(F.log2(F.col("_n") / F.lit(float(slice_units))))).otherwise(0).cast("int")
    share = F.xxhash64(F.col(unit).cast("string"), value).bitwiseAND(F.lit((1 << 40) - 1))
    dealt = join_keys(counted, small(sizes), keys).withColumn("_bits", bits).withColumn("_slice", share)
    dealt = materialise(dealt.withColumn("_slice", F.expr("shiftright(_slice, 40 - _bits)")))
    per_slice = dealt.groupBy(*keys, "_slice", "_bits", "_n").agg(F.sum("_times").alias("_rows"))
    told = _slice_paths(per_slice, keys).select(*[F.col(k).alias(k) for k in keys], F.col("_slice").alias("_slice"), F.col("_n").alias("_n"), "_path")
    by = [*keys, "_slice"]
    schema = T.StructType([*key_fields(deltas, keys), T.StructField("_n", T.LongType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def resample(key, table, told):
        n, path = told.column("_n")[0].as_py(), told.column("_path")[0].as_py() or []
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("_h", unit, value)])
        numbers = [table.column(c).to_numpy() for c in (value, "_times")]
        sums = _slice_sums(numbers[0].astype(float), numbers[1], key[-1].as_py() if path else 0, slice_draws(path, n, n_boot, seed), seed)
        arrays = [pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(keys, key[:-1], strict=True)]
        return pa.Table.from_arrays([*arrays, pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], schema.names)

    rows = dealt.select(*by, "_h", unit, value, "_times")
    sums = rows.groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(resample, schema)
    added = sums.groupBy(*keys, "_n").agg(vector_to_array(Summarizer.sum(array_to_vector("_sums"))).alias("_sums"))
    return added.select(*keys, "_n", F.posexplode("_sums").alias("rep", "_s")).select(*keys, "rep", (F.col("_s") / F.col("_n")).alias("m"))


def bootstrap_ci(deltas: DataFrame, keys: list[str], lo: float, hi: float, *, unit: str = "dataset",
                 value: str = "d", n_boot: int = 10_000, seed: int = 42, array_rows: int = ARRAY_ROWS,
                 slice_units: int = ARRAY_ROWS, blocks: int = 64) -> DataFrame:
    """Percentile interval of the mean over resamples with replacement (lo, hi in percent).

    Units are put in hashed order; replicate r takes, for each of n slots, the unit at a hashed place. Beyond ``slice_units``
    units a comparison is dealt into slices; a replicate's n draws are split over them by seeded binomial halving, each slice
    resamples inside itself and only its sums move: one pass over the units, whatever their number. Comparisons of up to ``array_rows``
    units are packed in one array and the replicates are spread over blocks: the same numbers as one slice. The final
    percentile sees ``n_boot`` means per comparison.
    """
    seen = materialise(deltas.filter(finite(F.col(value)).isNotNull()).select(*keys, unit, value).withColumn(
        "_h", md5_int(F.col(unit).cast("string"), 1, 12).cast("double")
    ))
    sizes = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    largest, comparisons = sizes.agg(F.max("_c"), F.count(F.lit(1))).first()
    packed = min(array_rows, slice_units)
    if (largest or 0) <= packed:
        means = _means_small(seen, keys, unit, value, n_boot, seed, blocks)
    else:
        # few comparisons would leave a sort-merge join in which all units of one meet in one task
        small = F.broadcast if comparisons <= FEW_KEYS else lambda table: table
        few = join_keys(seen, small(sizes.filter(F.col("_c") <= packed).drop("_c")), keys, "left_semi")
        many = join_keys(seen, small(sizes.filter(F.col("_c") > packed).drop("_c")), keys, "left_semi")
        means = _means_small(few, keys, unit, value, n_boot, seed, blocks).unionByName(
            _means_sliced(many, keys, unit, value, n_boot, seed, slice_units, small)
        )
    return means.groupBy(*keys).agg(
        F.percentile("m", F.lit(lo / 100)).alias("lo"), F.percentile("m", F.lit(hi / 100)).alias("hi")
    )


def t_interval(summary: DataFrame, level: float) -> DataFrame:
    """Two-sided t interval on a delta summary."""
    half = t_quantile(0.5 + level / 2, F.col("n") - 1) * F.col("se")
    return summary.withColumn("t_lo", F.col("mean") - half).withColumn("t_hi", F.col("mean") + half)


def tost(summary: DataFrame, margin: float = MARGIN, zero_se_by_margin: bool = True) -> DataFrame:
    """Two one-sided t tests on a delta summary: ``tost_p``.

    Without spread the p value is 0 or 1 by the margin, or always 0 when
    ``zero_se_by_margin`` is off.
    """
    m, se, df = F.col("mean"), F.nullif(F.col("se"), F.lit(0.0)), F.col("n") - 1
    p = F.greatest(1 - t_cdf((m + margin) / se, df), t_cdf((m - margin) / se, df))
    flat = F.when(F.abs(m) < margin, 0.0).otherwise(1.0) if zero_se_by_margin else F.lit(0.0)
    return summary.withColumn("tost_p", F.when(F.col("se") == 0, flat).when(F.col("n") >= 2, p))


def paired_t(summary: DataFrame) -> DataFrame:
    """Paired t statistic and two-sided p on a delta summary."""
    t = F.col("mean") / F.nullif(F.col("se"), F.lit(0.0))
    return summary.withColumn("t", t).withColumn(
        "p", F.when(F.col("n") >= 2, 2 * (1 - t_cdf(F.abs(t), F.col("n") - 1)))
    )


def interval_verdict(lo: Column, hi: Column, margin: float = MARGIN) -> Column:
    return (
        F.when((lo >= -margin) & (hi <= margin), "Equivalent")
        .when((lo > margin) | (hi < -margin), "Difference")
        .when(lo.isNotNull(), "Inconclusive")
    )


def p_verdict(p: Column, mean: Column, margin: float = MARGIN) -> Column:
    return F.when(p < 0.05, "Equivalent").when(F.abs(mean) > margin, "Difference").when(
        p.isNotNull(), "Undetermined"
    )


def interval_signs(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Comparisons whose interval lies above or below zero."""
    return intervals.groupBy(*by).agg(
        F.count_if(F.col("lo") > 0).alias("better"), F.count_if(F.col("hi") < 0).alias("worse"),
        F.count(F.lit(1)).alias("n"),
    )


def verdict_tally(table: DataFrame, by: list[str], margin: float = MARGIN, near: float = 0.001) -> DataFrame:
    """Counts per verdict and of equivalent results close to the margin."""
    return table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("verdict") == "Equivalent") & (margin - F.col("hi") < near)).alias("near_margin"),
    )


# ------------------------------------------------------------------ rank tests


def signed_rank(deltas: DataFrame, keys: list[str], value: str = "d", min_n: int = 1, *,
                slice_rows: int = SLICE_ROWS, group_rows: int | None = None) -> DataFrame:
    """Signed-rank statistic: n, n_zero, w_plus, w_minus, z (no continuity correction)."""
    seen = deltas.filter(finite(F.col(value)).isNotNull()).select(*keys, value)
    if group_rows is None:
        seen = materialise(seen)
    zeros = seen.groupBy(*keys).agg(F.count_if(F.col(value) == 0).alias("n_zero"))
    moved = seen.filter(F.col(value) != 0).select(*keys, F.col(value).alias("_d"), F.abs(value).alias("_a"))
    ranked = average_rank(moved, keys, "_a", "_r", ties="_t", slice_rows=slice_rows, group_rows=group_rows)
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("_t").cast("double") * F.col("_t") - 1).alias("tie_term"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.nullif(F.sqrt(var), F.lit(0.0))
    return join_keys(sums, zeros, keys).filter(F.col("n") + F.col("n_zero") >= min_n).withColumn("z", z)


def wilcoxon(deltas: DataFrame, keys: list[str], value: str = "d", min_n: int = 1, exact_n: int = 50, **sizes) -> DataFrame:
    """Signed-rank test: exact for few pairs without ties or zeros, else normal."""
    s = signed_rank(deltas, keys, value, min_n, **sizes)
    exact = (F.col("n") <= exact_n) & (F.col("tie_term") == 0) & (F.col("n_zero") == 0)
    return s.withColumn(
        "p", signed_rank_p(F.col("n"), F.least("w_plus", "w_minus"), F.col("z"), exact)
    )


def bh_fdr(df: DataFrame, keys: list[str], p: str = "p", alpha: float = 0.05, *,
           slice_rows: int = SLICE_ROWS, group_rows: int | None = None) -> DataFrame:
    """Step-up false-discovery control inside each family: ``significant`` and ``p_adj``.

    Equal p values share the highest place among them, which is where the
    step-up rule looks anyway.
    """
    seen = df.filter(finite(F.col(p)).isNotNull())
    if group_rows is None:
        seen = materialise(seen)
    placed, points = value_counts(seen, keys, p, slice_rows=slice_rows, group_rows=group_rows)
    placed = placed.withColumn("_i", F.col("below") + F.col("n"))
    placed = placed.withColumn("_raw", F.col(p) * F.col("total") / F.col("_i"))
    later = Window.partitionBy(*keys, "_slice").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_adj", F.min("_raw").over(later))
    if points:
        ahead = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        floors = placed.groupBy(*keys, "_slice").agg(F.min("_raw").alias("_m")).select(
            *keys, "_slice", F.min("_m").over(ahead).alias("_ahead")
        )
        placed = join_keys(placed, floors, [*keys, "_slice"]).withColumn("_adj", F.least("_adj", "_ahead"))
    passed = F.max(F.when(F.col(p) <= F.col("_i") / F.col("total") * alpha, F.col("_i")))
    cut = placed.groupBy(*keys).agg(F.coalesce(passed, F.lit(0)).alias("_cut")) if keys else placed.agg(
        F.coalesce(passed, F.lit(0)).alias("_cut")
    )
    judged = (join_keys(placed, cut, keys) if keys else placed.join(F.broadcast(cut))).select(
        *keys, p, (F.col("_i") <= F.col("_cut")).alias("significant"),
        F.least(F.col("_adj"), F.lit(1.0)).alias("p_adj"),
    )
    return join_keys(seen, judged, [*keys, p])


# ------------------------------------------------------------------ tables


def equivalence_table(results: DataFrame, by: list[str], final_layer: int, margin: float = MARGIN,
                      n_boot: int = 10_000, seed: int = 42) -> DataFrame:
    """Best layer against final layer for every condition, with intervals, tests and verdicts."""
    pairs = best_vs_final(results, by, final_layer)
    keys = [*by, "best"]
    tested = tost(t_interval(delta_summary(pairs, keys), 0.90), margin)
    table = join_keys(tested, bootstrap_ci(pairs, keys, 5, 95, n_boot=n_boot, seed=seed), keys)
    degenerate = F.col("best") == final_layer
    return (
        table.withColumn("degenerate", degenerate)
        .withColumn("verdict", F.when(~degenerate, interval_verdict(F.col("lo"), F.col("hi"), margin)))
        .withColumn("verdict_t", F.when(~degenerate, interval_verdict(F.col("t_lo"), F.col("t_hi"), margin)))
        .withColumn("upper_gap", F.lit(margin) - F.col("hi"))
    )


def subset_curves(results: DataFrame, members: DataFrame, by: list[str], final_layer: int) -> DataFrame:
    """Best and final layer means on several subsets of datasets at once.

    ``members`` lists (subset, dataset); the subset becomes a key of one job.
    """
    tagged = results.join(members, "dataset")
    keys = ["subset", *by]
    curve = layer_curve(tagged, keys)
    final = curve.filter(F.col("layer") == final_layer).select(*keys, F.col("rho").alias("final_rho"))
    counts = tagged.filter(F.col("rho").isNotNull()).select(*keys, "dataset").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n")
    )
    return best_layer(curve, keys).join(final, keys, "left").join(counts, keys)
