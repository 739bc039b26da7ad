"""Rank correlation and aggregates over the long score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import correlation, curves
from foldwise.plans import bindings as B
from foldwise.plans.catalog.rows import all_rows
from foldwise.plans.catalog.views import RESULTS, ROWS, sql

FINAL = B.LAYERS // 2 - 1
SPLITS = list(B.SPLIT_OF_EVENT.values())
BY = ["model", "split"]


def _r(*names, digits=9):
    return [F.round(n, digits).alias(n) for n in names]


def spearman_by_group(spark, d):
    items = B.table(spark, d, "lineitem")
    s = correlation.spearman(items, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return s.select("l_returnflag", "l_linestatus", *_r("rho"), "n")


def spearman_small_groups(spark, d):
    items = B.table(spark, d, "lineitem")
    s = correlation.spearman(items, ["l_partkey"], "l_discount", "l_extendedprice", min_n=30)
    return s.select("l_partkey", *_r("rho"), "n")


def layer_curve(spark, d):
    return curves.layer_curve(B.results(spark, d), BY, 20).select(*BY, "layer", *_r("rho"), "n")


def best_layer(spark, d):
    return curves.best_layer(curves.layer_curve(B.results(spark, d), BY), BY).select(*BY, "best", *_r("best_rho"))


def dataset_best_layer(spark, d):
    keys = [*BY, "dataset"]
    return curves.best_layer(B.results(spark, d), keys).select(*keys, "best", *_r("best_rho"))


def dataset_mean(spark, d):
    return curves.dataset_mean(B.results(spark, d), BY).select(*BY, "dataset", *_r("rho"))


def layer_extremes(spark, d):
    return curves.extremes(B.results(spark, d), BY).select(
        *BY, "dataset", "min_layer", "max_layer", *_r("min_rho", "max_rho", "spread")
    )


def layer_spread(spark, d):
    return curves.spread_summary(B.results(spark, d), BY).select(
        *BY, "n", *_r("mean", "max", "share_small", "share_large", "median")
    )


def invariance(spark, d):
    return curves.invariance(curves.layer_curve(B.results(spark, d), BY), BY).select(*BY, *_r("invariance"))


def strategy_range(spark, d):
    means = B.results(spark, d).groupBy(*BY).agg(F.avg("rho").alias("rho"))
    return curves.strategy_range(means, ["split"]).select("split", *_r("range"))


def condition_summary(spark, d):
    res = B.results(spark, d)
    pop = curves.summary(res, BY, "rho", 0).withColumnRenamed("sd", "sd_pop")
    smp = curves.summary(res, BY, "rho", 1).select(*BY, F.col("sd").alias("sd_samp"))
    return pop.join(smp, BY).select(*BY, "n", *_r("mean", "sd_pop", "sd_samp"))


def draw_summary(spark, d):
    """Layers taken as draws: mean and sd over them per dataset and condition."""
    keys = [*BY, "dataset"]
    return curves.summary(B.results(spark, d), keys, "rho", 0).select(*keys, "n", *_r("mean", "sd"))


def performers(spark, d):
    means = curves.dataset_mean(B.results(spark, d), BY)
    return curves.performers(means, BY, 0.04, 0.06)


def split_pivot(spark, d):
    p = curves.split_pivot(B.results(spark, d), ["model", "layer"], SPLITS)
    return p.select("model", "layer", *_r(*SPLITS))


def score_ranges(spark, d):
    return curves.ranges(curves.layer_curve(B.results(spark, d), BY), ["model"]).select(
        "model", *_r("lowest", "highest")
    )


def inflation(spark, d):
    final = B.results(spark, d).filter(F.col("layer") == FINAL)
    means = final.groupBy(*BY).agg(F.avg("rho").alias("rho"))
    return curves.inflation(means, ["model"]).select("model", "split", *_r("inflation"))


def relative_gain(spark, d):
    res = B.results(spark, d)
    ends = res.groupBy(*BY, "dataset").agg(
        F.max("rho").alias("best"), F.max(F.when(F.col("layer") == FINAL, F.col("rho"))).alias("final")
    )
    gain = curves.relative_gain(F.col("best"), F.col("final"))
    return ends.filter(F.col("final").isNotNull()).select(*BY, "dataset", F.round(gain, 6).alias("gain"))


def sampled_curve(spark, d):
    curve = curves.layer_curve(B.results(spark, d), BY)
    s = curves.sampled_curve(curve, BY, 2)
    return s.select(*BY, F.round(F.get("curve", F.lit(0)), 9).alias("c0"), F.round(F.get("curve", F.lit(1)), 9).alias("c2"))


def primary_source(spark, d):
    """Routing of two result tables; models stand for arms."""
    res = B.results(spark, d).withColumnRenamed("model", "arm")
    p = curves.primary_source(res, res.withColumn("rho", F.col("rho") + 1), arm="real")
    return p.select("dataset", "arm", "split", "layer", "source", *_r("rho"))


def storage_cost(spark, d):
    sizes = all_rows(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    dims = {"last_layer": B.DIMS, "mean": B.DIMS, "concat": 5 * B.DIMS, "all_layers": B.LAYERS * B.DIMS}
    return curves.storage_cost(sizes, dims, "last_layer").select("dataset", "strategy", "dim", "bytes", "ratio")


QUERIES = {
    f.__name__: f
    for f in (
        spearman_by_group, spearman_small_groups, layer_curve, best_layer, dataset_best_layer, dataset_mean,
        layer_extremes, layer_spread, invariance, strategy_range, condition_summary, draw_summary, performers,
        split_pivot, score_ranges, inflation, relative_gain, sampled_curve, primary_source, storage_cost,
    )
}


def _spearman(keys, x, y, min_n):
    return f"""
with k as (select {keys}, {x} x, {y} y from lineitem where {x} is not null and {y} is not null),
r as (select {keys},
        rank() over (partition by {keys} order by x) + (count(*) over (partition by {keys}, x) - 1) / 2.0 rx,
        rank() over (partition by {keys} order by y) + (count(*) over (partition by {keys}, y) - 1) / 2.0 ry from k)
select {keys}, case when count(*) >= {min_n} then
         round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) end rho, count(*) n
from r group by {keys}"""


_CURVE = RESULTS + """,
lc as (select model, split, layer, avg(rho) rho, count(rho) n from res group by 1, 2, 3)"""
_DSM = RESULTS + """,
dm as (select model, split, dataset, avg(rho) rho from res group by 1, 2, 3)"""

SQL = {
    "spearman_by_group": _spearman("l_returnflag, l_linestatus", "l_quantity", "l_extendedprice", 10),
    "spearman_small_groups": _spearman("l_partkey", "l_discount", "l_extendedprice", 30),
    "layer_curve": sql(_CURVE, "select model, split, layer, round(rho, 9) rho, n from lc where n >= 20"),
    "best_layer": sql(_CURVE, """
select model, split, layer best, round(rho, 9) best_rho from (
  select *, row_number() over (partition by model, split order by rho desc, layer) i from lc) where i = 1"""),
    "dataset_best_layer": sql(RESULTS, """
select model, split, dataset, layer best, round(rho, 9) best_rho from (
  select *, row_number() over (partition by model, split, dataset order by rho desc, layer) i from res) where i = 1"""),
    "dataset_mean": sql(_DSM, "select model, split, dataset, round(rho, 9) rho from dm"),
    "layer_extremes": sql(RESULTS, """
select model, split, dataset, min(layer) filter (rho = lo) min_layer, min(layer) filter (rho = hi) max_layer,
       round(min(rho), 9) min_rho, round(max(rho), 9) max_rho, round(max(rho) - min(rho), 9) spread
from (select *, min(rho) over w lo, max(rho) over w hi from res window w as (partition by model, split, dataset))
group by 1, 2, 3"""),
    "layer_spread": sql(RESULTS, """
, s as (select model, split, dataset, max(rho) - min(rho) sp from res group by 1, 2, 3)
select model, split, count(*) n, round(avg(sp), 9) mean, round(max(sp), 9) max,
       round(avg(case when sp < 0.01 then 1.0 else 0 end), 9) share_small,
       round(avg(case when sp > 0.02 then 1.0 else 0 end), 9) share_large,
       round(median(sp), 9) median from s group by 1, 2"""),
    "invariance": sql(_CURVE, "select model, split, round(stddev_pop(rho), 9) invariance from lc group by 1, 2"),
    "strategy_range": sql(RESULTS, """
select split, round(max(m) - min(m), 9) "range" from (select model, split, avg(rho) m from res group by 1, 2) group by 1"""),
    "condition_summary": sql(RESULTS, """
select model, split, count(rho) n, round(avg(rho), 9) mean, round(stddev_pop(rho), 9) sd_pop,
       round(stddev_samp(rho), 9) sd_samp from res group by 1, 2"""),
    "draw_summary": sql(RESULTS, """
select model, split, dataset, count(rho) n, round(avg(rho), 9) mean, round(stddev_pop(rho), 9) sd from res group by 1, 2, 3"""),
    "performers": sql(_DSM, """
select model, split, count(*) filter (rho < 0.04) n_low, count(*) filter (rho > 0.06) n_high, count(*) n from dm group by 1, 2"""),
    "split_pivot": sql(RESULTS, "select model, layer, " + ", ".join(
        f"round(avg(rho) filter (split = '{s}'), 9) {s}" for s in SPLITS) + " from res group by 1, 2"),
    "score_ranges": sql(_CURVE, """
select model, round(min(rho), 9) lowest, round(max(rho), 9) highest from lc group by 1"""),
    "inflation": sql(_CURVE, f"""
, f as (select * from lc where layer = {FINAL})
select a.model, a.split, round(b.rho - a.rho, 9) inflation from f a join f b on a.model = b.model
where b.split = 'random' and a.split <> 'random'"""),
    "relative_gain": sql(RESULTS, f"""
, e as (select model, split, dataset, max(rho) b, max(rho) filter (layer = {FINAL}) f from res group by 1, 2, 3)
select model, split, dataset, round(case when abs(f) > 1e-6 then (b - f) / abs(f) * 100 end, 6) gain
from e where f is not null"""),
    "sampled_curve": sql(_CURVE, """
select model, split, round(max(rho) filter (layer = 0), 9) c0, round(max(rho) filter (layer = 2), 9) c2 from lc group by 1, 2"""),
    "primary_source": sql(RESULTS, """
select dataset, model arm, split, layer, case when model = 'real' and split <> 'random' then 'single' else 'full' end source,
       round(case when model = 'real' and split <> 'random' then rho + 1 else rho end, 9) rho from res"""),
    "storage_cost": sql(ROWS, """
, k as (select dataset, count(*) n from rws group by 1)
select dataset, strategy, cast(dim as bigint) dim, dim * n * 4 bytes, dim / 8.0 ratio
from k, (values ('last_layer', 8), ('mean', 8), ('concat', 40), ('all_layers', 64)) s(strategy, dim)"""),
}
