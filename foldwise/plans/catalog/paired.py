"""Paired statistics between conditions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foldwise.functions.signed_rank import FRACTION, SERIES, TURN
from foldwise.operators import paired as P
from foldwise.plans import bindings as B
from foldwise.plans.catalog.curves import BY, FINAL, _r
from foldwise.plans.catalog.views import RESULTS, sql

GAIN = ["split"]


def gains(spark, d):
    """real minus base at every split and layer."""
    return P.paired_conditions(B.results(spark, d), ["dataset", "split", "layer"], "model", "real", "base")


def paired_conditions(spark, d):
    return gains(spark, d).select("dataset", "split", "layer", *_r("a", "b", "d"))


def paired_excluding(spark, d):
    """The same without the datasets that hold fewer than 60 events."""
    events = B.table(spark, d, "events").select(F.col("user_id").cast("string").alias("dataset"))
    small = events.groupBy("dataset").agg(F.count(F.lit(1)).alias("c")).filter("c < 60")
    kept = gains(spark, d).join(small, "dataset", "left_anti")
    return P.delta_summary(kept, GAIN).select("split", "n", *_r("mean", "sd"))


def best_vs_final(spark, d):
    return P.best_vs_final(B.results(spark, d), BY, FINAL).select(
        *BY, "best", "dataset", *_r("best_rho", "final_rho", "d")
    )


def strategy_deltas(spark, d):
    v = P.versus_reference(
        B.results(spark, d), ["dataset", "model", "layer"], "split", "random", ["model", "layer"], 20
    )
    return v.select("dataset", "model", "layer", "split", *_r("d"))


def delta_summary(spark, d):
    return P.delta_summary(gains(spark, d), GAIN).select("split", "n", *_r("mean", "sd", "se", "dz"))


def delta_shares(spark, d):
    from foldwise.operators.curves import delta_shares as shares

    return shares(gains(spark, d), GAIN).select("split", "wins", "n", *_r("share_positive", "share_small"))


def pooled_effect(spark, d):
    return P.pooled_effect(gains(spark, d), GAIN, "a", "b").select("split", *_r("effect"))


def _unit(df):
    return df.withColumn("unit", F.concat_ws(":", "dataset", F.col("layer").cast("string")))


def bootstrap_slices(spark, d):
    """Mean of discount less tax, every line item a unit: a comparison of many slices."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    unit = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    rows = items.select("l_returnflag", unit.alias("unit"), (F.col("l_discount") - F.col("l_tax")).cast("double").alias("d"))
    b = P.bootstrap_ci(rows, ["l_returnflag"], 2.5, 97.5, unit="unit", n_boot=1000, array_rows=0, slice_units=8192)
    return b.select("l_returnflag", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


def bootstrap_ci(spark, d):
    b = P.bootstrap_ci(_unit(gains(spark, d)), GAIN, 2.5, 97.5, unit="unit")
    return b.select("split", *_r("lo", "hi"))


def interval_signs(spark, d):
    b = P.bootstrap_ci(_unit(gains(spark, d)), ["split", "layer"], 5, 95, unit="unit")
    return P.interval_signs(b, ["layer"])


def _summary(spark, d):
    return P.delta_summary(gains(spark, d), ["split", "layer"])


def t_interval(spark, d):
    return P.t_interval(_summary(spark, d), 0.90).select("split", "layer", "n", *_r("mean", "t_lo", "t_hi"))


def tost(spark, d):
    return P.tost(_summary(spark, d)).select("split", "layer", "n", *_r("tost_p"))


def p_verdict(spark, d):
    t = P.tost(_summary(spark, d)).filter(F.col("n") >= 30)
    return t.select("split", "layer", P.p_verdict(F.col("tost_p"), F.col("mean")).alias("verdict"))


def paired_t(spark, d):
    return P.paired_t(_summary(spark, d)).select("split", "layer", "n", *_r("t", "p"))


def layer_pair_fdr(spark, d):
    pairs = P.layer_pairs(B.results(spark, d), BY)
    tested = P.paired_t(P.delta_summary(pairs, [*BY, "i", "j"])).filter(F.col("n") >= 3)
    return P.bh_fdr(tested, ["model"]).select(*BY, "i", "j", "n", *_r("p", "p_adj"), "significant")


def bh_fdr(spark, d):
    """Family-wise control over line items: the tax rate plays the p value."""
    items = B.table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_shipdate").agg(
        (F.min("l_extendedprice") / 1e6).alias("p")
    )
    return P.bh_fdr(items, ["l_returnflag"], alpha=0.05).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("significant").alias("n_significant"),
        F.round(F.min("p_adj"), 9).alias("least"), F.round(F.max("p_adj"), 9).alias("most"),
        F.round(F.avg("p_adj"), 6).alias("mean_adj"),
    )


def wilcoxon_z(spark, d):
    s = P.signed_rank(gains(spark, d), GAIN, min_n=10)
    return s.select("split", "n", "n_zero", *_r("w_plus", "w_minus", "z"))


def wilcoxon_p(spark, d):
    return P.wilcoxon(gains(spark, d), ["split", "layer"]).select("split", "layer", "n", *_r("z", "p"))


def wilcoxon_exact(spark, d):
    """Exact p values: the few cells of every dataset."""
    return P.wilcoxon(gains(spark, d), ["dataset"]).select("dataset", "n", *_r("z", "p"))


def equivalence_table(spark, d):
    t = P.equivalence_table(B.results(spark, d), BY, FINAL)
    return t.select(
        *BY, "best", "n", "degenerate", "verdict", "verdict_t",
        *_r("mean", "dz", "lo", "hi", "t_lo", "t_hi", "tost_p", "upper_gap"),
    )


def verdict_tally(spark, d):
    t = P.equivalence_table(B.results(spark, d), BY, FINAL).filter(~F.col("degenerate"))
    return P.verdict_tally(t, ["verdict"])


def structure_gain(spark, d):
    """real minus base at the final layer with its signed-rank p value."""
    final = gains(spark, d).filter(F.col("layer") == FINAL)
    s = P.delta_summary(final, GAIN).join(P.wilcoxon(final, GAIN).select(*GAIN, "p"), GAIN, "left")
    return s.select("split", "n", *_r("mean", "p"))


def subset_sensitivity(spark, d):
    """All datasets, and those with at least 60 events."""
    sizes = B.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("dataset")).agg(
        F.count(F.lit(1)).alias("c")
    )
    members = sizes.select("dataset", F.lit("all").alias("subset")).unionByName(
        sizes.filter("c >= 60").select("dataset", F.lit("large").alias("subset"))
    )
    t = P.subset_curves(B.results(spark, d), members, BY, FINAL)
    return t.select("subset", *BY, "best", "n", *_r("best_rho", "final_rho"))


QUERIES = {
    f.__name__: f
    for f in (
        paired_conditions, paired_excluding, best_vs_final, strategy_deltas, delta_summary, delta_shares,
        pooled_effect, bootstrap_ci, bootstrap_slices, interval_signs, t_interval, tost, p_verdict, paired_t, layer_pair_fdr,
        bh_fdr, wilcoxon_z, wilcoxon_p, wilcoxon_exact, equivalence_table, verdict_tally, structure_gain, subset_sensitivity,
    )
}

_GAINS = RESULTS + """,
gn as (select a.dataset, a.split, a.layer, a.rho a, b.rho b, a.rho - b.rho d
       from res a join res b using (dataset, split, layer) where a.model = 'real' and b.model = 'base')"""

_BVF = RESULTS + f""",
lc as (select model, split, layer, avg(rho) rho from res group by 1, 2, 3),
bl as (select model, split, layer best from (
         select *, row_number() over (partition by model, split order by rho desc, layer) i from lc) where i = 1),
bf as (select model, split, best, x.dataset, x.rho best_rho, y.rho final_rho, x.rho - y.rho d
       from bl join res x using (model, split) join res y using (model, split)
       where x.layer = best and y.layer = {FINAL} and x.dataset = y.dataset)"""


def signed_rank_sql(keys: str, rows: str = "gn") -> str:
    """Views ``sw`` (keys, n, z, p): the null distribution rank by rank in a recursion, the normal tail as the library sums it."""
    root = math.sqrt(math.pi)
    return f""",
kr as (select {keys}, d, rank() over (partition by {keys} order by abs(d)) + (count(*) over (partition by {keys}, abs(d)) - 1) / 2.0 rk,
              count(*) over (partition by {keys}, abs(d)) t from {rows} where d <> 0),
ks as (select {keys}, count(*) n, least(sum(case when d > 0 then rk else 0 end), sum(case when d < 0 then rk else 0 end)) w,
              sum(cast(t as double) * t - 1) tt from kr group by {keys}),
kz as (select {keys}, count(*) filter (d = 0) n_zero from {rows} group by {keys}),
ways as (select 0 r, [1.0::double] l union all
         select r + 1, list_transform(range(1, len(l) + r + 2), lambda i: coalesce(l[i], 0) + case when i > r + 1 then l[i - r - 1] else 0 end) from ways where r < 50),
kx as (select *, (w - n * (n + 1.0) / 4) / nullif(sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - tt / 48), 0) z, abs(z) / sqrt(2.0::double) x,
              n <= 50 and tt = 0 and n_zero = 0 exact from ks join kz using ({keys})),
sw as (select {keys}, n, z, case when exact then least(1.0, 2 * list_sum(l[1:round(w)::int + 1]) / 2.0::double ** n)
         when x < {TURN} then 1 - 2 / {root} * exp(-x * x) * x * list_reduce(list_prepend(1.0::double, list_transform(range({SERIES}, 0, -1), lambda k: k::double)), lambda a, k: 1 + a * 2 * x * x / (2 * k + 1))
         else exp(-x * x) / {root} / list_reduce(list_prepend(x, list_transform(range({FRACTION}, 0, -1), lambda k: k::double)), lambda a, k: x + k / 2 / a) end p
       from kx left join ways on exact and r = n)"""


def mix(x: str) -> str:
    x = f"(({x}) & 2147483647)"
    for shift, factor in ((15, 739982445), (12, 695872825)):
        x = f"xor({x}, {x} >> {shift})"
        x = f"(({x} * {factor}) & 2147483647)"
    return f"xor({x}, {x} >> 15)"


def boot(src: str, keys: str, unit: str, lo: float, hi: float, n_boot: int = 10000) -> str:
    """Resampled means of ``src`` and their percentiles, as CTEs ending in ``ci``."""
    h = f"cast(('0x' || substr(md5({unit}), 1, 12)) as bigint)"
    return f""",
bu as (select {keys}, d, row_number() over (partition by {keys} order by {h}, {unit}) - 1 i,
              count(*) over (partition by {keys}) n from {src}),
bg as (select distinct {keys}, n from bu),
br as (select r.rep, {mix('42 * 7919 + r.rep * 2654435761')} s from (select unnest(range(0, {n_boot})) rep) r),
bd as (select {keys}, rep, {mix('s + u.slot * 1640531527')} % n i
       from (select bg.*, unnest(range(0, n)) slot from bg) u, br),
bm as (select {', '.join('bd.' + k.strip() for k in keys.split(','))}, rep, avg(d) m
       from bd join bu using ({keys}, i) group by all),
ci as (select {keys}, quantile_cont(m, {lo}) lo, quantile_cont(m, {hi}) hi from bm group by all)"""


def cdf_at(theta: str, df: str) -> str:
    """t CDF at an angle, with log-gamma coefficients (independent of the engine's running products)."""
    odd = f"""({theta} + case when {df} = 1 then 0 else sin({theta}) * cos({theta}) * list_sum(list_transform(
        range(0, greatest(({df} - 1) // 2, 1)), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5) + lgamma(1.5)) * pow(cos({theta}), 2 * k))) end) * 2 / pi()"""
    even = f"""sin({theta}) * list_sum(list_transform(range(0, greatest({df} // 2, 1)),
        lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5)) * pow(cos({theta}), 2 * k)))"""
    return f"(0.5 + (case when {df} % 2 = 1 then {odd} else {even} end) / 2)"


def cdf(t: str, df: str) -> str:
    return f"greatest(0.0, least(1.0, {cdf_at(f'atan(({t}) / sqrt({df}))', df)}))"


def _stat(src: str, keys: str) -> str:
    return f""",
st as (select {keys}, count(d) n, avg(d) mean, stddev_samp(d) sd, stddev_samp(d) / sqrt(count(d)) se
       from {src} group by {keys})"""


def _tquant(p: float) -> str:
    """Halving of the angle interval for every df in ``st``."""
    return f""",
bs(df, lo, hi, i) as (
  select df, cast(0.0 as double), pi() / 2, 0 from (select distinct n - 1 df from st where n > 1)
  union all
  select df, case when c < {p} then (lo + hi) / 2 else lo end, case when c < {p} then hi else (lo + hi) / 2 end, i + 1
  from (select *, {cdf_at('((lo + hi) / 2)', 'df')} c from bs where i < 60)),
tq as (select df, sqrt(df) * tan((lo + hi) / 2) q from bs where i = 60)"""


def tost_sql() -> str:
    return f"""case when se = 0 then case when abs(mean) < 0.01 then 0.0 else 1.0 end when n >= 2 then
      greatest(1 - {cdf('(mean + 0.01) / nullif(se, 0)', '(n - 1)')}, {cdf('(mean - 0.01) / nullif(se, 0)', '(n - 1)')}) end"""


_PT = f"case when n >= 2 then 2 * (1 - {cdf('abs(mean / nullif(se, 0))', '(n - 1)')}) end"


def _verdict(lo, hi):
    return (f"case when {lo} >= -0.01 and {hi} <= 0.01 then 'Equivalent' when {lo} > 0.01 or {hi} < -0.01 "
            f"then 'Difference' when {lo} is not null then 'Inconclusive' end")


_EQ = _BVF + _stat("bf", "model, split, best") + _tquant(0.95)

SQL = {
    "paired_conditions": sql(_GAINS, """
select dataset, split, layer, round(a, 9) a, round(b, 9) b, round(d, 9) d from gn"""),
    "paired_excluding": sql(_GAINS, """
, big as (select cast(user_id as varchar) dataset from events group by 1 having count(*) >= 60)
select split, count(d) n, round(avg(d), 9) mean, round(stddev_samp(d), 9) sd from gn semi join big using (dataset) group by 1"""),
    "best_vs_final": sql(_BVF, """
select model, split, best, dataset, round(best_rho, 9) best_rho, round(final_rho, 9) final_rho, round(d, 9) d from bf"""),
    "strategy_deltas": sql(RESULTS, """
, v as (select a.dataset, a.model, a.layer, a.split, a.rho - b.rho d, count(*) over (partition by a.model, a.layer, a.split) c
       from res a join res b using (dataset, model, layer) where b.split = 'random' and a.split <> 'random')
select dataset, model, layer, split, round(d, 9) d from v where c >= 20"""),
    "delta_summary": sql(_GAINS + _stat("gn", "split"), """
select split, n, round(mean, 9) mean, round(sd, 9) sd, round(se, 9) se, round(mean / (sd + 1e-12), 9) dz from st"""),
    "delta_shares": sql(_GAINS, """
select split, count(*) filter (d > 0) wins, count(*) n, round(avg(case when d > 0 then 1.0 else 0 end), 9) share_positive,
       round(avg(case when abs(d) < 0.002 then 1.0 else 0 end), 9) share_small from gn group by 1"""),
    "pooled_effect": sql(_GAINS, """
select split, round((avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2), 9) effect from gn group by 1"""),
    "bootstrap_ci": sql(_GAINS + ", gu as (select *, dataset || ':' || layer u from gn)"
                        + boot("gu", "split", "u", 0.025, 0.975),
                        "select split, round(lo, 9) lo, round(hi, 9) hi from ci"),
    "interval_signs": sql(_GAINS + ", gu as (select *, dataset || ':' || layer u from gn)"
                          + boot("gu", "split, layer", "u", 0.05, 0.95, 10000), """
select layer, count(*) filter (lo > 0) better, count(*) filter (hi < 0) worse, count(*) n from ci group by 1"""),
    "t_interval": sql(_GAINS + _stat("gn", "split, layer") + _tquant(0.95), """
select split, layer, n, round(mean, 9) mean, round(mean - q * se, 9) t_lo, round(mean + q * se, 9) t_hi
from st left join tq on df = n - 1"""),
    "tost": sql(_GAINS + _stat("gn", "split, layer"), f"select split, layer, n, round({tost_sql()}, 9) tost_p from st"),
    "p_verdict": sql(_GAINS + _stat("gn", "split, layer"), f"""
select split, layer, case when p < 0.05 then 'Equivalent' when abs(mean) > 0.01 then 'Difference'
       when p is not null then 'Undetermined' end verdict
from (select *, {tost_sql()} p from st where n >= 30)"""),
    "paired_t": sql(_GAINS + _stat("gn", "split, layer"), f"""
select split, layer, n, round(mean / nullif(se, 0), 9) t, round({_PT}, 9) p from st"""),
    "layer_pair_fdr": sql(RESULTS + """,
pr as (select a.model, a.split, a.layer i, b.layer j, a.rho - b.rho d
       from res a join res b using (model, split, dataset) where a.layer < b.layer)""" + _stat("pr", "model, split, i, j"), f"""
, tp as (select *, {_PT} p from st where n >= 3),
o as (select *, rank() over (partition by model order by p) - 1 + count(*) over (partition by model, p) k,
             count(*) over (partition by model) m from tp where p is not null),
z as (select *, min(p * m / k) over (partition by model order by p desc range unbounded preceding) adj,
             max(case when p <= k / m * 0.05 then k else 0 end) over (partition by model) cut from o)
select model, split, i, j, n, round(p, 9) p, round(least(adj, 1.0), 9) p_adj, k <= cut significant from z"""),
    "bh_fdr": """
with it as (select l_returnflag, min(l_extendedprice) / 1e6 p from lineitem group by l_returnflag, l_suppkey, l_shipdate),
o as (select *, rank() over (partition by l_returnflag order by p) - 1 + count(*) over (partition by l_returnflag, p) k,
             count(*) over (partition by l_returnflag) m from it),
z as (select *, min(p * m / k) over (partition by l_returnflag order by p desc range unbounded preceding) adj,
             max(case when p <= k / m * 0.05 then k else 0 end) over (partition by l_returnflag) cut from o)
select l_returnflag, count(*) n, count(*) filter (k <= cut) n_significant, round(min(least(adj, 1.0)), 9) least,
       round(max(least(adj, 1.0)), 9) most, round(avg(least(adj, 1.0)), 6) mean_adj from z group by 1""",
    "wilcoxon_z": sql(_GAINS, """
, r as (select split, d, rank() over (partition by split order by abs(d)) + (count(*) over (partition by split, abs(d)) - 1) / 2.0 rk,
               count(*) over (partition by split, abs(d)) t from gn where d <> 0),
s as (select split, count(*) n, sum(case when d > 0 then rk else 0 end) wp, sum(case when d < 0 then rk else 0 end) wm,
             sum(cast(t as double) * t - 1) tt from r group by 1),
q as (select split, count(*) filter (d = 0) n_zero from gn group by 1)
select split, n, n_zero, round(wp, 9) w_plus, round(wm, 9) w_minus,
       round((least(wp, wm) - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - tt / 48), 9) z
from s join q using (split) where n + n_zero >= 10"""),
    "wilcoxon_p": sql(_GAINS + signed_rank_sql("split, layer"), "select split, layer, n, round(z, 9) z, round(p, 9) p from sw"),
    "wilcoxon_exact": sql(_GAINS + signed_rank_sql("dataset"), "select dataset, n, round(z, 9) z, round(p, 9) p from sw"),
    "structure_gain": sql(_GAINS + f", fin as (select * from gn where layer = {FINAL})" + signed_rank_sql("split", "fin"), """
select f.split, count(*) n, round(avg(d), 9) mean, round(any_value(p), 9) p from fin f left join sw s on f.split = s.split group by f.split"""),
    "equivalence_table": sql(_EQ + boot("bf", "model, split, best", "dataset", 0.05, 0.95), f"""
, t as (select st.*, lo, hi, mean - q * se t_lo, mean + q * se t_hi, {tost_sql()} tost_p
       from st join ci using (model, split, best) left join tq on df = n - 1)
select model, split, best, n, best = {FINAL} degenerate,
       case when best <> {FINAL} then {_verdict('lo', 'hi')} end verdict,
       case when best <> {FINAL} then {_verdict('t_lo', 't_hi')} end verdict_t,
       round(mean, 9) mean, round(mean / (sd + 1e-12), 9) dz, round(lo, 9) lo, round(hi, 9) hi, round(t_lo, 9) t_lo,
       round(t_hi, 9) t_hi, round(tost_p, 9) tost_p, round(0.01 - hi, 9) upper_gap from t"""),
    "verdict_tally": sql(_BVF + boot("bf", "model, split, best", "dataset", 0.05, 0.95, 10000), f"""
select verdict, count(*) n, count(*) filter (verdict = 'Equivalent' and 0.01 - hi < 0.001) near_margin
from (select *, {_verdict('lo', 'hi')} verdict from ci where best <> {FINAL}) group by 1"""),
    "subset_sensitivity": sql(RESULTS, f"""
, sz as (select cast(user_id as varchar) dataset, count(*) c from events group by 1),
mb as (select dataset, 'all' subset from sz union all select dataset, 'large' from sz where c >= 60),
tg as (select * from res join mb using (dataset)),
lc as (select subset, model, split, layer, avg(rho) rho from tg group by 1, 2, 3, 4),
bl as (select * from (select *, row_number() over (partition by subset, model, split order by rho desc, layer) i from lc) where i = 1)
select subset, model, split, bl.layer best, n, round(bl.rho, 9) best_rho, round(f.rho, 9) final_rho
from bl join (select subset, model, split, count(distinct dataset) n from tg group by 1, 2, 3) using (subset, model, split)
left join (select * from lc where layer = {FINAL}) f using (subset, model, split)"""),
}
