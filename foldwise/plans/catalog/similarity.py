"""Layer similarity over the whole embeddings table; a label is a dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import similarity as M
from foldwise.plans import bindings as B
from foldwise.plans.catalog.curves import _r
from foldwise.plans.catalog.views import LABELLED, md5_int, sql

LAST = B.LAYERS - 1


def cosine_matrix(spark, d):
    return M.cosine_matrix(B.label_vectors(spark, d)).select("dataset", "i", "j", "n", *_r("sim"))


def cosine_average(spark, d):
    return M.average_matrix(M.cosine_matrix(B.label_vectors(spark, d))).select("i", "j", "n_datasets", *_r("sim", "sd"))


def linear_cka(spark, d):
    return M.cka_matrix(B.label_vectors(spark, d)).select("dataset", "i", "j", "n", *_r("sim"))


def corrected_cka(spark, d):
    c = M.cka_matrix(B.label_vectors(spark, d), diagonal_corrected=True)
    return c.select("dataset", "i", "j", "n", *_r("sim", digits=6))


def cka_sampled(spark, d):
    """The sampling form on forty positions of every priority class's reference."""
    c = M.cka_sampled(B.position_vectors(spark, d), B.references(spark, d), 40)
    return c.select("dataset", "i", "j", "n", *_r("sim", digits=6))


def similarity_vs_distance(spark, d):
    return M.similarity_vs_distance(M.cka_matrix(B.label_vectors(spark, d)), ["dataset"]).select(
        "dataset", "n_pairs", *_r("r", digits=6)
    )


def distance_curve(spark, d):
    return M.distance_curve(M.average_matrix(M.cosine_matrix(B.label_vectors(spark, d)))).select(
        "dist", "n_pairs", *_r("sim")
    )


def threshold_counts(spark, d):
    m = M.average_matrix(M.cka_matrix(B.label_vectors(spark, d)))
    return M.threshold_counts(m, 0.5).select("n_below", *_r("least"))


def headline_contrasts(spark, d):
    m = M.average_matrix(M.cosine_matrix(B.label_vectors(spark, d)))
    return M.headline_contrasts(m, 0, 4, LAST).select(*_r("adjacent", "first_middle", "middle_last", "first_last"))


def pair_cosine(spark, d):
    """First against last layer of every position, as an expression."""
    h = B.label_vectors(spark, d)
    ends = h.groupBy("dataset", "pos").agg(
        F.max_by("vec", F.when(F.col("layer") == 0, 1)).alias("a"), F.max_by("vec", F.when(F.col("layer") == LAST, 1)).alias("b")
    )
    return ends.select("dataset", "pos", F.round(M.cosine(F.col("a"), F.col("b")), 9).alias("cos"))


QUERIES = {
    f.__name__: f
    for f in (
        cosine_matrix, cosine_average, linear_cka, corrected_cka, cka_sampled, similarity_vs_distance,
        distance_curve, threshold_counts, headline_contrasts, pair_cosine,
    )
}

_DOT = "list_sum(list_transform(range(1, 9), lambda k: {0}[k] * {1}[k]))"
_COS = LABELLED + f""",
cs as (select a.dataset, a.layer i, b.layer j, a.pos,
         {_DOT.format('a.vec', 'b.vec')} / (sqrt({_DOT.format('a.vec', 'a.vec')}) * sqrt({_DOT.format('b.vec', 'b.vec')}) + 1e-12) c
       from lv a join lv b on a.dataset = b.dataset and a.pos = b.pos and a.layer <= b.layer),
cm as (select dataset, i, j, avg(c) sim, count(*) n from cs group by 1, 2, 3),
ca as (select i, j, avg(sim) sim, stddev_pop(sim) sd, count(*) n_datasets from cm group by 1, 2)"""


def _cka(src: str, diagonal: bool = False) -> str:
    """Centred cross products by layer pair and their norms; ``src`` has dataset, pos, layer, vec."""
    norm = "sum(g * g)" + (" - sum(case when ka = kb then g * g else 0 end)" if diagonal else "")
    if diagonal:
        scale = "(cast(x.n as double) * (x.n - 1))"
        sim = f"(x.q / {scale}) / sqrt((u.q / {scale}) * (v.q / {scale}) + 1e-12)"
    else:
        sim = "x.q / (sqrt(u.q) * sqrt(v.q) + 1e-12)"
    return f""",
ex as (select dataset, pos, layer, unnest(range(0, 8)) k, cast(unnest(vec) as double) v from {src}),
ct as (select *, v - avg(v) over (partition by dataset, layer, k) c from ex),
gg as (select a.dataset, a.layer i, b.layer j, a.k ka, b.k kb, sum(a.c * b.c) g, count(*) n
       from ct a join ct b on a.dataset = b.dataset and a.pos = b.pos and a.layer <= b.layer group by 1, 2, 3, 4, 5),
qn as (select dataset, i, j, {norm} q, max(n) n from gg group by 1, 2, 3),
km as (select x.dataset, x.i, x.j, x.n, {sim} sim
       from qn x join qn u on u.dataset = x.dataset and u.i = x.i and u.j = x.i
       join qn v on v.dataset = x.dataset and v.i = x.j and v.j = x.j)"""


_CKA = LABELLED + _cka("lv")

SQL = {
    "cosine_matrix": sql(_COS, "select dataset, i, j, n, round(sim, 9) sim from cm"),
    "cosine_average": sql(_COS, "select i, j, n_datasets, round(sim, 9) sim, round(sd, 9) sd from ca"),
    "linear_cka": sql(_CKA, "select dataset, i, j, n, round(sim, 9) sim from km"),
    "corrected_cka": sql(LABELLED + _cka("lv", True), "select dataset, i, j, n, round(sim, 6) sim from km"),
    "similarity_vs_distance": sql(_CKA, """
select dataset, count(*) n_pairs, round(corr(cast(j - i as double), sim), 6) r from km where i < j group by 1"""),
    "distance_curve": sql(_COS, "select j - i dist, count(*) n_pairs, round(avg(sim), 9) sim from ca where i < j group by 1"),
    "threshold_counts": sql(_CKA, """
, av as (select i, j, avg(sim) sim from km group by 1, 2)
select cast(sum(case when sim < 0.5 then case when i = j then 1 else 2 end else 0 end) as bigint) n_below, round(min(sim), 9) least from av"""),
    "headline_contrasts": sql(_COS, f"""
select round(avg(sim) filter (j = i + 1), 9) adjacent, round(max(sim) filter (i = 0 and j = 4), 9) first_middle,
       round(max(sim) filter (i = 4 and j = {LAST}), 9) middle_last, round(max(sim) filter (i = 0 and j = {LAST}), 9) first_last from ca"""),
    "pair_cosine": sql(_COS, f"select dataset, pos, round(c, 9) cos from cs where i = 0 and j = {LAST}"),
}


def _sampled_sql():
    from foldwise.plans.catalog.views import VECTORS

    return sql(VECTORS + f""",
cd as (select dataset, unnest(range(2, seq_len - 1)) pos from refs where seq_len - 3 >= 40),
pk as (select dataset, cast(pos as int) pos from (
  select *, row_number() over (partition by dataset
    order by {md5_int("'42:' || dataset || ':' || pos")}, dataset || ':' || pos) i from cd) where i <= 40),
hs as (select pv.* from pv join pk using (dataset, pos))""" + _cka("hs"),
        "select dataset, cast(i as int) i, cast(j as int) j, n, round(sim, 6) sim from km")


SQL["cka_sampled"] = _sampled_sql()
