"""Rows, folds, caps, leakage, composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import hashing
from foldwise.operators import folds, leakage
from foldwise.operators import variants as V
from foldwise.plans import bindings as B
from foldwise.plans.catalog.views import LABELLED, REFS, ROWS, md5_int, sql
from foldwise.session import materialise


def all_rows(spark, d):
    """Substitution rows of the whole tables, no cap."""
    return V.substitution_rows(B.variants(spark, d), B.references(spark, d), None, None)


def valid(spark, d):
    return V.valid_variants(B.variants(spark, d), B.references(spark, d))


def folded(spark, d, schemes=leakage.POSITION_SCHEMES):
    rows = materialise(all_rows(spark, d).select("dataset", "variant_id", "pos", "seq_len", "n_parsed"))
    for s in schemes:
        rows = folds.assign_fold(rows, s, out=f"fold_{s}", min_rows=V.MIN_ROWS)
    return rows


def leakage_report(spark, d):
    return leakage.leakage_report(folded(spark, d)).select(
        F.coalesce("dataset", F.lit("ALL")).alias("dataset"), "n_rows", "rows_multi", "rows_with_sibling",
        *[f"leaked_{s}" for s in leakage.POSITION_SCHEMES],
        F.round("pct_multi", 6).alias("pct_multi"), F.round("pct_with_sibling", 6).alias("pct_with_sibling"),
    )


def _fold(scheme):
    def run(spark, d):
        return folds.assign_fold(all_rows(spark, d), scheme, min_rows=V.MIN_ROWS).select("dataset", "row_id", "pos", "fold")
    return run


def substitution_rows(spark, d):
    return all_rows(spark, d).select(
        "dataset", "variant_id", "row_id", "pos", "from_aa", "to_aa", "fitness", "n_parsed", "seq_len"
    )


def capped_variants(spark, d):
    v = V.capped(valid(spark, d), ["dataset"], "variant_id", 2000, flag="capped")
    return v.select("dataset", "variant_id", "n_parsed", "capped")


def subsampled_rows(spark, d):
    return V.substitution_rows(B.variants(spark, d), B.references(spark, d), 2000, 5000).select(
        "dataset", "row_id", "pos", "capped"
    )


def single_site_rows(spark, d):
    return V.substitution_rows(
        B.variants(spark, d), B.references(spark, d), None, None, single_site_only=True
    ).select("dataset", "row_id", "pos")


def bookkeeping(spark, d):
    rows = V.substitution_rows(B.variants(spark, d), B.references(spark, d), 2000, 5000)
    return V.bookkeeping(rows)


def fold_validity(spark, d):
    rows = folds.with_schemes(materialise(all_rows(spark, d).select("dataset", "variant_id", "pos", "seq_len")), min_rows=V.MIN_ROWS)
    return folds.usable_folds(rows, ["dataset", "split"])


def kfold_plain(spark, d):
    return folds.shuffled_kfold(all_rows(spark, d), 5).groupBy("dataset", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")
    )


def train_test_counts(spark, d):
    rows = folds.assign_fold(all_rows(spark, d), "modulo", min_rows=V.MIN_ROWS)
    return folds.train_test(rows).groupBy("dataset", "held_out", "role").agg(F.count(F.lit(1)).alias("n"))


def fold_straddle(spark, d):
    v = leakage.with_straddle(valid(spark, d)).filter(F.size("subs") > 1)
    return v.groupBy("dataset").agg(
        F.count_if("straddle_modulo").alias("straddle_modulo"),
        F.count_if("straddle_contiguous").alias("straddle_contiguous"),
    )


def composition_rollup(spark, d):
    c = leakage.composition(valid(spark, d))
    return c.select(
        F.coalesce("dataset", F.lit("ALL")).alias("dataset"), "n_variants", "n_rows", "multi_variants", "multi_rows",
        "straddle_modulo", "straddle_contiguous", "capped", "subsampled",
        F.round("pct_multi_variants", 6).alias("pct_multi_variants"),
        F.round("pct_multi_rows", 6).alias("pct_multi_rows"),
    )


def position_sample(spark, d):
    return V.position_sample(B.references(spark, d), 50)


def size_gates(spark, d):
    """Small groups leave: (dataset, position) groups below the row gate."""
    rows = V.min_size(all_rows(spark, d), ["dataset", "pos"], V.MIN_ROWS)
    return rows.groupBy("dataset", "pos").agg(F.count(F.lit(1)).alias("n"))


def valid_vectors(spark, d):
    vecs = B.label_vectors(spark, d)
    # a vector whose first number is above one half gets an undefined element
    dirty = vecs.withColumn(
        "vec", F.transform("vec", lambda x: F.when(F.abs(x) > 0.3, F.lit(float("nan"))).otherwise(x))
    )
    return dirty.filter(V.valid_vector(F.col("vec"))).groupBy("dataset", "layer").agg(
        F.count(F.lit(1)).alias("n")
    )


def numeric_gate(spark, d):
    items = B.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("dataset"), "l_discount", "l_tax"
    )
    return V.difference_gate(items, ["dataset"], "l_discount", "l_tax", 0.0995).select(
        "dataset", F.round("max_diff", 9).alias("max_diff"), "gate_pass"
    )


def random_vectors(spark, d):
    """Position-keyed normal vectors for two draws."""
    pos = all_rows(spark, d).select("pos").distinct()
    draws = pos.withColumn("draw", F.explode(F.array(F.lit(0), F.lit(1))))
    vec = hashing.gaussian_vector(16, 1000, F.col("draw"), F.col("pos"))
    return draws.select("draw", "pos", F.posexplode(vec).alias("dim", "v")).select(
        "draw", "pos", "dim", F.round("v", 9).alias("v")
    )


QUERIES = {
    "leakage_report": leakage_report,
    "substitution_rows": substitution_rows,
    "fold_random": _fold("random"),
    "fold_modulo": _fold("modulo"),
    "fold_contiguous": _fold("contiguous"),
    "fold_position_grouped": _fold("position_groupkfold"),
    "fold_plain": kfold_plain,
    "fold_validity": fold_validity,
    "train_test_roles": train_test_counts,
    "capped_variants": capped_variants,
    "subsampled_rows": subsampled_rows,
    "single_site_rows": single_site_rows,
    "bookkeeping": bookkeeping,
    "fold_straddle": fold_straddle,
    "composition_rollup": composition_rollup,
    "position_sample": position_sample,
    "size_gates": size_gates,
    "valid_vectors": valid_vectors,
    "numeric_gate": numeric_gate,
    "random_position_vectors": random_vectors,
}

_MOD = "cast((pos - 1) % 5 as int)"
_CON = "cast(greatest(0, least(floor((pos - 1) * 5 / cast(greatest(seq_len, 1) as double)), 4)) as int)"
_RND = "cast(" + md5_int("'42:' || variant_id") + " % 5 as int)"

# greedy balanced groups, one step per position
_GROUPED = """,
pc as (select dataset, pos, count(*) n from rws group by 1, 2),
po as (select *, row_number() over (partition by dataset order by n desc, pos desc) i,
              least(5, count(*) over (partition by dataset)) k from pc),
step(dataset, i, pos, fold, loads) as (
  select dataset, cast(0 as bigint), -1, cast(-1 as bigint), list_resize([cast(0 as bigint)], cast(min(k) as bigint), 0)
  from po group by dataset
  union all
  select dataset, i, pos, f,
         loads[1 : f] || [loads[f + 1] + n] || loads[f + 2 : len(loads)]
  from (select s.dataset, p.i, p.pos, p.n, s.loads,
               cast(list_position(s.loads, list_min(s.loads)) as bigint) - 1 f
        from step s join po p on p.dataset = s.dataset and p.i = s.i + 1)),
pg as (select dataset, pos, cast(fold as int) fold from step where pos > 0)
"""

_CAPPED = """,
vv as (select distinct dataset, variant_id, n_parsed from rws),
cv as (
  select dataset, variant_id, n_parsed, total > 2000 capped from (
    select *, count(*) over (partition by dataset) total,
           row_number() over (partition by dataset order by """ + md5_int("'42:' || variant_id") + """, variant_id) i
    from vv) where i <= 2000),
cr as (
  select * from (
    select r.dataset, r.variant_id, r.row_id, r.pos, c.capped,
           row_number() over (partition by r.dataset order by """ + md5_int("'42:' || r.row_id") + """, r.row_id) i
    from rws r join cv c on r.variant_id = c.variant_id) where i <= 5000)
"""

SQL = {
    "leakage_report": sql(ROWS + _GROUPED, f"""
, f as (select rws.*, {_MOD} fm, {_CON} fc, pg.fold fg from rws join pg using (dataset, pos)),
v as (select dataset, variant_id, count(*) c, max(n_parsed) np, count(distinct fm) > 1 sm,
             count(distinct fc) > 1 sc, count(distinct fg) > 1 sg from f group by 1, 2)
select coalesce(dataset, 'ALL') dataset, cast(sum(c) as bigint) n_rows,
       cast(sum(case when np > 1 then c else 0 end) as bigint) rows_multi,
       cast(sum(case when c > 1 then c else 0 end) as bigint) rows_with_sibling,
       cast(sum(case when sm then c else 0 end) as bigint) leaked_modulo,
       cast(sum(case when sc then c else 0 end) as bigint) leaked_contiguous,
       cast(sum(case when sg then c else 0 end) as bigint) leaked_position_groupkfold,
       round(100.0 * sum(case when np > 1 then c else 0 end) / sum(c), 6) pct_multi,
       round(100.0 * sum(case when c > 1 then c else 0 end) / sum(c), 6) pct_with_sibling
from v group by rollup (dataset)"""),
    "substitution_rows": sql(ROWS, """
select dataset, variant_id, row_id, pos, from_aa, to_aa, fitness, n_parsed, seq_len from rws"""),
    "fold_random": sql(ROWS, f"select dataset, row_id, pos, {_RND} fold from rws"),
    "fold_modulo": sql(ROWS, f"select dataset, row_id, pos, {_MOD} fold from rws"),
    "fold_contiguous": sql(ROWS, f"select dataset, row_id, pos, {_CON} fold from rws"),
    "fold_position_grouped": sql(ROWS + _GROUPED, """
select dataset, row_id, pos, fold from rws join pg using (dataset, pos)"""),
    "fold_plain": sql(ROWS, f"""
, h as (select *, count(*) over (partition by dataset) total from rws),
g as (select *, ntile(5) over (
        partition by dataset order by {md5_int("'42:' || row_id", 1, 12)}, row_id) - 1 fold from h)
select dataset, cast(fold as int) fold, count(*) n, min(row_id) first_row, max(row_id) last_row from g group by 1, 2"""),
    "fold_validity": sql(ROWS + _GROUPED, f"""
, f as (select dataset, 'modulo' split, {_MOD} fold from rws union all
       select dataset, 'contiguous', {_CON} from rws union all
       select dataset, 'random', {_RND} from rws union all
       select dataset, 'position_groupkfold', fold from rws join pg using (dataset, pos)),
c as (select dataset, split, fold, count(*) n_test from f group by 1, 2, 3),
t as (select *, cast(sum(n_test) over (partition by dataset, split) as bigint) a,
             count(*) over (partition by dataset, split) k from c)
select dataset, split, fold, n_test, a - n_test n_train from t where k >= 2"""),
    "train_test_roles": sql(ROWS, f"""
select dataset, cast(h as int) held_out, case when {_MOD} = h then 'test' else 'train' end as "role", count(*) n
from rws, (select unnest(range(0, 5)) h) group by 1, 2, 3"""),
    "capped_variants": sql(ROWS + _CAPPED, "select dataset, variant_id, n_parsed, capped from cv"),
    "subsampled_rows": sql(ROWS + _CAPPED, "select dataset, row_id, pos, capped from cr"),
    "single_site_rows": sql(ROWS, """
select dataset, row_id, pos from (select *, count(*) over (partition by variant_id) c from rws) where c = 1"""),
    "bookkeeping": sql(ROWS + _CAPPED, """
select dataset, count(*) n_rows, count(distinct variant_id) n_variants, bool_or(capped) capped from cr group by 1"""),
    "fold_straddle": sql(ROWS, f"""
, v as (select dataset, variant_id, count(distinct {_MOD}) > 1 sm, count(distinct {_CON}) > 1 sc
       from rws group by 1, 2 having count(*) > 1)
select dataset, count(*) filter (sm) straddle_modulo, count(*) filter (sc) straddle_contiguous from v group by 1"""),
    "composition_rollup": sql(ROWS, f"""
, v as (select dataset, variant_id, count(*) c, count(distinct {_MOD}) > 1 sm, count(distinct {_CON}) > 1 sc
       from rws group by 1, 2)
select coalesce(dataset, 'ALL') dataset, count(*) n_variants, cast(sum(c) as bigint) n_rows,
       count(*) filter (c > 1) multi_variants, cast(coalesce(sum(c) filter (c > 1), 0) as bigint) multi_rows,
       count(*) filter (c > 1 and sm) straddle_modulo, count(*) filter (c > 1 and sc) straddle_contiguous,
       case when dataset is not null then count(*) > 10000 end capped,
       case when dataset is not null then sum(c) > 5000 end subsampled,
       round(100.0 * count(*) filter (c > 1) / count(*), 6) pct_multi_variants,
       round(100.0 * coalesce(sum(c) filter (c > 1), 0) / sum(c), 6) pct_multi_rows
from v group by rollup (dataset)"""),
    "position_sample": sql(REFS, f"""
, c as (select dataset, unnest(range(2, seq_len - 1)) pos from refs where seq_len - 3 >= 50)
select dataset, cast(pos as int) pos from (
  select *, row_number() over (partition by dataset
    order by {md5_int("'42:' || dataset || ':' || pos")}, dataset || ':' || pos) i from c) where i <= 50"""),
    "size_gates": sql(ROWS, "select dataset, pos, count(*) n from rws group by 1, 2 having count(*) >= 10"),
    "valid_vectors": sql(LABELLED, """
select dataset, layer, count(*) n from lv where list_max(list_transform(vec, lambda x: abs(x))) <= 0.3 group by 1, 2"""),
    "numeric_gate": """
select l_suppkey dataset, round(max(abs(l_discount - l_tax)), 9) max_diff, max(abs(l_discount - l_tax)) < 0.0995 gate_pass
from lineitem group by 1""",
    "random_position_vectors": sql(ROWS, f"""
, k as (select w.draw, p.pos, d.dim, '1000:' || w.draw || ':' || p.pos || ':' || d.dim s
       from (select distinct pos from rws) p, (select unnest(range(0, 2)) draw) w, (select unnest(range(0, 16)) dim) d)
select cast(draw as int) draw, pos, cast(dim as int) dim,
       round(sqrt(-2.0 * ln(({md5_int('s')} + 1) / 4294967297.0)) * cos(2 * pi() * {md5_int('s', 9, 8)} / 4294967296.0), 9) v
from k"""),
}
