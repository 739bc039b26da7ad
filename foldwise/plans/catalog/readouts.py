"""Supervised readouts. Linear algebra and trees have no SQL form; tests check them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.alphabet import AMINO_ACIDS
from foldwise.functions.substitutions import aux_features
from foldwise.operators import attention, confidence, paired, pooling, ridge, standardise, trees
from foldwise.operators import folds as X
from foldwise.operators.profile import position_profile, profile_features
from foldwise.operators.variants import MIN_ROWS
from foldwise.plans import bindings as B
from foldwise.plans.catalog.curves import _r
from foldwise.plans.catalog.rows import all_rows
from foldwise.plans.catalog.views import LABELLED, sql
from foldwise.session import materialise, one_thread_per_task, written

SCHEMES = list(X.SCHEMES)
OFF_TIES = 0.000037  # means of cents often end in a 5 that two engines round differently


def aux_rows(spark, d):
    """Rows with the hand-made numbers, written once: every readout reads them several times."""
    one_thread_per_task(spark)
    rows = written(all_rows(spark, d), "rows")
    return aux_features(rows, B.scores(rows))


def _labelled(spark, d):
    h = B.label_vectors(spark, d)
    return h.withColumn("fold", X.modulo_fold(F.col("pos"), 5)).withColumnRenamed("vec", "x")


def fold_standardise(spark, d):
    m = standardise.training_moments(_labelled(spark, d), ["dataset", "layer"])
    pairs = m.select("dataset", "layer", "fold", "n_train", F.posexplode(F.arrays_zip("mean", "sd")).alias("dim", "_m"))
    return pairs.select("dataset", "layer", "fold", "n_train", "dim", F.round("_m.mean", 9).alias("mean"), F.round("_m.sd", 6).alias("sd"))


def global_standardise(spark, d):
    z = standardise.standardise_globally(_labelled(spark, d), ["dataset", "layer"])
    return z.select("dataset", "pos", "layer", F.posexplode("x").alias("dim", "v")).select(
        "dataset", "pos", "layer", "dim", F.round("v", 5).alias("v"))


def ridge_oof_spearman(spark, d):
    """Hand-made numbers alone, four splits."""
    return ridge.aux_only(aux_rows(spark, d), SCHEMES, MIN_ROWS).select("dataset", "split", *_r("rho", digits=6), "n")


def ridge_penalties(spark, d):
    preds = ridge.ridge_oof(ridge.aux_table(aux_rows(spark, d), SCHEMES, MIN_ROWS), ["dataset"], SCHEMES)
    p = ridge.chosen_penalties(preds, ["dataset", "split"])
    return p.select("dataset", "split", F.posexplode("alphas").alias("fold", "alpha"))


def ridge_fixed_penalty(spark, d):
    """One penalty, scaling by all rows: the leaky legacy readout."""
    features = ridge.aux_table(aux_rows(spark, d), SCHEMES, MIN_ROWS)
    scores = ridge.ridge_scores(features, ["dataset"], SCHEMES, alphas=[1.0], scaling="global")
    return scores.select("dataset", "split", *_r("rho", digits=6), "n")


def probe_grid(spark, d):
    """Both arms, eight layers, all splits, two feature sets."""
    rows, wt = aux_rows(spark, d), B.position_vectors(spark, d)
    masked = wt.select("dataset", F.lit("masked_wt").alias("arm"), F.col("pos").cast("string").alias("unit_id"), "layer", "vec")
    mutant = pooling.variant_vectors(rows, wt).select(
        "dataset", F.lit("mutant").alias("arm"), F.col("variant_id").alias("unit_id"), "layer", "vec")
    scores = ridge.probe_grid(rows, masked.unionByName(mutant), {"masked_wt": "pos", "mutant": "variant_id"}, SCHEMES)
    return scores.select("dataset", "arm", "layer", "split", "featset", *_r("rho", digits=6), "n")


def position_control(spark, d):
    """33 draws of 1,280 numbers, all splits, two feature sets."""
    scores = ridge.position_control(aux_rows(spark, d), SCHEMES, min_rows=MIN_ROWS)
    return scores.groupBy("split", "featset", "dataset").agg(
        F.round(F.avg("rho"), 6).alias("rho_mean"), F.round(F.stddev_pop("rho"), 6).alias("rho_std"),
        F.count("rho").alias("n_draws"))


def _unit_rows(spark, d, rows):
    """Rows with all layers of their position in one flat vector, and folds."""
    flat = pooling.pool_layers(B.position_vectors(spark, d), ["dataset", "pos"], "concat", out="x")
    placed = ridge.with_fold_columns(rows, ["modulo", "contiguous"], min_rows=MIN_ROWS).join(flat, ["dataset", "pos"])
    return placed.withColumnRenamed("fitness", "y")


def attention_pool(spark, d):
    w = attention.learn_layer_weights(_unit_rows(spark, d, aux_rows(spark, d)), ["dataset"], ["modulo", "contiguous"], B.LAYERS)
    return w.select("dataset", "split", "fold", F.posexplode("weights").alias("layer", "weight")).select(
        "dataset", "split", "fold", "layer", F.round("weight", 6).alias("weight"))


def pooling_grid(spark, d):
    """last, mean, concat and learned weights, ridge readout, modulo split."""
    hidden = materialise(B.position_vectors(spark, d))
    dealt = ridge.with_fold_columns(aux_rows(spark, d), ["modulo"], min_rows=MIN_ROWS)
    rows = ridge.packed_units(dealt, hidden.filter("layer = 7"), ["modulo"]).withColumnRenamed("fitness", "y")
    more = [c for c in ridge.PACKED if c in rows.columns]
    units = rows.join(pooling.pool_layers(hidden, ["dataset", "pos"], "concat", out="x"), ["dataset", "pos"])
    scores = None
    for name, layers in (("last", [7]), ("mean", [4, 5, 6, 7]), ("concat", [1, 3, 5, 7])):
        pooled = pooling.pool_layers(hidden, ["dataset", "pos"], name, layers)
        part = rows.join(pooled, ["dataset", "pos"]).select(
            "dataset", F.lit(name).alias("strategy"), "row_id", "y", F.concat("emb", "aux").alias("x"), "modulo", *more)
        scores = part if scores is None else scores.unionByName(part)
    sets = {k: ridge.FEATURE_SETS[k] for k in ("combined", "embedding_only")}
    fixed = ridge.ridge_scores(scores, ["dataset", "strategy"], ["modulo"], sets)
    learned = attention.attention_scores(units, ["dataset"], ["modulo"], B.LAYERS, sets, unit=["pos"])
    out = fixed.unionByName(learned.withColumn("strategy", F.lit("attention")))
    return out.select("dataset", "strategy", "split", "featset", *_r("rho", digits=6), "n")


def _ablation(spark, d):
    """Scores with and without the confidence numbers, one small group per structure."""
    one_thread_per_task(spark)
    n = B.vector_count(spark, d)
    items = B.table(spark, d, "lineitem").select(
        (F.col("l_partkey") % n).alias("dataset"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")]).alias("row_id"),
        (F.col("l_suppkey") % 70 + 1).cast("int").alias("pos"), F.col("l_extendedprice").alias("y"),
        F.array("l_quantity", "l_discount", "l_tax").alias("emb"))
    x = confidence.confidence_features(items, B.confidence(spark, d), B.errors(spark, d)).select(
        "dataset", "row_id", "y", F.concat("emb", "struct").alias("x"), X.modulo_fold(F.col("pos"), 5).alias("modulo"))
    return ridge.ridge_scores(x, ["dataset"], ["modulo"], {"seq": (0, 3), "seq_struct": (0, None), "struct": (3, None)})


def structure_ablation(spark, d):
    return _ablation(spark, d).groupBy("featset").agg(
        F.round(F.avg("rho"), 6).alias("rho"), F.count("rho").alias("n_datasets"))


def structure_deltas(spark, d):
    """What the confidence numbers add, structure by structure: mean difference, effect, interval and signed-rank p."""
    pairs = paired.paired_conditions(materialise(_ablation(spark, d)), ["dataset", "split"], "featset", "seq_struct", "seq")
    out = paired.t_interval(paired.delta_summary(pairs, ["split"]), 0.95).join(paired.wilcoxon(pairs, ["split"]).select("split", "p"), "split")
    return out.select("split", "n", *_r("mean", "dz", "t_lo", "t_hi", "p", digits=6))


def _documents(spark, d):
    """Labelled documents as rows, a dataset per language: counts of their text against the label."""
    text = F.col("text")
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id")
    counts = [F.length(text), F.size(F.split(text, r"\s+")), F.length(F.regexp_replace(text, "[^0-9]", "")),
              F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, r"[^\n]", "")),
              F.length(F.regexp_replace(text, "[aeiou]", ""))]
    return docs.select(
        F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("row_id"),
        (F.col("quality") * 2 + F.col("toxic") + F.length(text) / 1e6).alias("y"),
        F.array(*[c.cast("double") for c in counts]).alias("x"),
        X.random_fold(F.col("doc_id").cast("string"), 5).alias("fold"))


def _trees(kind):
    def run(spark, d):
        preds = trees.tree_oof(_documents(spark, d), ["dataset"], "fold", kind)
        return ridge.pooled_score(preds, ["dataset"]).select("dataset", *_r("rho", digits=6), "n")
    return run


def _supplied(spark, d):
    """Line items as rows, a dataset per supplier: four numbers against the price, the orders dealt into five folds."""
    items = B.table(spark, d, "lineitem")
    return items.select(
        F.col("l_suppkey").cast("string").alias("dataset"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("row_id"),
        F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")]).alias("x"))


def tree_groups(spark, d):
    """Boosted trees of every supplier, five folds each: one job."""
    preds = trees.tree_oof(_supplied(spark, d), ["dataset"], "fold", trees.Shape(20, 4, 5.0, 0.1))
    return ridge.pooled_score(preds, ["dataset"]).select("dataset", *_r("rho", digits=6), "n")


def tree_levels(spark, d):
    """The trees of three levels of every supplier and fold, grown level by level."""
    nodes = trees.tree_nodes(_supplied(spark, d), ["dataset"], "fold", trees.Shape(1, 3, 20.0, 1.0))
    return nodes.select("dataset", "fold", "node", "feature", *_r("cut_value", "mean", digits=5))


def stump_splits(spark, d):
    """First split of every supplier and fold, and the means of its sides."""
    nodes = trees.tree_nodes(_supplied(spark, d), ["dataset"], "fold", trees.Shape(1, 1, 1.0, 1.0))
    at = lambda k, c: F.max(F.when(F.col("node") == k, F.col(c)))
    return nodes.groupBy("dataset", "fold").agg(
        at(0, "feature").alias("feature"), F.round(at(0, "cut_value"), 6).alias("cut_value"), 
        F.round(at(1, "mean") + OFF_TIES, 4).alias("low"), F.round(at(2, "mean") + OFF_TIES, 4).alias("high"))


def profile_baseline(spark, d):
    """Boosted trees on profile features, all splits: every labelled document is one substitution of its language."""
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id")
    pos = (F.col("doc_id") % 60 + 1).cast("int")
    letter = F.lit(AMINO_ACIDS).substr((F.col("n_chars") % 20 + 1).cast("int"), F.lit(1))
    rows = docs.select(
        F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("variant_id"), F.col("doc_id").cast("string").alias("row_id"), pos.alias("pos"),
        B.letter_at(pos).alias("from_aa"), letter.alias("to_aa"), F.lit(60).alias("seq_len"),
        (F.col("quality") * 2 + F.col("n_chars") / 1e5).alias("y"))
    x = profile_features(X.with_schemes(rows, SCHEMES), position_profile(B.alignments(spark, d), B.alignment_refs(spark, d)), B.scores(rows))
    preds = trees.tree_oof(materialise(x), ["dataset", "split"], "fold", "boosted")
    return ridge.pooled_score(preds, ["dataset", "split"]).select("dataset", "split", *_r("rho", digits=6), "n")


QUERIES = {
    "profile_baseline": profile_baseline,
    "fold_standardise": fold_standardise,
    "global_standardise": global_standardise,
    "ridge_oof_spearman": ridge_oof_spearman,
    "ridge_penalties": ridge_penalties,
    "ridge_fixed_penalty": ridge_fixed_penalty,
    "probe_grid": probe_grid,
    "position_control": position_control,
    "attention_pool": attention_pool,
    "pooling_grid": pooling_grid,
    "structure_ablation": structure_ablation,
    "structure_deltas": structure_deltas,
    "rf_oof": _trees("forest"),
    "gbt_oof": _trees("boosted"),
    "tree_groups": tree_groups,
    "tree_levels": tree_levels,
    "stump_splits": stump_splits,
}

_LONG = LABELLED + """,
x as (select dataset, pos, layer, cast((pos - 1) % 5 as int) fold, cast(unnest(range(0, 8)) as int) dim, unnest(vec) v from lv)"""

_ITEMS = """
it as (select cast(l_suppkey as varchar) dataset, cast(l_orderkey % 5 as int) fold, cast(l_extendedprice as double) y,
       [cast(l_quantity as double), cast(l_discount as double), cast(l_tax as double), cast(l_linenumber as double)] x from lineitem),
cell as (select i.*, f.fold held from it i join (select distinct dataset, fold from it) f on i.dataset = f.dataset and i.fold <> f.fold),
long as (select dataset, held, y, unnest([0, 1, 2, 3]) feature, unnest(x) v from cell),
at_value as (select dataset, held, feature, v, count(*) n, sum(y) s from long group by all),
up_to as (select dataset, held, feature, v, sum(n) over low ln, sum(s) over low ls, sum(n) over whole wn, sum(s) over whole ws
          from at_value window low as (partition by dataset, held, feature order by v rows unbounded preceding), whole as (partition by dataset, held, feature)),
gains as (select *, (ls - ws * ln / wn) * (ls - ws * ln / wn) * (1.0 / ln + 1.0 / (wn - ln)) gain from up_to where ln < wn),
best as (select dataset, held, max(gain) g from gains group by 1, 2),
cut as (select a.*, row_number() over (partition by a.dataset, a.held order by feature, v) k
        from gains a join best b on a.dataset = b.dataset and a.held = b.held and gain >= g * (1 - 1e-9))"""

SQL = {
    "stump_splits": sql(_ITEMS, """
select dataset, cast(held as int) fold, cast(feature as int) feature, round(v, 6) cut_value, 
       round(ls / ln + 0.000037, 4) low, round((ws - ls) / (wn - ln) + 0.000037, 4) high
from cut where k = 1"""),
    "fold_standardise": sql(_LONG, """
select x.dataset, x.layer, cast(f.fold as int) fold, count(*) n_train, dim, round(avg(v), 9) mean,
       round(case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end, 6) sd
from x join (select distinct dataset, layer, fold from x) f on f.dataset = x.dataset and f.layer = x.layer and x.fold <> f.fold
group by x.dataset, x.layer, f.fold, dim"""),
    "global_standardise": sql(_LONG, """
, m as (select dataset, layer, dim, avg(v) m, stddev_pop(v) s from x group by 1, 2, 3)
select dataset, pos, layer, dim, round((v - m) / case when s = 0 then 1 else s end, 5) v from x join m using (dataset, layer, dim)"""),
}
