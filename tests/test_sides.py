"""Where the plan depends on sizes, both plans give the same rows: NULL keys, NaN, ties, constants, one fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions.tdist import t_cdf, t_quantile
from foldwise.operators import folds, ridge, standardise
from foldwise.operators.correlation import spearman
from foldwise.operators.paired import bh_fdr, bootstrap_ci, signed_rank
from foldwise.plans.ordering import exact_quantiles, group_index


def rounded(df):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(map(show, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        k = [None, "hot", "hot", "b", "flat"][i % 5]
        d = 1.0 if k == "flat" else float(np.round(rng.normal(), 1))
        rows.append((k, i, float("nan") if i % 41 == 0 else None if i % 43 == 0 else float("inf") if i % 47 == 0 else d, float(rng.normal()), float(rng.random())))
    return spark.createDataFrame(rows, "k string, dataset int, d double, v double, p double").repartition(5).cache()


@pytest.mark.parametrize("name", ["spearman", "signed_rank", "bh_fdr", "bootstrap_ci", "group_index", "exact_quantiles"])
def test_same_on_both_sides(odd, name):
    run = {
        "spearman": lambda few: spearman(odd, ["k"], "d", "v", slice_rows=few),
        "signed_rank": lambda few: signed_rank(odd, ["k"], "d", slice_rows=few),
        "bh_fdr": lambda few: bh_fdr(odd.select("k", "dataset", F.when(F.isnan("d"), F.col("d")).otherwise(F.col("p")).alias("p")), ["k"], slice_rows=few),
        "bootstrap_ci": lambda few: bootstrap_ci(odd, ["k"], 5, 95, n_boot=40, array_rows=few, blocks=4),
        "group_index": lambda few: group_index(odd, ["k"], "d", ["dataset"], "i", total="n", slice_rows=few).select("k", "dataset", "i", "n"),
        "exact_quantiles": lambda few: exact_quantiles(odd, ["k"], "d", {"m": 0.5, "q": 0.9}, slice_rows=few),
    }[name]
    large = rounded(run(10**6))
    assert rounded(run(30)) == large
    assert any("None" in r for r in large), "the NULL key is a group"


@pytest.mark.parametrize("chunk", [1, 1 << 27])
def test_ridge_with_null_key_and_one_fold(spark, chunk):
    rng = np.random.default_rng(0)
    rows = []
    for g in (None, "a", "one"):
        for i in range(60):
            x = [float(v) for v in rng.normal(size=2)]
            rows.append((g, f"{g}{i}", x[0] + 0.1 * float(rng.normal()), x, 0 if g == "one" else i % 3))
    df = spark.createDataFrame(rows, "g string, row_id string, y double, x array<double>, f int")
    got = {r["g"]: (r["rho"], r["n"]) for r in ridge.ridge_scores(df, ["g"], ["f"], chunk_bytes=chunk).collect()}
    assert got["one"] == (None, 0) and got["a"][0] > 0.9 and got[None][0] > 0.9


@pytest.mark.parametrize("chunk", [1, 1 << 27])
@pytest.mark.parametrize("base,scale", [(2000.0, 0.01), (0.0, 1e-12), (5e6, 1e-3)])
def test_useful_column_is_kept(spark, chunk, base, scale):
    rng = np.random.default_rng(1)
    y = rng.normal(size=90)
    rows = [("g", str(i), float(y[i]), [base + scale * float(y[i]), float(i % 3 == 0), 4.0], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, row_id string, y double, x array<double>, f int")
    [r] = ridge.ridge_scores(df, ["g"], ["f"], chunk_bytes=chunk).collect()
    assert r["rho"] > 0.99


def test_standardise_shifted(spark):
    rng = np.random.default_rng(2)
    x = np.c_[2000 + 0.01 * rng.normal(size=50), 1e-12 * rng.normal(size=50), np.full(50, 0.1), (np.arange(50) % 5 == 0).astype(float)]
    df = spark.createDataFrame([(None if i < 25 else "k", i % 5, [float(v) for v in x[i]]) for i in range(50)], "k string, fold int, x array<double>")
    for r in standardise.training_moments(df, ["k"]).collect():
        rows = [i for i in range(50) if (i < 25) == (r["k"] is None) and i % 5 != r["fold"]]
        want = x[rows].std(axis=0)
        want[2] = 1.0
        if r["fold"] == 0:
            want[3] = 1.0  # the one-hot column is constant in training
        assert np.allclose(r["sd"], want, rtol=1e-6) and np.allclose(r["mean"], x[rows].mean(axis=0), rtol=1e-12)
    z = np.array([r["x"] for r in standardise.standardise_globally(df, ["k"]).collect()])
    assert z.shape == (50, 4) and np.allclose(np.abs(z[:, 2]), 0)


def test_folds_of_small_datasets(spark):
    df = spark.createDataFrame([("s", f"v{i}", i, 9) for i in range(3)] + [(None, f"w{i}", i, 40) for i in range(8)], "dataset string, variant_id string, pos int, seq_len int")
    got = folds.assign_fold(df, "modulo").collect()
    assert {r["fold"] for r in got if r["dataset"] == "s"} == {0, 1, 2} and len(got) == 11


def test_t_for_any_degrees_of_freedom(spark):
    df = spark.createDataFrame([(float(d),) for d in (1, 2, 3, 30, 1_000, 200_000, 10**7)], "df double")
    out = df.select("df", t_quantile(0.95, F.col("df")).alias("q")).withColumn("p", t_cdf(F.col("q"), F.col("df"))).collect()
    assert [round(r["q"], 6) for r in out[:4]] == [6.313752, 2.919986, 2.353363, 1.697261]
    assert all(abs(r["p"] - 0.95) < 1e-12 for r in out) and abs(out[-1]["q"] - 1.6448536) < 1e-6


def test_alignments_do_not_meet_by_dataset(spark):
    """The few facts of a dataset go to its sequences, whatever the session would broadcast by itself."""
    from foldwise.operators.profile import admitted, position_profile

    msa = spark.createDataFrame([("a", "ACD")] * 40 + [("b", "ACDE"), (None, "ACD"), ("c", "AC")] * 6, "dataset string, seq string")
    refs = spark.createDataFrame([("a", 3), ("b", 3), ("c", 9), (None, 3)], "dataset string, seq_len int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        used = admitted(msa, refs)
        assert "SortMergeJoin" not in used._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.dataset, r.n_seqs, r["count"]) for r in used.groupBy("dataset", "n_seqs").count().collect()) == [("a", 40, 40), ("b", 6, 6)]
        assert position_profile(msa, refs).filter("dataset = 'a' and pos = 2 and letter = 'C'").collect()[0]["count"] == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_do_not_meet_by_dataset(spark):
    """Lengths and gates of few datasets go to the variants, whatever the session would broadcast by itself."""
    from foldwise.operators import variants as V

    rows = [("a", str(i), f"A{1 + i % 9}C:D2E", str(i)) for i in range(30)] + [("b", "1", "A1C", "1"), (None, "1", "A1C", "1")]
    v = spark.createDataFrame(rows, "dataset string, variant_id string, mut_info string, fitness string").withColumn("seq", F.lit(None).cast("string"))
    refs = spark.createDataFrame([("a", 5), ("b", 5), (None, 5)], "dataset string, seq_len int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = V.substitution_rows(v, refs, None, None)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == sum(1 + (1 + i % 9 <= 5) for i in range(30)) and out.filter("dataset <> 'a'").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_position_groups_in_linear_time(spark):
    """The same folds as by looking for the lightest one each time, without a growing array per position."""
    from foldwise.operators import folds as X

    rows = [(d, None if p == 7 else p) for d in ("a", None) for p in range(40) for _ in range(1 + p * p % 11)] + [("few", 1), ("few", 1), ("few", 2)]
    groups = X.position_groups(spark.createDataFrame(rows, "dataset string, pos int"), 5)
    assert "aggregate(" not in groups._jdf.queryExecution().optimizedPlan().toString()
    expected = set()
    for d in ("a", None, "few"):
        sizes = {}
        for e, p in rows:
            if e == d:
                sizes[p] = sizes.get(p, 0) + 1
        load = [0] * min(5, len(sizes))
        for p, n in sorted(sizes.items(), key=lambda g: (-g[1], g[0] is None, -(g[0] or 0))):
            f = load.index(min(load))
            load[f] += n
            expected.add((d, p, f))
    assert {tuple(r) for r in groups.select("dataset", "pos", "fold").collect()} == expected


def test_confidence_of_a_residue_before_the_rows(spark):
    """The long arrays stay with the structures; structures and error rows that occur twice give each row as often."""
    from foldwise.operators import confidence as C

    rows = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 9), ("b", "r3", 2), ("c", "r4", 1), (None, "r5", 1), ("a", "r6", None)], "dataset string, row_id string, pos int")
    conf = spark.createDataFrame([("a", [1.0, 2.0, 4.0], 0.5), ("a", [1.0, 2.0, 4.0], 0.7), ("a", [8.0, 9.0], 0.1), ("b", [3.0, 5.0], None), ("c", None, 0.2)],
                                 "dataset string, plddt array<double>, iptm double")
    pae = spark.createDataFrame([("a", 1, [0.0, 1.0, 2.0]), ("a", 2, [1.0, 0.0, 1.0]), ("a", 3, [2.0, 1.0, 6.0]), ("a", 3, [9.0]), ("b", 2, [1.0, 3.0]), ("b", 5, []), ("c", 1, [7.0])],
                                "dataset string, i int, pae_row array<double>")
    out = C.confidence_features(rows, conf, pae)
    got = sorted(((r.row_id, r.struct[0], r.struct[6], r.struct[7], r.struct[11]) for r in out.collect()), key=str)
    assert got == sorted([
        ("r1", 1.0, 1.0, 2.0, 0.5), ("r1", 1.0, 1.0, 2.0, 0.7), ("r1", 8.0, 1.0, 2.0, 0.1),
        *[(k, 4.0, m, x, t) for k in ("r2", "r6") for m, x in ((3.0, 6.0), (9.0, 9.0)) for t in (0.5, 0.7)],
        *[(k, 9.0, 2 / 3, 1.0, 0.1) for k in ("r2", "r6")], ("r3", 5.0, 2.0, 3.0, None), ("r4", None, 7.0, 7.0, 0.2)], key=str)
    stats = C.error_statistics(rows, pae, radius=1)
    near = sorted(((r.row_id, r.pae_mean, r.pae_max, r.pae_min) for r in stats.filter("dataset = 'a'").collect()), key=str)
    assert near == sorted([("r1", 0.5, 1.0, 0.0), *[(k, 3.5, 6.0, 1.0) for k in ("r2", "r6")], *[(k, None, None, None) for k in ("r2", "r6")]], key=str)
    for df in (out, stats):  # above the join with the rows no array of a structure's length is left
        top = df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
        assert "pae_row" not in top and "plddt" not in top and df.columns[:3] == ["dataset", "row_id", "pos"]


def test_csv_lines_do_not_meet_by_dataset(spark):
    from foldwise.sources.variants import csv_variants

    lines = spark.createDataFrame([(d, f"A{i}C", str(i), "MMMM" if i % 2 else "", i) for d in ("a", "b", None) for i in range(1, 9)],
                                  "dataset string, mutant string, DMS_score string, mutated_sequence string, at int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        variants, refs = csv_variants(lines, ["at"])
        assert "SortMergeJoin" not in variants._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.dataset, r.variant_id) for r in variants.filter("dataset is not null").collect()) == [(d, f"A{i}C") for d in "ab" for i in range(1, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("chunk", [1, 1 << 27])
@pytest.mark.parametrize("scaling", ["fold", "global"])
def test_packed_rows_score_as_all_rows(spark, chunk, scaling):
    """Rows that agree in vector and folds as one: predictions, penalties and rank correlations of the rows themselves."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(9, 3))
    rows = []
    for g in (None, "a", "one"):
        for i in range(240):
            v = int(rng.integers(9))
            y = float(np.round(vectors[v, 0] + 0.3 * rng.normal(), 1))
            rows.append((g, f"{g}{i}", y, [float(u) for u in vectors[v]], 0 if g == "one" else i % 3, int(rng.integers(2))))
    df = spark.createDataFrame(rows, "g string, row_id string, y double, x array<double>, f int, h int").repartition(4)
    few = ridge.packed(df, ["g"], ["f", "h"], chunk_bytes=1)
    assert few.count() < 150 and few.agg(F.sum("_n")).first()[0] == 720
    sets = {"all": (0, None), "head": (0, 2)}
    run = lambda x, c: {(r["g"], r["split"], r["featset"]): (r["rho"], r["n"])
                        for r in ridge.ridge_scores(x, ["g"], ["f", "h"], sets, scaling=scaling, chunk_bytes=c).collect()}
    got, want = run(few, chunk), run(df, 1 << 27)
    assert got.keys() == want.keys() and want["one", "f", "all"] == (None, 0)
    for k, (rho, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if rho is None else abs(got[k][0] - rho) < 1e-3), k
    keys = ["g", "split", "featset"]
    alphas = lambda x: rounded(ridge.chosen_penalties(ridge.ridge_oof(x, ["g"], ["f", "h"], sets, scaling=scaling, chunk_bytes=chunk), keys))
    assert alphas(few) == alphas(df)
    assert ridge.packed(df, ["g"], ["f", "h"]).columns == df.columns, "groups that fit a task stay as they are"


def test_variant_vectors_deal_only_positions(spark, monkeypatch):
    """Few vectors are broadcast: one exchange of rows, and the same means as when they are not."""
    from foldwise.operators import pooling

    rows = spark.createDataFrame([("a", "v1", 1), ("a", "v1", 2), ("a", "v1", 2), ("a", None, 3), ("b", "v2", 1), ("a", "v3", 9), (None, "v4", 1)], "dataset string, variant_id string, pos int").repartition(3)
    hidden = spark.createDataFrame([(d, p, l, [float(p + l), 2.0 * p]) for d in "ab" for p in (1, 2, 3) for l in (0, 1)], "dataset string, pos int, layer int, vec array<double>")
    few = pooling.variant_vectors(rows, hidden)
    plan = few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "SortMergeJoin" not in plan and "hashpartitioning(dataset" in plan and plan.count("hashpartitioning(dataset#") <= 3
    monkeypatch.setattr(pooling, "FEW_BYTES", 0)
    want = sorted(map(str, pooling.variant_vectors(rows, hidden).collect()))
    got = few.collect()
    assert sorted(map(str, got)) == want and len(got) == 6
    assert {r.layer: r.vec for r in got if r.variant_id == "v1"} == {0: [1.5, 3.0], 1: [2.5, 3.0]}


def test_variant_means_are_not_aggregated_as_rows(spark, monkeypatch):
    """Where tasks hold the vectors no aggregate or sort meets a vector; many lists, missing places, ragged layers and keys that are null give the same means."""
    from foldwise.operators import pooling

    rng = np.random.default_rng(17)
    rows = spark.createDataFrame([(("a", "b", None)[int(d)], f"v{v}", int(p)) for d, v, p in zip(rng.integers(0, 3, 900), rng.integers(0, 90, 900), rng.integers(-2, 40, 900))],
                                 "dataset string, variant_id string, pos int").repartition(3)
    cells = [(d, p, l, [float(x) for x in rng.normal(size=3)]) for d in ("a", "b", "c") for p in range(1, 35) if p % 7 for l in (4, 2)]
    whole, ragged = (spark.createDataFrame(c, "dataset string, pos int, layer int, vec array<double>") for c in (cells, cells[:-1] + cells[:1]))
    rounded = lambda df: sorted((r.dataset, r.variant_id, r.layer, *[round(x, 9) for x in r.vec]) for r in df.collect())
    monkeypatch.setattr(pooling, "MEAN_ROWS", 7)
    held = {name: pooling.variant_vectors(rows, h) for name, h in (("whole", whole), ("ragged", ragged))}
    plan = held["whole"]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "MapInArrow" in plan and "metrics" not in plan and "Join" not in plan
    got = {name: rounded(df) for name, df in held.items()}
    monkeypatch.setattr(pooling, "FEW_BYTES", 0)
    for name, h in (("whole", whole), ("ragged", ragged)):
        assert got[name] == rounded(pooling.variant_vectors(rows, h)) and len(got[name]) > 100
