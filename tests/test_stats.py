import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.functions.signed_rank import erfc, signed_rank_p
from foldwise.functions.tdist import t_cdf, t_quantile
from foldwise.operators import lens
from foldwise.operators import paired as P
from foldwise.operators import similarity as M


def test_t_distribution(spark):
    # textbook values: upper 5 % and 2.5 % points
    table = {1: (6.3138, 12.7062), 2: (2.9200, 4.3027), 5: (2.0150, 2.5706), 10: (1.8125, 2.2281), 62: (1.6698, 1.9990)}
    df = spark.createDataFrame([(k,) for k in table], "df int").select(
        "df", t_quantile(0.95, F.col("df")).alias("a"), t_quantile(0.975, F.col("df")).alias("b"))
    for r in df.select("*", t_cdf(F.col("a"), F.col("df")).alias("p"), t_cdf(-F.col("a"), F.col("df")).alias("m")).collect():
        assert abs(r["a"] - table[r["df"]][0]) < 2e-4 and abs(r["b"] - table[r["df"]][1]) < 2e-4
        assert abs(r["p"] - 0.95) < 1e-12 and abs(r["m"] - 0.05) < 1e-12


def test_tost_and_verdicts(spark):
    rows = [("flat", 0.001)] * 6 + [("far", 0.2)] * 6 + [("wide", v) for v in (-0.3, 0.4, 0.1, -0.2, 0.3)]
    s = P.delta_summary(spark.createDataFrame(rows, "k string, d double"), ["k"])
    got = {r["k"]: r for r in P.t_interval(P.tost(s), 0.9).withColumn(
        "v", P.interval_verdict(F.col("t_lo"), F.col("t_hi"))).collect()}
    assert got["flat"]["tost_p"] < 1e-6 and got["flat"]["v"] == "Equivalent"
    assert got["far"]["tost_p"] > 0.999 and got["far"]["v"] == "Difference"
    assert got["wide"]["v"] == "Inconclusive"


def test_wilcoxon_exact(spark):
    d = [0.3, -0.1, 0.25, 0.7, -0.05, 0.45, 0.9]
    r = P.wilcoxon(spark.createDataFrame([("a", x) for x in d], "k string, d double"), ["k"]).collect()[0]
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(ranks[np.array(d) > 0].sum(), ranks[np.array(d) < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    assert abs(r["p"] - min(1.0, 2 * np.mean(np.array(sums) <= w))) < 1e-12
    assert r["w_plus"] + r["w_minus"] == len(d) * (len(d) + 1) / 2


def test_wilcoxon_zero_and_ties(spark):
    d = [0.0, 0.1, 0.1, -0.1, 0.3, 0.4, -0.2, 0.5, 0.6, 0.7]
    r = P.wilcoxon(spark.createDataFrame([("a", x) for x in d], "k string, d double"), ["k"], min_n=10).collect()[0]
    assert r["n"] == 9 and r["n_zero"] == 1 and r["tie_term"] == 24 and 0 < r["p"] < 0.1


def test_slices_share_all_draws():
    """Counts of all slices of a replicate add up to n and are distributed as a multinomial."""
    sizes = np.array([50, 0, 120, 30, 7, 93, 100, 100])
    n, bits, boots = int(sizes.sum()), 3, 20_000
    found = []
    for k in range(8):
        path = []
        for level in range(bits):
            node = k >> (bits - level)
            low = [j for j in range(8) if j >> (bits - level - 1) == 2 * node]
            path.append({"_level": level, "_node": node, "_low": (k >> (bits - level - 1)) % 2 == 0, "_lower": int(sizes[low].sum()),
                         "_all": int(sum(sizes[j] for j in range(8) if j >> (bits - level) == node))})
        found.append(P.slice_draws(path, n, boots, 42))
    found = np.array(found)
    assert (found.sum(axis=0) == n).all() and not found[1].any()
    p = sizes / n
    assert np.allclose(found.mean(axis=1), sizes, atol=0.2)
    assert np.allclose(np.cov(found), n * (np.diag(p) - np.outer(p, p)), atol=2.5)


def test_bootstrap_over_slices(spark):
    """Many slices: the same whatever the partitioning, the spread of the theory, repeated rows counted, null keys kept."""
    rng = np.random.default_rng(2)
    rows = [("big", f"d{i}", float(x)) for i, x in enumerate(rng.normal(0.1, 1, 3000))] + [(None, "same", 2.0)] * 500 + [(None, f"e{i}", 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, dataset string, d double")
    runs = [P.bootstrap_ci(df.repartition(n), ["k"], 2.5, 97.5, n_boot=1000, array_rows=100, slice_units=200).toPandas().set_index("k").sort_index() for n in (2, 7)]
    assert np.allclose(runs[0].to_numpy(float), runs[1].to_numpy(float), atol=1e-12)
    got = {k if isinstance(k, str) else None: v for k, v in zip(runs[0].index, runs[0].to_numpy(float))}
    for key in ("big", None):
        d = np.array([r[2] for r in rows if r[0] == key])
        half = 1.96 * d.std() / np.sqrt(len(d))
        assert np.allclose(got[key], [d.mean() - half, d.mean() + half], atol=0.12 * half)


def test_bootstrap_paths_agree(spark):
    rng = np.random.default_rng(1)
    rows = [("big", f"d{i}", float(x)) for i, x in enumerate(rng.normal(0.1, 1, 300))] + [
        ("small", f"d{i}", float(x)) for i, x in enumerate(rng.normal(0, 1, 40))]
    df = spark.createDataFrame(rows, "k string, dataset string, d double").repartition(5)
    a = P.bootstrap_ci(df, ["k"], 5, 95, n_boot=400).toPandas().set_index("k").sort_index()
    b = P.bootstrap_ci(df, ["k"], 5, 95, n_boot=400, array_rows=100).toPandas().set_index("k").sort_index()
    assert np.allclose(a.to_numpy(), b.to_numpy(), atol=1e-12)
    d = np.array([r[2] for r in rows if r[0] == "big"])
    half = 1.645 * d.std(ddof=1) / np.sqrt(len(d))
    assert np.allclose(a.loc["big"].to_numpy(dtype=float), [d.mean() - half, d.mean() + half], atol=0.3 * half)


@pytest.mark.parametrize("slice_rows", [37, 10**6])
def test_bh(spark, slice_rows):
    rng = np.random.default_rng(2)
    p = np.round(np.concatenate([rng.random(300), rng.random(60) * 0.003]), 4)
    df = spark.createDataFrame(pd.DataFrame({"f": "x", "id": np.arange(len(p)), "p": p}))
    got = P.bh_fdr(df, ["f"], slice_rows=slice_rows).toPandas().sort_values("id")
    order = np.argsort(p, kind="stable")
    ranked = p[order] * len(p) / np.arange(1, len(p) + 1)
    adj = np.empty(len(p))
    adj[order] = np.minimum(np.minimum.accumulate(ranked[::-1])[::-1], 1)
    assert np.allclose(got["p_adj"].to_numpy(), adj)
    assert (got["significant"].to_numpy() == (adj <= 0.05)).all()


def test_best_vs_final_degenerate(spark):
    rows = [("m", f"d{i}", lay, 0.1 * lay + 0.01 * i) for i in range(6) for lay in range(3)]
    df = spark.createDataFrame(rows, "model string, dataset string, layer int, rho double")
    t = P.equivalence_table(df, ["model"], 2, n_boot=50).collect()[0]
    assert t["degenerate"] and t["verdict"] is None and t["mean"] == 0


@pytest.mark.parametrize("corrected", [False, True])
@pytest.mark.parametrize("block,strip_bytes", [(3, 1), (2, 8 * 21 * 6), (256, 1 << 20)])
def test_cka_by_blocks(spark, corrected, block, strip_bytes):
    """One strip or many, blocks that don't divide the width: the same as from the whole Gram matrix."""
    rng = np.random.default_rng(9)
    rows = [(k, p, l, [float(v) for v in rng.normal(2, 1, 7) + (p % 3)]) for k, n, layers in (("a", 40, (0, 1, 2)), ("b", 25, (3, 5)), (None, 10, (0,)))
            for p in range(n) for l in layers]
    df = spark.createDataFrame(rows, "dataset string, pos int, layer int, vec array<double>").repartition(4)
    rows_of = lambda c: {(r["dataset"], r["i"], r["j"]): (r["n"], r["sim"]) for r in c.collect()}
    want = rows_of(M.cka_matrix(df, corrected))
    got = rows_of(M.cka_blocks(df, corrected, block=block, strip_bytes=strip_bytes, ranges=3))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], rtol=1e-9) for k in want)
    assert rows_of(M.cka_matrix(df, corrected, moment_bytes=10)).keys() == want.keys()


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 2.0, 2.4999, 2.5, 3.0, 5.0, 9.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("e")).collect()
    assert all(math.isclose(r["e"], math.erfc(r["x"]), rel_tol=1e-10) for r in got)


def test_signed_rank_p_by_enumeration(spark):
    rows = [(n, float(w)) for n in (1, 2, 7, 10) for w in range(n * (n + 1) // 4 + 1)]
    got = spark.createDataFrame(rows, "n long, w double").select("n", "w", signed_rank_p(F.col("n"), F.col("w"), F.lit(0.0), F.lit(True)).alias("p")).collect()
    for r in got:
        sums = [sum(k for k, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=r["n"])]
        assert math.isclose(r["p"], min(1.0, 2 * sum(s <= r["w"] for s in sums) / 2 ** r["n"]))
    edge = spark.createDataFrame([(0, 0.0, 1.0), (None, None, None), (60, 10.0, None), (60, 10.0, float("nan")), (60, 10.0, -1.96)], "n long, w double, z double")
    p = [r[0] for r in edge.select(signed_rank_p(F.col("n"), F.col("w"), F.col("z"), F.lit(False))).collect()]
    assert p[:4] == [None] * 4 and math.isclose(p[4], math.erfc(1.96 / math.sqrt(2)))


@pytest.mark.parametrize("direct", [False, True])
def test_packed_lens_equals_token_rows(spark, direct):
    """Letters without a token, special tokens, rows with unknown letters, spots without logits."""
    rng = np.random.default_rng(10)
    words = ["A", "C", "A", None, "D", "Y", None, "C"]
    packed = [("d", p, l, [float(v) for v in rng.normal(0, 30, len(words))]) for p in range(1, 6) for l in range(2)]
    long = [(d, p, l, t, w, v[t]) for d, p, l, v in packed for t, w in enumerate(words)]
    rows = spark.createDataFrame([("r1", "d", 1, "A", "C"), ("r2", "d", 2, "Y", "A"), ("r3", "d", 3, "E", "A"), ("r4", "d", 4, "A", "E"), ("r5", "d", 9, "A", "C"),
                                  ("r6", "d", 5, "X", "A"), ("r7", "d", 5, None, "A"), ("r8", "d", 5, "", "A"), ("r9", "d", 5, "AC", "A")],
                                 "row_id string, dataset string, pos int, from_aa string, to_aa string")
    a = lens.packed_log_ratio(rows, lens.letter_arrays(spark.createDataFrame(packed + [("d", 7, 0, None)], "dataset string, pos int, layer int, logits array<double>"), words, direct))
    b = lens.log_ratio(rows, lens.letter_log_probs(spark.createDataFrame(long, "dataset string, pos int, layer int, token_id int, letter string, logit double"), direct))
    a, b = ({(r["row_id"], r["layer"]): r["score"] for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() == {(r, l) for r in ("r1", "r2") for l in range(2)} and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_sliced_bootstrap_joins_no_units_by_comparison(spark):
    """Facts of a few comparisons are broadcast: no sort-merge join brings all units of a comparison into one task."""
    from unittest import mock

    df = spark.createDataFrame([(f"k{i % 3}", f"d{i}", float(i % 17)) for i in range(3000)], "k string, dataset string, d double")
    kept, cut = [], P.materialise

    def seen(table):
        kept.append(table._jdf.queryExecution().optimizedPlan().toString() + table._jdf.queryExecution().executedPlan().toString())
        return cut(table)

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with mock.patch.object(P, "materialise", seen):
            out = P.bootstrap_ci(df, ["k"], 2.5, 97.5, n_boot=50, array_rows=0, slice_units=200).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(out) == 3 and len(kept) == 2
    assert "SortMergeJoin" not in kept[1] and kept[1].count("BroadcastHashJoin") >= 2
