import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import correlation
from foldwise.operators.correlation import spearman
from foldwise.plans import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, one value with a third of them."""
    rng = np.random.default_rng(0)
    n = 4000
    k = np.where(rng.random(n) < 0.7, "hot", rng.integers(0, 5, n).astype(str))
    v = np.where(rng.random(n) < 0.33, 1.5, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"k": k, "v": v, "w": np.round(rng.normal(size=n), 1), "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("slice_rows", [50, 10**6])
def test_average_rank(skewed, slice_rows):
    pdf, df = skewed
    got = O.average_rank(df, ["k"], "v", "r", ties="t", slice_rows=slice_rows).toPandas().sort_values("id")
    g = pdf.groupby("k")["v"]
    assert np.allclose(got["r"].to_numpy(), g.rank().to_numpy())
    assert (got["t"].to_numpy() == pdf.groupby(["k", "v"])["v"].transform("size").to_numpy()).all()


@pytest.mark.parametrize("slice_rows", [40, 10**6])
def test_spearman(skewed, slice_rows):
    pdf, df = skewed
    got = {r["k"]: (r["rho"], r["n"]) for r in spearman(df, ["k"], "v", "w", slice_rows=slice_rows).collect()}
    for k, part in pdf.groupby("k"):
        want = np.corrcoef(part["v"].rank(), part["w"].rank())[0, 1]
        assert got[k][1] == len(part) and abs(got[k][0] - want) < 1e-12


def test_spearman_undefined(spark):
    df = spark.createDataFrame([("a", float(i), 1.0) for i in range(12)] + [("b", 1.0, 2.0)] * 3
                               + [("c", float(i), float("nan")) for i in range(12)], "k string, x double, y double")
    got = {r["k"]: (r["rho"], r["n"]) for r in spearman(df, ["k"], "x", "y").collect()}
    assert got == {"a": (None, 12), "b": (None, 3)}


@pytest.mark.parametrize("slice_rows", [60, 10**6])
def test_group_index_and_quantiles(skewed, slice_rows):
    pdf, df = skewed
    df = df.withColumn("u", F.col("id") * 7919 % 4001 + 0.0)
    got = O.group_index(df, ["k"], "u", ["id"], "i", total="n", slice_rows=slice_rows).toPandas()
    for _, part in got.groupby("k"):
        part = part.sort_values("u")
        assert (part["i"].to_numpy() == np.arange(1, len(part) + 1)).all() and (part["n"] == len(part)).all()
    q = O.exact_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}, slice_rows=slice_rows).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert np.allclose(q.loc[k, ["a", "m", "z"]].to_numpy(dtype=float), np.quantile(part["v"], [0.1, 0.5, 1.0]))


def test_top_per_group_and_sorted_index(skewed):
    pdf, df = skewed
    top = O.top_per_group(df, ["k"], ["v", "id"], 20, F.col("id"), salts=8).toPandas()
    for k, part in pdf.groupby("k"):
        want = part.sort_values(["v", "id"]).head(20)["id"]
        assert set(top[top["k"] == k]["id"]) == set(want)
    placed = O.sorted_index(df, ["w", "id"], "i").toPandas().sort_values("i")
    assert (placed["i"].to_numpy() == np.arange(len(pdf))).all()
    assert (placed["id"].to_numpy() == pdf.sort_values(["w", "id"])["id"].to_numpy()).all()


def test_small_groups_are_ranked_where_they_meet(spark, monkeypatch):
    """Many small groups beside one limit of rows: one exchange, no slices; a large group gives the same in slices."""
    rows = [(None if k == 3 else k, float(i * 7 % 5), float(i * i % 11) if k else 2.0) for k in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    monkeypatch.setattr(correlation, "MANY", 4)
    small = spearman(df, ["k"], "x", "y", slice_rows=50)
    plan = small._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    want = {r.k: r for r in small.collect()}
    got = {r.k: r for r in spearman(df, ["k"], "x", "y", slice_rows=16).collect()}
    assert want.keys() == got.keys() == {None, 0, 1, 2} and want[0].rho is None and got[0].rho is None
    for k in (None, 1, 2):
        assert got[k].n == want[k].n == 40 and abs(got[k].rho - want[k].rho) < 1e-12
