import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import attention as A
from foldwise.operators import ridge as R
from foldwise.operators import trees
from foldwise.plans.moments import assemble, gram


def brute(x, y, fold, alphas=R.ALPHAS):
    """Standardise, choose the penalty by refitting without each row, predict the held-out fold."""
    pred, chosen = np.full(len(y), np.nan), {}
    for f in np.unique(fold):
        tr = fold != f
        m, s = x[tr].mean(0), x[tr].std(0)
        s[s == 0] = 1
        z, zt, yt = (x[tr] - m) / s, (x[~tr] - m) / s, y[tr]

        def fit(z, y, a):
            zm, ym = z.mean(0), y.mean()
            return zm, ym, np.linalg.solve((z - zm).T @ (z - zm) + a * np.eye(z.shape[1]), (z - zm).T @ (y - ym))

        losses = []
        for a in alphas:
            e = 0.0
            for i in range(len(z)):
                keep = np.arange(len(z)) != i
                zm, ym, w = fit(z[keep], yt[keep], a)
                e += (yt[i] - ym - (z[i] - zm) @ w) ** 2
            losses.append(e)
        a = alphas[int(np.argmin(losses))]
        zm, ym, w = fit(z, yt, a)
        pred[~tr], chosen[int(f)] = ym + (zt - zm) @ w, a
    return pred, chosen


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n, d = 60, 5
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 1, 0] + [0, 3, 0, 0, 1]
    y = x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n)
    pdf = pd.DataFrame({"k": "a", "row_id": [str(i) for i in range(n)], "y": y, "x": list(x),
                        "s1": (np.arange(n) % 3).astype("int32"), "s2": (np.arange(n) // 20).astype("int32")})
    two = pd.concat([pdf, pdf.assign(k="b", y=-y)])
    return x, y, pdf, spark.createDataFrame(two, "k string, row_id string, y double, x array<double>, s1 int, s2 int").repartition(4)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 800])
def test_ridge_equals_brute_force(data, chunk_bytes):
    """Both the in-task and the spread-out path, against refitting without every single row."""
    x, y, pdf, df = data
    sets = {"all": (0, None), "head": (0, 2), "ends": [(0, 1), (3, 5)]}
    got = R.ridge_oof(df, ["k"], ["s1", "s2"], sets, chunk_bytes=chunk_bytes).toPandas()
    assert len(got) == 2 * 2 * 3 * len(y)
    for split in ("s1", "s2"):
        for name, cols in (("all", [0, 1, 2, 3, 4]), ("head", [0, 1]), ("ends", [0, 3, 4])):
            want, alphas = brute(x[:, cols], y, pdf[split].to_numpy())
            part = got[(got["k"] == "a") & (got["split"] == split) & (got["featset"] == name)]
            part = part.sort_values("row_id", key=lambda c: c.astype(int))
            assert np.allclose(part["pred"].to_numpy(), want, atol=1e-8)
            assert part.groupby("fold")["alpha"].first().to_dict() == alphas


@pytest.mark.parametrize("scaling", ["fold", "global"])
def test_dual_equals_primal(scaling):
    """Fewer rows than columns: constant, repeated and nearly dependent columns included."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 60)) * rng.uniform(0.1, 10, 60)
    x[:, 7], x[:, 8] = 3.0, x[:, 9]
    x -= x.mean(axis=0)
    y, fold = x[:, 0] - x[:, 1] + rng.normal(size=40), np.arange(40) % 4
    z = np.hstack([np.ones((40, 1)), x, y[:, None]])
    grams = {f: z[fold == f].T @ z[fold == f] for f in range(4)}
    models = list(R._fold_models(grams, np.arange(60), scaling))
    for (f, test, loss, pred), model in zip(R._dual(x, y, fold, scaling, R.ALPHAS), models, strict=True):
        want_loss, want = R._apply(model, x, y, fold == model[0], R.ALPHAS)
        assert f == model[0] and np.allclose(pred, want, atol=1e-8) and np.allclose(loss, want_loss, rtol=1e-6)
    assert list(R._dual(x, y, fold * 0, scaling, R.ALPHAS)) == []


def test_dual_in_the_job(spark):
    """Wide groups: in a task by the dual, spread out by the primal; brute force refits without every row."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(24, 30))
    y, fold = x[:, 0] + 0.2 * rng.normal(size=24), np.arange(24) % 3
    df = spark.createDataFrame([("a", str(i), float(y[i]), [float(v) for v in x[i]], int(fold[i])) for i in range(24)], "k string, row_id string, y double, x array<double>, s int")
    want, alphas = brute(x, y, fold)
    for chunk_bytes in (1 << 20, 24 * 30 * 2, 100):
        got = R.ridge_oof(df, ["k"], ["s"], {"all": (0, None)}, chunk_bytes=chunk_bytes).toPandas().sort_values("row_id", key=lambda c: c.astype(int))
        assert np.allclose(got["pred"].to_numpy(), want, atol=1e-8) and got.groupby("fold")["alpha"].first().to_dict() == alphas


def test_scores_agree(data):
    _, _, _, df = data
    a = R.ridge_scores(df, ["k"], ["s1"]).toPandas().sort_values("k")
    b = R.ridge_scores(df, ["k"], ["s1"], chunk_bytes=800).toPandas().sort_values("k")
    assert np.allclose(a["rho"].to_numpy(), b["rho"].to_numpy()) and (a["n"].to_numpy() == b["n"].to_numpy()).all()


def test_single_fold_has_no_score(spark, data):
    _, _, _, df = data
    one = df.withColumn("s1", F.lit(0))
    assert R.ridge_oof(one, ["k"], ["s1"]).count() == 0
    assert [(r["rho"], r["n"]) for r in R.ridge_scores(one, ["k"], ["s1"]).collect()] == [(None, 0)] * 2


def test_gram(data):
    x, _, _, df = data
    parts = gram(df, ["k"], "x", ["s1"]).filter("k = 'a'").toPandas()
    z = np.hstack([np.ones((len(x), 1)), x])
    total = sum(assemble(b) for _, b in parts.groupby("fold"))
    assert np.allclose(total, z.T @ z)


def test_position_control_collapses(spark):
    """Random vectors remember positions: they work when positions are shared and fail when not."""
    rng = np.random.default_rng(4)
    effect = rng.normal(size=41)
    rows = [("d", f"v{i}", f"v{i}:1", int(p), 40, float(effect[p] + 0.1 * rng.normal()), [0.0] * R.AUX_WIDTH)
            for i, p in enumerate(rng.integers(1, 41, 800))]
    df = spark.createDataFrame(rows, "dataset string, variant_id string, row_id string, pos int, seq_len int, fitness double, aux array<double>")
    s = R.position_control(df, ["random", "modulo"], n_draws=2, dim=64).filter("featset = 'embedding_only'").toPandas()
    rho = s.groupby("split")["rho"].mean()
    assert rho["random"] > 0.9 and abs(rho["modulo"]) < 0.5


def test_attention_descends(data):
    """The closed-form gradient lowers the training error of the pooled ridge."""
    rng = np.random.default_rng(5)
    n, layers, dim = 300, 4, 3
    units = rng.normal(size=(n, layers, dim))
    y = units[:, 2, :] @ np.array([1.0, -2.0, 0.5]) + 0.1 * rng.normal(size=n)
    z = np.hstack([np.ones((n, 1)), units.reshape(n, -1), y[:, None]])
    w = A.descend(z.T @ z, layers, 10.0, 120, 0.05)
    xs = (units - units.mean(0)) / units.std(0, ddof=1)
    ys = (y - y.mean()) / y.std(ddof=1)

    def loss(w):
        p = np.einsum("l,nld->nd", w, xs)
        c = np.linalg.solve(p.T @ p + 10.0 * np.eye(dim), p.T @ ys)
        return ((p @ c - ys) ** 2).mean()

    assert abs(w.sum() - 1) < 1e-12 and w.argmax() == 2 and loss(w) < 0.5 * loss(np.full(layers, 0.25))
    # one tiny step equals the sign of the numerical gradient
    step = A.descend(z.T @ z, layers, 10.0, 1, 1e-4)
    for k in range(layers):
        e = np.zeros(layers)
        e[k] = 1e-5
        soft = lambda v: np.exp(v) / np.exp(v).sum()
        slope = loss(soft(e)) - loss(soft(-e))
        assert np.sign(np.log(step[k]) - np.log(step).mean()) == -np.sign(slope) or abs(slope) < 1e-9


def test_alternation_reaches_the_descent(spark):
    """Within a percent of the training error of the joint descent, or better; nulls are a key, one fold gives nothing."""
    rng = np.random.default_rng(7)
    layers, dim, rows, stacks = 5, 3, [], {}
    for k in ("a", None):
        units = rng.normal(size=(240, layers, dim)) + rng.normal(size=(240, 1, dim))
        y = (0.6 * units[:, 2] + 0.4 * units[:, 3]) @ np.array([1.0, -2.0, 0.5]) + 0.5 * rng.normal(size=240)
        stacks[k] = units, y
        rows += [(k, float(t), [float(v) for v in u.ravel()], i % 3) for i, (u, t) in enumerate(zip(units, y))]
    rows += [("one", 1.0, [0.0] * layers * dim, 0), ("one", 2.0, [1.0] * layers * dim, 0)]
    df = spark.createDataFrame(rows, "k string, y double, x array<double>, s int").repartition(4)
    got = {(r["k"], r["fold"]): np.array(r["weights"]) for r in A.alternate(df, ["k"], ["s"], layers, piece_bytes=8 * layers * dim * 50).collect()}
    want = {(r["k"], r["fold"]): np.array(r["weights"]) for r in A.learn_layer_weights(df, ["k"], ["s"], layers).collect()}
    assert got.keys() == want.keys() == {(k, f) for k in stacks for f in range(3)}

    def error(k, fold, w):
        units, y = stacks[k]
        tr = np.arange(240) % 3 != fold
        xs, ys = (units[tr] - units[tr].mean(0)) / units[tr].std(0, ddof=1), (y[tr] - y[tr].mean()) / y[tr].std(ddof=1)
        p = np.einsum("l,nld->nd", w, xs)
        return ((p @ np.linalg.solve(p.T @ p + 10.0 * np.eye(dim), p.T @ ys) - ys) ** 2).mean()

    for (k, f), w in got.items():
        assert abs(w.sum() - 1) < 1e-9 and error(k, f, w) <= 1.01 * error(k, f, want[k, f]), (k, f)
    by_width = A.learn_layer_weights(df, ["k"], ["s"], layers, moment_bytes=100)
    assert {(r["k"], r["fold"]) for r in by_width.collect()} == set(got)


def test_forest_learns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3))
    pdf = pd.DataFrame({"k": "a", "row_id": [str(i) for i in range(200)], "y": np.sign(x[:, 0]), "x": list(x),
                        "fold": (np.arange(200) % 2).astype("int32")})
    df = spark.createDataFrame(pdf, "k string, row_id string, y double, x array<double>, fold int")
    got = trees.tree_oof(df, ["k"], "fold", "forest").toPandas()
    assert len(got) == 200 and np.corrcoef(got["y"], got["pred"])[0, 1] > 0.9


def test_probe_grid_covers_all_splits(spark):
    import __spark_entry__ as entry
    from foldwise.operators.folds import SCHEMES

    got = entry.queries()["probe_grid"](spark, "/root/testdata/sf0.001").select("arm", "split").distinct().collect()
    assert {tuple(r) for r in got} == {(a, s) for a in ("masked_wt", "mutant") for s in SCHEMES}


def _few_vectors(spark, n=1200):
    """Rows that take 18 (unit, aux) pairs, with the layers of their unit behind one another."""
    rng = np.random.default_rng(8)
    pos, kind = rng.integers(1, 7, n), rng.integers(0, 3, n)
    y = 0.4 * pos + kind + rng.normal(size=n).round(1)
    rows = pd.DataFrame({"dataset": "a", "row_id": [str(i) for i in range(n)], "pos": pos.astype("int32"), "fitness": y,
                         "aux": [[float(k), float(k * k)] for k in kind], "modulo": ((pos - 1) % 3).astype("int32")})
    units = pd.DataFrame([("a", p, list(rng.normal(size=8))) for p in range(1, 7)], columns=["dataset", "pos", "x"])
    return (spark.createDataFrame(rows, "dataset string, row_id string, pos int, fitness double, aux array<double>, modulo int"),
            spark.createDataFrame(units, "dataset string, pos int, x array<double>"))


def test_packed_rows_learn_and_score_alike(spark):
    rows, units = _few_vectors(spark)
    packed = R.packed_units(rows, units, ["modulo"], chunk_bytes=1000)
    assert packed.count() == 18
    pair = [r.withColumnRenamed("fitness", "y").join(units, ["dataset", "pos"]) for r in (rows, packed)]
    weights = [{r.fold: r.weights for r in A.learn_layer_weights(f, ["dataset"], ["modulo"], 4).collect()} for f in pair]
    assert weights[0].keys() == weights[1].keys() == {0, 1, 2}
    for f, w in weights[0].items():
        np.testing.assert_allclose(w, weights[1][f], atol=1e-9)
    for chunk_bytes in (1 << 20, 400):
        rho = [[(r.rho, r.n) for r in A.attention_scores(f, ["dataset"], ["modulo"], 4, chunk_bytes=chunk_bytes).collect()] for f in pair]
        assert rho[0][0][1] == rho[1][0][1] == 1200
        assert abs(rho[0][0][0] - rho[1][0][0]) < 1e-6


def test_layers_are_pooled_once_per_unit(spark, monkeypatch):
    """The same scores whether rows or their units are pooled; a unit's layers are mixed once for each held-out fold."""
    rows, units = _few_vectors(spark)
    features = rows.withColumnRenamed("fitness", "y").join(units, ["dataset", "pos"])
    score = lambda **o: sorted((r.dataset, r.split, round(r.rho, 9), r.n) for r in A.attention_scores(features, ["dataset"], ["modulo"], 4, **o).collect())
    each = score()
    made = []

    def noted(df, name, write=A.written):
        made.append((name, write(df, name)))
        return made[-1][1]

    monkeypatch.setattr(A, "written", noted)
    assert score(unit=["pos"]) == each
    assert [df.count() for name, df in made if name == "pooled"] == [6 * 3]


def test_units_that_come_twice_are_not_packed(spark):
    rows, units = _few_vectors(spark, 50)
    assert R.packed_units(rows, units.union(units), ["modulo"], chunk_bytes=1000).count() == 50


def test_position_control_equals_the_ridge_of_whole_vectors(spark):
    """Cells and block elimination against the ridge over rows that carry their vectors; more and fewer dimensions than positions, both ways to deal."""
    from foldwise.functions.hashing import gaussian_matrix, gaussian_vector

    rng = np.random.default_rng(21)
    n, schemes = 400, ["random", "modulo"]
    pos, kind = rng.integers(1, 31, n), rng.integers(0, 4, n)
    kinds = np.pad(rng.normal(size=(4, 3)).round(2), ((0, 0), (0, R.AUX_WIDTH - 3)))
    rows = [("d" if i % 3 else "e", f"v{i // 2}", f"v{i // 2}:{i}", int(pos[i]), 30, float(np.sin(pos[i]) + kind[i] + round(rng.normal(), 1)), [float(v) for v in kinds[kind[i]]])
            for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, variant_id string, row_id string, pos int, seq_len int, fitness double, aux array<double>").cache()
    told = spark.createDataFrame([(7,), (12,)], "p int").select(gaussian_vector(5, 1000, F.lit(2), F.col("p")).alias("v")).collect()
    np.testing.assert_allclose(gaussian_matrix(5, 1000, 2, [7, 12]), [r["v"] for r in told], rtol=1e-12)
    for dim, chunk_bytes in ((8, 1 << 20), (64, 100)):
        spots = df.select("dataset", "pos").distinct().withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
        hidden = spots.select("dataset", F.lit("random_position").alias("arm"), F.col("pos").cast("string").alias("unit_id"), "layer",
                              gaussian_vector(dim, 1000, F.col("layer"), F.col("pos")).alias("vec"))
        want = R.probe_grid(df, hidden, {"random_position": "pos"}, schemes)
        got = R.position_control(df, schemes, n_draws=2, dim=dim, chunk_bytes=chunk_bytes)
        assert got.columns == want.columns
        a, b = ({(r.dataset, r.arm, r.layer, r.split, r.featset): (r.rho, r.n) for r in x.collect()} for x in (want, got))
        assert len(a) == 16 and a.keys() == b.keys()
        for k, (rho, count) in a.items():
            # equal vectors tie exactly here, there only up to rounding
            assert count == b[k][1] and abs(rho - b[k][0]) < (2e-2 if k[4] == "embedding_only" else 1e-3), (k, rho, b[k])


@pytest.mark.parametrize("dim", [6, 40])
def test_cells_predict_like_their_rows(dim):
    """Predictions of all folds against the eigenproblem over whole rows, with flat and repeated columns."""
    from foldwise.operators.position_ridge import pooled_predictions

    rng = np.random.default_rng(22)
    pos, kind, fold = rng.integers(0, 25, 300), rng.integers(0, 5, 300), rng.integers(0, 4, 300)
    vectors, kinds = rng.normal(size=(25, dim)), np.hstack([np.eye(5), np.ones((5, 1)), rng.normal(size=(5, 1))])
    y = 100.0 + np.sin(pos) + kind + rng.normal(size=300)
    x = np.hstack([vectors[pos], kinds[kind]])
    sets = {"combined": (0, None), "embedding_only": (0, dim)}
    want = {name: np.empty(300) for name in sets}
    for name, _, test, loss, pred in R._solved(x - x.mean(axis=0), y, fold, sets, "fold", R.ALPHAS):
        want[name][test] = pred[:, loss.argmin()]
    one, none = np.ones(300), np.zeros(300)
    got, single = pooled_predictions(vectors.copy(), kinds, pos, kind, one, y, none, [fold, fold * 0], R.ALPHAS)
    assert single is None
    for k, name in enumerate(sets):
        np.testing.assert_allclose(got[k] + y.mean(), want[name], atol=1e-6)


def test_position_control_is_registered_whole(spark, monkeypatch):
    from foldwise.plans.catalog import readouts

    asked = {}

    def noted(rows, schemes, n_draws=33, dim=1280, **options):
        asked.update(schemes=list(schemes), n_draws=n_draws, dim=dim)
        return spark.createDataFrame([], "dataset string, split string, featset string, rho double")

    monkeypatch.setattr(readouts.ridge, "position_control", noted)
    readouts.position_control(spark, "/root/testdata/sf0.001")
    assert asked == {"schemes": readouts.SCHEMES, "n_draws": 33, "dim": 1280}
