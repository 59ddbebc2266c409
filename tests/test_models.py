import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from pulsegrid import constants as K
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import models as M


def newton(x, y, w, lam, scale=False):
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    pen = np.r_[0.0, np.full(x.shape[1], lam)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) + pen * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen)
        s = np.linalg.solve(h, g)
        b -= s
        if np.abs(s).max() < 1e-10:
            break
    return b


def balanced(y):
    n = len(y)
    return np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = []
    for o in range(5):
        for _ in range(30):
            y = int(rng.random() < 0.4)
            rows.append((f"S{o}", y, float(rng.normal(y * 1.2 + 0.1 * o)), float(rng.normal(-0.6 * y))))
    return rows


def brute_loo(rows, grid):
    o = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows], float)
    x = np.array([r[2:] for r in rows])
    out = {}
    for k in sorted(set(o)):
        tr = o != k
        losses = []
        for c in grid:
            p = np.zeros(tr.sum())
            oo, yy, xx = o[tr], y[tr], x[tr]
            for i in sorted(set(oo)):
                b = newton(xx[oo != i], yy[oo != i], balanced(yy[oo != i]), 1 / c)
                p[oo == i] = 1 / (1 + np.exp(-(b[0] + xx[oo == i] @ b[1:])))
            p = np.clip(p, 1e-6, 1 - 1e-6)
            losses.append((-np.log(p[yy == 1])).mean() / 2 + (-np.log(1 - p[yy == 0])).mean() / 2)
        c = grid[int(np.argmin(losses))]
        out[k] = (c, newton(x[tr], y[tr], balanced(y[tr]), 1 / c))
    return out


def test_nested_loo_matches_brute_force(spark, data):
    grid = [0.01, 0.1, 1.0]
    d = spark.createDataFrame(data, "subject string, y int, a double, b double").repartition(3)
    r = M.loo_cv(d, "subject", "y", ["a", "b"], grid=grid)
    want = brute_loo(data, grid)
    for i, k in enumerate(r.names):
        assert r.c[i] == want[k][0]
        assert r.beta[i] == pytest.approx(want[k][1], abs=1e-6)
    scored = M.held_out_scores(d, "subject", r, "p").filter("subject = 'S2'").first()
    b = want["S2"][1]
    assert scored["p"] == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1] * scored["a"] + b[2] * scored["b"]))), abs=1e-6)


def test_stacked_fusion_matches_brute_force(spark, data):
    d = spark.createDataFrame(data, "subject string, y int, a double, b double").repartition(3)
    rs = {"one": M.loo_cv(d, "subject", "y", ["a"], grid=[0.1, 1.0]), "two": M.loo_cv(d, "subject", "y", ["b"], grid=[0.1, 1.0])}
    got = {(r["subject"], r["a"]): r["stacked_p"] for r in M.stacked_scores(d, "subject", "y", rs).collect()}
    o = np.array([r[0] for r in data])
    y = np.array([r[1] for r in data], float)
    k = "S1"
    tr = o != k
    q = np.full((len(data), 2), 0.5)
    for s, (r, col) in enumerate(((rs["one"], 2), (rs["two"], 3))):
        kk = r.names.index(k)
        for n, row in enumerate(data):
            b = r.beta[kk] if row[0] == k else r.inner_beta[(kk, r.names.index(row[0]))]
            q[n, s] = 1 / (1 + math.exp(-(b[0] + b[1] * row[col])))
    b = newton(q[tr], y[tr], balanced(y[tr]), 1.0)
    for n, row in enumerate(data):
        if row[0] == k:
            assert got[(k, row[2])] == pytest.approx(1 / (1 + math.exp(-(b[0] + q[n] @ b[1:]))), abs=1e-6)


def test_population_fit_matches_newton(spark, data):
    d = spark.createDataFrame(data, "subject string, y int, a double, b double")
    m = M.fit_population(d, "y", ["a", "b"], c=0.5)
    y = np.array([r[1] for r in data], float)
    b = newton(np.array([r[2:] for r in data]), y, balanced(y), 2.0)
    assert [m.intercept, *m.coefficients] == pytest.approx(list(b), abs=1e-4)


def labelled(spark, users, shift, sessions=4, runs=4, seed=0):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        for s in range(sessions):
            for n in range(runs):
                y = n % 2
                rows.append((u, f"s{s}", "stroop", y, {"rtIncongruentMs": 700 + rng.gauss(0, 20) + y * shift * 20,
                                                       "interferenceMs": 100 + rng.gauss(0, 10) + y * shift * 10, "errorRate": abs(rng.gauss(0.05, 0.02))}))
    return spark.createDataFrame(rows, "user_id long, session string, activity string, y int, metrics map<string, double>")


def test_personal_model_is_ready_on_a_clear_shift(spark):
    m = as_dicts(M.train_personal(labelled(spark, 1, 3.0)))[0]
    assert m["ready"] and m["balanced_accuracy"] >= 0.9 and m["n_held_out"] == 16
    assert m["features"] == K.PERSONAL_FEATURES["stroop"]


def test_personal_models_find_nothing_in_noise(spark):
    ba = [m["balanced_accuracy"] for m in as_dicts(M.train_personal(labelled(spark, 40, 0.0)))]
    assert len(ba) == 40 and 0.4 < sum(ba) / 40 < 0.6


def test_large_groups_give_the_same_model(spark):
    runs = labelled(spark, 2, 1.0, seed=4)
    small = as_dicts(M.train_personal(runs), "user_id")
    large = as_dicts(M.train_personal(runs, block_rows=5), "user_id")
    for a, b in zip(small, large):
        assert a["balanced_accuracy"] == b["balanced_accuracy"] and a["n_held_out"] == b["n_held_out"]
        assert a["coef"] == pytest.approx(b["coef"], abs=1e-6) and a["intercept"] == pytest.approx(b["intercept"], abs=1e-5)


def test_personal_gradient_is_zero(spark):
    """At the coefficients the penalised gradient over the person's own scaled rows vanishes; in one block and in many."""
    runs = labelled(spark, 3, 0.7, sessions=5, seed=9)
    names = K.PERSONAL_FEATURES["stroop"]
    for opts in ({}, {"block_rows": 7}):
        for m in as_dicts(M.train_personal(runs, l2=2.0, **opts)):
            mine = [r for r in runs.collect() if r["user_id"] == m["user_id"]]
            x, y = np.array([[r["metrics"][f] for f in names] for r in mine]), np.array([r["y"] for r in mine], float)
            p = 1 / (1 + np.exp(-(m["intercept"] + x @ m["coef"])))
            z = (x - x.mean(0)) / x.std(0)
            assert np.abs((p - y).sum()) < 1e-6 and np.abs(z.T @ (p - y) + 2.0 * np.array(m["coef"]) * x.std(0)).max() < 1e-6


def test_personal_models_of_odd_groups(spark):
    rows = [(None, "s", "stroop", n % 2, {"rtIncongruentMs": float(n), "interferenceMs": 1.0, "errorRate": float("nan")}) for n in range(8)]
    rows += [(7, None, "stroop", n % 2, {"rtIncongruentMs": float(n * n), "interferenceMs": float(n)}) for n in range(6)]
    rows += [(8, "s", "unheard-of", 1, {"x": 1.0})]
    runs = spark.createDataFrame(rows, "user_id long, session string, activity string, y int, metrics map<string, double>")
    got = {r["user_id"]: r for r in as_dicts(M.train_personal(runs))}
    assert set(got) == {None, 7} and got[None]["features"] == ["rtIncongruentMs", "interferenceMs"] and got[None]["coef"][1] == 0
    assert all(g["n_held_out"] == 0 and not g["ready"] and g["balanced_accuracy"] == 0 for g in got.values())
    assert as_dicts(M.train_personal(runs.limit(0))) == []


def test_fits_do_not_depend_on_blocks_and_tiles(spark, data, monkeypatch):
    from pulsegrid.operators import newton as N
    d = spark.createDataFrame(data, "subject string, y int, a double, b double").repartition(3)
    grid = [0.1, 1.0]
    one = M.loo_cv_all(d, "subject", "y", {"both": ["a", "b"], "a": ["a"]}, grid=grid)
    whole = N.Blocks
    monkeypatch.setattr(N, "Blocks", lambda rows: whole(rows, 40))
    monkeypatch.setattr(N, "TILE_FITS", 7)
    monkeypatch.setattr(N, "FITS", 3)
    monkeypatch.setattr(N, "ROWS", 11)
    many = M.loo_cv_all(d, "subject", "y", {"both": ["a", "b"], "a": ["a"]}, grid=grid)
    for s in one:
        assert (one[s].c == many[s].c).all() and one[s].beta == pytest.approx(many[s].beta, abs=1e-7)
        assert one[s].inner_beta.keys() == many[s].inner_beta.keys()
        assert all(one[s].inner_beta[k] == pytest.approx(many[s].inner_beta[k], abs=1e-7) for k in one[s].inner_beta)
    a, b = ({(r["subject"], r["a"]): r["stacked_p"] for r in M.stacked_scores(d, "subject", "y", many).collect()} for _ in range(2))
    assert a == pytest.approx(b, abs=1e-9)


def test_personal_model_needs_both_classes_and_features(spark):
    runs = labelled(spark, 1, 1.0)
    assert as_dicts(M.train_personal(runs.filter("y = 0"))) == []
    few = runs.withColumn("metrics", F.map_filter("metrics", lambda k, v: k != "errorRate"))
    m = M.train_personal(few)
    assert as_dicts(m)[0]["features"] == ["rtIncongruentMs", "interferenceMs"]
    scored = M.score_personal(m, runs.withColumn("metrics", F.map_filter("metrics", lambda k, v: k != "interferenceMs")))
    assert scored.filter("score IS NOT NULL").count() == 0


@pytest.mark.parametrize("opts", [{}, {"block_rows": 5, "bounded": False}], ids=["plain", "blocks"])
def test_auc_with_ties(spark, opts):
    rng = random.Random(2)
    rows = [(o, int(rng.random() < 0.4), rng.randint(0, 6) / 6) for o in ("a", "b") for _ in range(60)] + [("c", 1, 0.5)]
    got = {r["o"]: r["roc_auc"] for r in as_dicts(E.auc(spark.createDataFrame(rows, "o string, y int, p double"), ["o"], "y", "p", **opts))}
    for o in ("a", "b"):
        pos = [p for k, y, p in rows if k == o and y]
        neg = [p for k, y, p in rows if k == o and not y]
        assert got[o] == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    assert got["c"] is None


def test_holdout_is_stratified_and_repeatable(spark):
    d = spark.range(4000).selectExpr("id", "id % 4 = 0 AS y")
    a = M.holdout(d, "y", F.col("id"))
    share = {r["y"]: r["s"] for r in a.groupBy("y").agg(F.avg(F.col("is_test").cast("double")).alias("s")).collect()}
    assert all(0.17 < s < 0.23 for s in share.values())
    assert a.exceptAll(M.holdout(d.repartition(7), "y", F.col("id"))).count() == 0
