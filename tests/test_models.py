"""Operators without SQL, against plain numpy versions on small tables."""

import json
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from longpanel.functions.stats import lcg_array
from longpanel.operators import balance, models, quality, redraw, resample, stress, verdicts
from longpanel.plans.queries import ORACLES, QUERIES


def newton(x, y, c, w, steps=50):
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1 / c] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
    return b


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, -0.5] + rng.normal(size=60)
    return [(f"p{i}", float(x[i, 0]), float(x[i, 1]), float(y[i]), i % 3 + 1) for i in range(60)]


@pytest.fixture(scope="module")
def table(spark, people):
    return spark.createDataFrame(people, "id string, a double, b double, y double, fold int")


def plain_ridge(x, y, alpha):
    """Ridge on columns centred and scaled by these rows: intercept and raw coefficients."""
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = (x - mean) / sd
    c = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - mean @ c, c


def plain_nested(people, alphas, inner, labels=None):
    """Nested ridge row by row: penalties, coefficients, out-of-fold correlation and error against the mean's.  inner: (id, test fold) -> fold."""
    x = np.array([[p[1], p[2]] for p in people])
    y = np.array([p[3] for p in people] if labels is None else labels)
    fold = np.array([p[4] for p in people])
    prediction, mean, fits = np.zeros(len(y)), np.zeros(len(y)), []
    for f in (1, 2, 3):
        own, losses = np.array([inner[p[0], f] for p in people]), []
        for a in alphas:
            e = []
            for g in (1, 2, 3):
                b, c = plain_ridge(x[(own > 0) & (own != g)], y[(own > 0) & (own != g)], a)
                e.append((y[own == g] - b - x[own == g] @ c) ** 2)
            losses.append(np.sqrt(np.concatenate(e).mean()))
        best = max(a for a, v in zip(alphas, losses, strict=True) if np.isclose(v, min(losses), rtol=1e-12))
        b, c = plain_ridge(x[fold != f], y[fold != f], best)
        fits.append((best, [b, *c]))
        prediction[fold == f] = b + x[fold == f] @ c
        mean[fold == f] = y[fold != f].mean()
    return fits, np.corrcoef(prediction, y)[0, 1], 100 * (np.sqrt(((y - prediction) ** 2).sum() / ((y - mean) ** 2).sum()) - 1)


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-4, 3e5)])
def test_nested_ridge_and_label_permutation(spark, people, scale, shift):
    """Equal to numpy, also for columns far from 0 with little spread: results do not depend on units."""
    alphas = [0.01, 0.1, 1.0, 10.0, 100.0]
    people = [(i, a * scale + shift, b, y, f) for i, a, b, y, f in people]
    table = spark.createDataFrame(people, "id string, a double, b double, y double, fold int")
    dealt = resample.inner_folds(table, "id", 3).collect()
    inner = {(r["id"], r["test_fold"]): r["inner"] for r in dealt}
    for f in (1, 2, 3):
        sizes = [sum(r["test_fold"] == f and r["inner"] == i for r in dealt) for i in range(4)]
        assert sizes[0] == sum(p[4] == f for p in people) and max(sizes[1:]) - min(sizes[1:]) <= 1
        assert all((inner[p[0], f] == 0) == (p[4] == f) for p in people)
    fits, r, percent = plain_nested(people, alphas, inner)
    found = models.nested_ridge(table, "id", ["a", "b"], "y", alphas, 3).orderBy("test_fold").collect()
    assert [row["alpha"] for row in found] == [f[0] for f in fits]
    for row, (_, c) in zip(found, fits, strict=True):
        assert row["coefficients"] == pytest.approx(c, rel=1e-9 if scale == 1 else 1e-5)
    null = {row["draw"]: row for row in models.label_permutation(table, "id", ["a", "b"], "y", alphas, 3, 40).collect()}
    assert sorted(null) == list(range(-1, 40))
    assert (null[-1]["r"], null[-1]["rmse_percent"]) == pytest.approx((r, percent), rel=1e-9 if scale == 1 else 1e-6)
    # permuted labels predict nothing, and draws differ
    assert np.mean([null[i]["r"] for i in range(40)]) < 0.2 < r
    assert len({round(null[i]["r"], 9) for i in range(40)}) > 30


def test_column_without_spread_has_no_coefficient():
    x = np.c_[np.ones(20), np.arange(20.0), np.full(20, 7.0)]
    y = 3 + 2 * x[:, 1]
    assert models.standardised_ridge(x.T @ x, x.T @ y, 1e-9) == pytest.approx([3, 2, 0], abs=1e-6)


def test_folds_are_balanced_shuffled_and_of_any_id(spark):
    ids = [f"person {i}" for i in range(503)]
    one = {r["who"]: r["fold"] for r in resample.folds(spark.createDataFrame([(i,) for i in ids * 2 + [None]], "who string"), "who").collect()}
    two = {r["who"]: r["fold"] for r in resample.folds(spark.createDataFrame([(i,) for i in ids[::-1]], "who string"), "who").collect()}
    assert one == two and sorted(one) == sorted(ids)
    sizes = np.bincount(list(one.values()))[1:]
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    assert [one[i] for i in ids] != [i % 5 + 1 for i in range(503)]


@pytest.mark.parametrize("loads, size, groups", [([0, 0, 0], 4, 7), ([9, 2, 2], 3, 5), ([100, 0, 1], 1, 1000), ([5, 5, 4], 10, 1), ([0, 0], 1, 0)])
def test_greedy_shares_are_those_of_one_group_at_a_time(loads, size, groups):
    held, wanted = list(loads), [0] * len(loads)
    for _ in range(groups):
        f = held.index(min(held))
        held[f] += size
        wanted[f] += 1
    assert resample.greedy_shares(loads, size, groups) == wanted


def test_group_folds_balance_rows(spark):
    rng = np.random.default_rng(8)
    sizes = [900, 400, 300, *rng.integers(1, 12, 300).tolist()]
    df = spark.createDataFrame([(f"g{i}",) for i, s in enumerate(sizes) for _ in range(s)], "g string")
    found = {r["g"]: r["fold"] for r in resample.group_folds(df, "g").collect()}
    assert len(found) == len(sizes)
    loads = [0] * 5
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    assert [sum(sizes[int(g[1:])] for g, f in found.items() if f == k) for k in range(1, 6)] == loads
    rows = df.withColumn("i", F.monotonically_increasing_id())
    shares = [r["count"] for r in rows.groupBy(resample.row_folds(rows, ["g", "i"]).alias("f")).count().collect()]
    assert len(shares) == 5 and max(shares) < 1.25 * min(shares)


def test_crossfit_logistic(spark, people):
    rng = np.random.default_rng(2)
    rows = [(i, p[1], p[2], float(p[3] > 0), p[4], float(rng.uniform(0.5, 2))) for i, p in enumerate(people)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double, fold int, w double")
    cs = (0.01, 1.0)
    x, y, fold, w = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    wanted = np.zeros(60)
    for f in (1, 2, 3):
        loss = []
        for c in cs:
            total = weight = 0.0
            for g in {1, 2, 3} - {f}:
                m, t = (fold != f) & (fold != g), fold == g
                b = newton(x[m], y[m], c, w[m])
                p = 1 / (1 + np.exp(-np.c_[np.ones(t.sum()), x[t]] @ b))
                total += (w[t] * -(y[t] * np.log(p) + (1 - y[t]) * np.log(1 - p))).sum()
                weight += w[t].sum()
            loss.append((round(total / weight, 12), c))
        b = newton(x[fold != f], y[fold != f], min(loss)[1], w[fold != f])
        wanted[fold == f] = 1 / (1 + np.exp(-np.c_[np.ones((fold == f).sum()), x[fold == f]] @ b))
    got = models.crossfit_logistic(df, ["a", "b"], "y", 3, cs, "w")
    assert [r["probability"] for r in got.orderBy("id").collect()] == pytest.approx(wanted.tolist(), abs=1e-6)
    # calibration, ranking and precision of known scores
    b = newton(np.log(wanted / (1 - wanted))[:, None], y, 1e6, np.ones(60))
    assert models.calibration(got, "probability", "y") == pytest.approx(b, abs=1e-4)
    pairs = [(1.0 if p > q else 0.5 if p == q else 0.0) for p, s in zip(wanted, y, strict=True) if s for q, t in zip(wanted, y, strict=True) if not t]
    assert models.auc(got, "probability", "y").first()["auc"] == pytest.approx(np.mean(pairs))
    order = np.argsort(-wanted)
    precision = np.cumsum(y[order]) / np.arange(1, 61)
    assert models.pr_auc(got, "probability", "y").first()["pr_auc"] == pytest.approx((precision * y[order]).sum() / y.sum())


def test_logistic_sums_of_all_fits_in_one_pass(spark, monkeypatch):
    """Sums of many fits against numpy, over several batches, with a null, a fold that no fit leaves out and a fit without rows."""
    monkeypatch.setattr(models, "FIT_ROWS", 7)
    rng = np.random.default_rng(4)
    x, y, fold, w = rng.normal(size=(200, 2)), rng.integers(0, 2, 200).astype(float), rng.integers(1, 5, 200), rng.uniform(0.5, 2, 200)
    rows = [(*map(float, x[i]), float(y[i]), int(fold[i]), float(w[i])) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1, 1.0)], "a double, b double, y double, fold int, w double")
    fits, b = [(f, g) for f in (1, 2, 3) for g in (0, 1, 2, 3) if f != g], rng.normal(size=(9, 3))
    got = {r["fit"]: r for r in models.fold_sums(df, ["a", "b"], "y", fits, b, "w").collect()}
    assert sorted(got) == list(range(9))
    full = np.c_[np.ones(200), x]
    for i, (f, g) in enumerate(fits):
        m = (fold != f) & (fold != g)
        q = 1 / (1 + np.exp(-full[m] @ b[i]))
        assert got[i]["hessian"] == pytest.approx(((full[m].T * (w[m] * q * (1 - q))) @ full[m])[np.triu_indices(3)].tolist(), rel=1e-9)
        assert got[i]["gradient"] == pytest.approx((full[m].T @ (w[m] * (y[m] - q))).tolist(), rel=1e-9, abs=1e-9)
    assert all(v == 0 for r in models.fold_sums(df.where("fold = 1"), ["a", "b"], "y", [(1, 0)], b[:1]).collect() for v in r["hessian"])
    plan = models.fold_sums(df, ["a", "b"], "y", fits, b, "w")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Generate" not in plan


def test_benchmark(spark, people):
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 7 == 0 else p[1], rng.choice(["u", "v"]) if i % 3 else "rare", p[3], p[4], i % 3 + 1) for i, p in enumerate(people)]
    rows = [(i, a, str(c), y, f, g) for i, a, c, y, f, g in rows]
    df = spark.createDataFrame(rows, "id int, a double, c string, y double, fold int, other int")
    found = {(r["validation"], r["model"]): r for r in models.benchmark_metrics(models.benchmark_predictions(df, "y", {"none": [], "number": ["a"], "both": ["a", "c"]}, {"x": "fold", "z": "other"}, 3)).collect()}
    levels = sorted({r[2] for r in rows})
    for name, at in (("x", 4), ("z", 5)):
        fold, y = np.array([r[at] for r in rows]), np.array([r[3] for r in rows])
        for model in ("none", "number", "both"):
            prediction = np.zeros(60)
            for f in (1, 2, 3):
                median = np.median([r[1] for r in rows if r[at] != f and r[1] is not None])
                x = np.array([[1.0] + ([r[1] if r[1] is not None else median, float(r[1] is None)] if model != "none" else []) + ([float(r[2] == v) for v in levels] if model == "both" else []) for r in rows])
                m = fold != f
                b = np.linalg.solve(x[m].T @ x[m] + np.diag([0.0, *x[m][:, 1:].var(axis=0)]) + 1e-9 * np.eye(x.shape[1]), x[m].T @ y[m])
                prediction[fold == f] = x[fold == f] @ b
            r = found[name, model]
            assert (r["rows"], r["rmse"], r["mae"]) == pytest.approx((60, np.sqrt(((y - prediction) ** 2).mean()), np.abs(y - prediction).mean()))
            assert r["r2"] == pytest.approx(1 - ((y - prediction) ** 2).mean() / y.var())


def test_benchmark_differences(spark):
    """Against the definition; the interval holds the difference, and a model that is worse for everybody is worse in every draw."""
    rng = np.random.default_rng(4)
    rows = [("v", m, f"p{p}", 0.0, float(rng.normal(0, s) + (m == "bad") * 9)) for p in range(40) for _ in range(p % 3 + 1) for m, s in (("base", 1), ("like", 1), ("bad", 1))]
    df = spark.createDataFrame(rows, "validation string, model string, who string, actual double, prediction double")
    found = {r["challenger"]: r for r in models.benchmark_differences(df, "who", "base", ["like", "bad"], 200).collect()}
    mse = {m: np.mean([np.mean([r[4] ** 2 for r in rows if r[1] == m and r[2] == f"p{p}"]) for p in range(40)]) for m in ("base", "like", "bad")}
    for m, r in found.items():
        assert r["people"] == 40 and r["delta_rmse"] == pytest.approx(np.sqrt(mse[m]) - np.sqrt(mse["base"]))
        assert r["low"] < r["delta_rmse"] < r["high"]
    assert found["bad"]["low"] > max(0, found["like"]["high"])


def test_benchmark_bounds_levels(spark):
    rows = [(float(i), f"level {i}", i % 3 + 1) for i in range(models.LEVELS_MOST + 1)]
    with pytest.raises(ValueError, match="levels"):
        models.benchmark_predictions(spark.createDataFrame(rows, "y double, c string, fold int"), "y", {"m": ["c"]}, {"x": "fold"}, 3)


def test_components(table, people):
    x = np.array([p[1:4] for p in people])
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    v = vectors[:, -1] * np.sign(vectors[:, -1].sum())
    assert models.first_component(table, ["a", "b", "y"]) == pytest.approx(v)
    score = ((x - x.mean(axis=0)) / x.std(axis=0)) @ v
    got = models.component_scores(table, ["a", "b", "y"])
    assert [r["score"] for r in got.orderBy(F.expr("int(substring(id, 2))")).collect()] == pytest.approx((score / score.std(ddof=1)).tolist())
    stable = {r["fold"]: r for r in models.loading_stability(table, "fold", ["a", "b", "y"], 20).collect()}
    for f, r in stable.items():
        own = np.linalg.eigh(np.corrcoef(x[np.array([p[4] for p in people]) == f].T))[1][:, -1]
        assert r["congruence"] == pytest.approx(abs(own @ v)) and r["rows"] == 20
    assert models.loading_stability(table, "fold", ["a", "b", "y"], 21).count() == 0


def test_cumulative_sums_and_ranks(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v), float(w)) for g, v, w in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), rng.uniform(0, 1, 500), strict=True)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    for r in balance.cumulative(df, "v", "w", ["g"], parts=8).collect():
        assert r["_upto"] == pytest.approx(sum(w for g, v, w in rows if g == r["g"] and v <= r["v"]))
        assert r["_all"] == pytest.approx(sum(w for g, v, w in rows if g == r["g"]))
    for r in balance.average_rank(df, "v", "rank").select("v", "rank").distinct().collect():
        assert r["rank"] == sum(v < r["v"] for _, v, _ in rows) + (sum(v == r["v"] for _, v, _ in rows) + 1) / 2


def test_bootstrap_counts(spark):
    people = spark.createDataFrame([(f"id{i}", float(i)) for i in range(30)], "id string, x double")
    assert sorted(r["idx"] for r in resample.indexed(people, "id").collect()) == list(range(30))
    draws = resample.bootstrap(people, "id", 50, n=F.sum("weight"), mean=F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).collect()
    assert len(draws) == 50 and {r["n"] for r in draws} == {30}
    assert np.mean([r["mean"] for r in draws]) == pytest.approx(14.5, abs=1.5)
    at = [(float(i % 5), float(i * i % 7), 1 + i % 3) for i in range(30)]
    r = spark.createDataFrame(at, "a double, b double, weight int").agg(resample.weighted_correlation("a", "b").alias("r")).first()["r"]
    assert r == pytest.approx(np.corrcoef(*np.repeat([x[:2] for x in at], [x[2] for x in at], axis=0).T)[0, 1])
    assert spark.createDataFrame([(1.0, 2.0, 1), (1.0, 3.0, 1)], "a double, b double, weight int").agg(resample.weighted_correlation("a", "b")).first()[0] is None


def test_simulations_are_seeded_and_bounded(spark):
    rng = np.random.default_rng(0)
    y = np.clip(rng.normal(50, 20, 40), 0, 100)
    paths = resample.ar1_paths(y, 0.4, 3000, np.random.default_rng(1))
    assert paths.mean() == pytest.approx(y.mean(), abs=1.0) and paths.std(axis=1).mean() == pytest.approx(y.std(), rel=0.1)
    assert np.corrcoef(paths[:, :-1].ravel(), paths[:, 1:].ravel())[0, 1] == pytest.approx(0.4, abs=0.05)
    bound = resample.ar1_paths(y, 0.4, 100, np.random.default_rng(1), (0.0, 100.0))
    assert bound.min() >= 0 and bound.max() <= 100
    blocks = resample.block_paths(y, 8, 500, np.random.default_rng(1))
    assert set(blocks.ravel()) <= set(y)
    follows = {(a, b) for a, b in zip(y, np.roll(y, -1), strict=True)}
    kept = np.mean([(a, b) in follows for p in blocks[:50] for a, b in zip(p[:-1], p[1:], strict=True)])
    assert kept == pytest.approx(1 - 1 / 8, abs=0.05)
    m = resample.path_marginals(np.array([[0.0, 1.0, 2.5, 100.0, 101.0], [3.0] * 5]), 0.0, 100.0)
    assert m[0, [0, 2, 3, 5, 6]] == pytest.approx([40.9, 0.2, 0.2, 0.2, 0.8]) and np.isnan(m[1, 4])
    rows = spark.createDataFrame([(f"p{i % 3}", i // 3 + 1, 40, float(v), 0.3) for i, v in enumerate(np.tile(y, 3))], "id string, rn int, n int, y double, phi double")
    one, two = (sorted(map(tuple, redraw.simulated_null(df, "id", 20).collect())) for df in (rows, rows.repartition(7)))
    assert one == two and len(one) == 20
    free, held = (redraw.simulated_marginals(rows, "id", 50, 0.0, 100.0, bounds=b).first() for b in (None, (0.0, 100.0)))
    assert free["outside"] > 0 == held["outside"]


def test_retention_on_the_plateau(spark):
    """An abrupt plateau is kept by the frozen baseline, and by the others as much as the window lets through."""
    t = spark.createDataFrame([("p", i, 60, 1.0 + i % 2, 1.5, 1.5) for i in range(60)], "user_id string, pos long, m long, y double, bk double, lk double")
    scored = stress.scored(stress.injected(stress.scenarios(t, (0.5,), (14,), (1.0,)), ["user_id"]), F.lit(-1.0), F.lit(0.5))
    off = [0.0] * 30 + [(i + 1) / 14 for i in range(14)] + [1.0] * 16
    adapt = [sum(off[max(0, i - 8) : i]) / 8 for i in range(60)]
    left = np.mean([off[i] - adapt[i] for i in range(44, 52)])
    got = {r["method"]: r for r in stress.responses(scored, "user_id").collect()}
    assert {m: r["retention"] for m, r in got.items()} == pytest.approx({"B8": 1.0, "A50": (1 + left) / 2, "L8": left})
    assert all(r["targets"] == 22 and 0 <= r["delay"] <= 22 for r in got.values())


def test_grid_of_changes_is_that_of_copied_rows(spark):
    """All scenarios and both directions at once against one direction and a copy of the rows for each scenario; short series drop out."""
    rng = np.random.default_rng(6)
    rows = [(f"p{p}", i, m, float(rng.normal(3, 1)), float(rng.normal(3, 0.2)), float(rng.normal(3, 0.5))) for p, m in enumerate((20, 29, 45, 60, 80, 44)) for i in range(m)]
    t = spark.createDataFrame(rows, "user_id string, pos long, m long, y double, bk double, lk double")
    names = ["user_id", "fraction", "ramp", "magnitude", "method", "targets", "retention", "false_alarm", "detection", "excess", "detected", "delay"]
    grid = stress.grid_responses(t, "user_id", F.lit(0.7)).collect()
    for direction in (1.0, -1.0):
        copied = stress.scored(stress.injected(stress.scenarios(t, stress.FRACTIONS, stress.RAMPS, stress.MAGNITUDES), ["user_id"]), F.lit(direction), F.lit(0.7))
        wanted = sorted(tuple(r[n] for n in names) for r in stress.responses(copied, "user_id").collect())
        found = sorted(tuple(r[n] for n in names) for r in grid if r["direction"] == direction)
        assert [x[:6] for x in found] == [x[:6] for x in wanted] and np.array([x[6:] for x in found]) == pytest.approx(np.array([x[6:] for x in wanted]))
    assert len({tuple(r[n] for n in names[1:4]) for r in grid}) == 18 and "p0" not in {r["user_id"] for r in grid}


def test_retention_of_the_grid(spark):
    """Structural constants: what each baseline keeps of a plateau depends on the ramp alone."""
    t = spark.createDataFrame([("p", i, 80, float(i % 3), 1.0, 1.0) for i in range(80)], "user_id string, pos long, m long, y double, bk double, lk double")
    kept = {(r["method"], r["ramp"]): r["retention"] for r in stress.grid_responses(t, "user_id", F.lit(1.0)).collect()}
    wanted = {4: (1.0, 0.64453125, 0.2890625), 8: (1.0, 0.58203125, 0.1640625), 16: (1.0, 0.541015625, 0.08203125)}
    assert kept == pytest.approx({(m, r): v for r, vs in wanted.items() for m, v in zip(("B8", "A50", "L8"), vs, strict=True)})


@pytest.mark.parametrize("spread", [3.0, 1e-3])
def test_weighted_quantiles_of_many_weights(spark, spread):
    """Against sorted sums: ties, values on the edges of steps, absent weights, and all values within one step."""
    rng = np.random.default_rng(9)
    rows = [(int(g), float(v), *(float(w) if w < 2 else None for w in ws)) for g, v, ws in zip(rng.integers(0, 3, 600), spread * np.round(rng.normal(size=600), 1), rng.uniform(0, 3, (600, 2)), strict=True)]
    df = spark.createDataFrame(rows, "g int, v double, a double, b double")
    found = {(r["g"], r["at"]): r["threshold"] for r in balance.weighted_quantiles(df, "v", ["a", "b"], 0.9, ["g"], 1 / 256, 6).collect()}
    for g in range(3):
        for at in range(2):
            own = sorted((round(r[1], 6), r[2 + at]) for r in rows if r[0] == g and r[2 + at] is not None)
            share = np.cumsum([w for _, w in own]) / sum(w for _, w in own)
            assert found.pop((g, at)) == pytest.approx(own[int(np.argmax(share >= 0.9 - 1e-12))][0])
    assert not found


def test_thresholds_of_the_grid_order_no_copies_of_the_rows(spark, monkeypatch):
    """6,000 different scores: no more rows than these are put in order, not a row for each score, onset and ramp."""
    rng = np.random.default_rng(10)
    rows = [(p, i, 60, *map(float, rng.normal(3, 1, 3))) for p in range(100) for i in range(60)]
    t = spark.createDataFrame(rows, "user_id int, pos long, m long, y double, bk double, lk double")
    ordered, plain = [], balance.cumulative
    monkeypatch.setattr(balance, "cumulative", lambda steps, *a, **k: ordered.append(steps.count()) or plain(steps, *a, **k))
    assert stress.grid_responses(t, "user_id", F.lit(1.0)).count() == 100 * 9 * 12
    assert sum(ordered) <= len(rows)


def test_retention_needs_no_values(spark, tmp_path, same_rows):
    """A panel without any spread has no scores, but its retention is that of any other."""
    spark.sql("SELECT id % 2 AS user_id, id AS event_id, timestamp_seconds(id) AS ts, 'a' AS event_type, 3.0D AS value FROM range(120)").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same_rows(QUERIES["deterioration_retention"](spark, str(tmp_path)), con, ORACLES["deterioration_retention"])


@pytest.mark.parametrize("parts", [2, 7, 100])
def test_ranges_of_cumulative_sums(spark, parts):
    """Any number of ranges gives the same sums."""
    rows = [(float(v), 1.0) for v in np.random.default_rng(11).integers(0, 60, 300)]
    got = balance.cumulative(spark.createDataFrame(rows, "v double, w double"), "v", "w", parts=parts).collect()
    assert len(got) == 300 and all(r["_upto"] == sum(v <= r["v"] for v, _ in rows) for r in got)


def test_loadings_by_several_groupings(spark):
    """Against numpy, with a grouping that has a null level, and groups under the bound left out."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3)) + rng.normal(size=(300, 1))
    rows = [(2020 + i % 2, None if i % 3 == 0 else "ios" if i % 3 == 1 or i < 200 else "rare", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "year int, platform string, a double, b double, c double")
    found = {(r["grouping"], r["level"]): r for r in models.loading_table(df, ["year", "platform"], ["a", "b", "c"], 50).collect()}
    first = lambda v: np.linalg.eigh(np.corrcoef(v.T))[1][:, -1]
    for i, name in ((0, "year"), (1, "platform")):
        for level in {r[i] for r in rows}:
            part = x[[r[i] == level for r in rows]]
            r = found.pop((name, None if level is None else str(level)), None)
            assert (r is None) == (len(part) < 50)
            if r:
                v = first(part) * np.sign(first(part).sum())
                assert r["rows"] == len(part) and r["loadings"] == pytest.approx(v.tolist()) and r["congruence"] == pytest.approx(abs(v @ first(x)))
    assert not found


def test_flow_and_its_guard(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", None), ("c", 9), (None, 7)], "who string, v int")
    ledger = quality.flow(df, "who", {"all": F.lit(True), "known": F.col("v").isNotNull(), "large": F.col("v") > 4})
    assert [tuple(r) for r in ledger.orderBy("step").collect()] == [(0, "all", 5, 3, 0, 0), (1, "known", 4, 2, 1, 1), (2, "large", 3, 2, 1, 0)]
    same = spark.createDataFrame([("large", 3, 2)], "name string, rows long, people long")
    assert quality.require_flow(ledger, same).count() == 3
    assert [tuple(r) for r in quality.require_flow(ledger, same).orderBy("step").collect()] == [tuple(r) for r in ledger.orderBy("step").collect()]
    for wrong in (("large", 2, 2), ("large", 3, 1), ("other", 1, 1)):
        with pytest.raises(Exception, match="flow differs"):
            quality.require_flow(ledger, spark.createDataFrame([wrong], "name string, rows long, people long")).collect()
    empty = quality.flow(df.where("v > 99"), "who", {"all": F.lit(True)})
    assert [tuple(r) for r in empty.collect()] == [(0, "all", 0, 0, 0, 0)]


def test_guards(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 0, 3), (2, 1, 4), (3, 1, 1), (3, 2, 1)], "k int, a int, b int")
    assert [tuple(r) for r in quality.scale_total(df, ["k"], ["a", "b"], 0, 3, 6).collect()] == [(1, 0, 3, 3)]
    with pytest.raises(Exception, match="outside the scale"):
        quality.scale_total(df, ["k"], ["a", "b"], 0, 3, 2).collect()
    with pytest.raises(Exception, match="repeat"):
        quality.require_unique(df, ["k"]).collect()
    assert sorted(map(tuple, quality.frame_difference(df, df.where("k <> 2").unionByName(df.where("k = 3"))).collect())) == [("left", 2, 1, 4), ("right", 3, 1, 1), ("right", 3, 2, 1)]
    assert quality.private_columns(spark.createDataFrame([(1, 2, 3)], "score int, Latitude int, my_uid int")) == ["Latitude", "my_uid"]
    assert quality.private_paths("see /home/x/y and C:\\z\\q") == ["/home/x/y", "C:\\z\\q"]


def test_verdicts(spark):
    one = spark.range(1)
    say = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert [say(verdicts.improvement(lit(r), lit(h))) for r, h in ((-2.0, -1.0), (-2.0, 1.0), (1.0, 2.0))] == ["supported", "direction only", "not supported"]
    assert [say(verdicts.reliability(lit(r), lit(h))) for r, h in ((0.6, 0.3), (0.6, 0.2), (0.4, 0.3))] == ["reliable", "uncertain", "unreliable"]
    assert [say(verdicts.against_null(lit(p))) for p in (0.0125, 0.013)] == ["beyond the null", "within the null"]
    assert [say(verdicts.future_gain(lit(g), lit(-1.0), lit(0.2), lit(p))) for g, p in ((11.0, 0.01), (9.0, 0.01), (11.0, 0.02))] == ["predictable", "not predictable", "not predictable"]


def test_manifest_names_versions(spark, tmp_path):
    from longpanel.sources import tables

    made = tables.write_all({"ids.parquet": spark.range(3)}, str(tmp_path), seed=7, checks={"rows": 3})
    assert re.fullmatch(r"\d+\.\d+.*", made["versions"]["pyspark"]) and made["seed"] == 7
    (text,) = spark.read.text(f"{tmp_path}/manifest.json").first()
    assert json.loads(text) == made


def test_cohorts_and_protocols(spark, tmp_path):
    from longpanel.sources import tables

    tables.register("three")(lambda spark, folder: spark.range(3).withColumn("done", F.col("id") > 0))
    assert tables.cohort(spark, "", "three").count() == 3 and tables.cohort(spark, "", "three", "done").count() == 2
    with pytest.raises(KeyError, match="no cohort"):
        tables.cohort(spark, "", "none")
    (tmp_path / "protocol.txt").write_text("x")
    tables.require_files(spark, str(tmp_path / "protocol.txt"))
    with pytest.raises(FileNotFoundError):
        tables.require_files(spark, str(tmp_path / "absent.txt"))


def test_blocked_split_cuts_at_the_exact_share(spark):
    """0.7 of 90 reports are 63, and of 70 are 49, though doubles make them less."""
    rows = [(n, i + 1, n, f"2024-01-{1 if i < n * 7 // 10 else 28:02d}") for n in (70, 90, 10) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, rn int, n int, day string").withColumn("ts", F.to_timestamp("day"))
    found = {(r["id"], r["part"]): r["count"] for r in models.blocked_split(df, ["id"], "ts").groupBy("id", "part").count().collect()}
    assert found == {(n, p): c for n in (70, 90, 10) for p, c in (("train", n * 7 // 10), ("test", n - n * 7 // 10))}


def test_permuted_labels_meet_their_persons_by_rank_in_any_number_of_ranges(spark, people, monkeypatch):
    """Against sums over whole permutations, with persons of a draw dealt out over many ranges of the hash, and no row for each person and draw."""
    table = spark.createDataFrame(people, "id string, a double, b double, y double, fold int")
    whole = {r["draw"]: (r["r"], r["rmse_percent"]) for r in models.label_permutation(table, "id", ["a", "b"], "y", [0.1, 10.0], 3, 40).collect()}
    monkeypatch.setattr(models, "RANGE_PEOPLE", 7)
    monkeypatch.setattr(models, "PART_DRAWS", 3)
    null = models.label_permutation(table, "id", ["a", "b"], "y", [0.1, 10.0], 3, 40)
    dealt = {r["draw"]: (r["r"], r["rmse_percent"]) for r in null.collect()}
    assert sorted(dealt) == list(range(-1, 40)) == sorted(whole)
    assert all(dealt[i] == pytest.approx(whole[i]) for i in whole)
    order = resample.indexed(table, "id").orderBy("idx").collect()
    inner = {(r["id"], r["test_fold"]): r["inner"] for r in resample.inner_folds(table, "id", 3).collect()}
    x, y = np.array([[1.0, r["a"], r["b"]] for r in order]), np.array([r["y"] for r in order])
    x[:, 1:], y = x[:, 1:] - x[:, 1:].mean(axis=0), y - y.mean()
    for draw in (0, 39):
        at = np.empty(len(y), int)
        at[np.argsort(lcg_array(resample.SEED, draw, np.arange(len(y))), kind="stable")] = np.arange(len(y))
        cells = {}
        for t in (1, 2, 3):
            for i in range(4):
                m = np.array([inner[r["id"], t] == i for r in order])
                cells[t, i] = x[m].T @ x[m], x[m].T @ y[at][m], float(y[at][m] @ y[at][m])
        assert dealt[draw] == pytest.approx(models.nested_statistics(cells, [0.1, 10.0]), rel=1e-6)
    assert "Generate explode(sequence(-1" not in null._jdf.queryExecution().toString()


def test_design_sums_read_a_row_once_for_all_folds(spark, people):
    """Against numpy for two validations; the predictions copy no row for a training set."""
    rows = [(None if i % 7 == 0 else p[1], "uv"[i % 2], p[3], p[4], i % 2 + 1) for i, p in enumerate(people)]
    df = spark.createDataFrame(rows, "a double, c string, y double, fold int, other int").repartition(3)
    found = models.design_sums(df, ["a", "c"], {"c": ["u", "v"]}, "y", ["fold", "other"])
    x = np.array([[1.0, r[0] or 0.0, r[0] is None, r[1] == "u", r[1] == "v"] for r in rows], float)
    y = np.array([r[2] for r in rows])
    assert sorted(found) == sorted({("fold", r[3]) for r in rows} | {("other", r[4]) for r in rows})
    for (name, f), (a, b) in found.items():
        m = np.array([r[3 if name == "fold" else 4] == f for r in rows])
        assert a == pytest.approx(x[m].T @ x[m]) and b == pytest.approx(x[m].T @ y[m])
    plan = models.benchmark_predictions(df, "y", {"both": ["a", "c"]}, {"x": "fold", "z": "other"}, 3)._jdf.queryExecution().toString()
    assert "Generate" not in plan
