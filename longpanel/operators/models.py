"""Small models from sums that Spark aggregates: cross-fitted blends, ridge, logistic, PCA, metrics.

Only sums of fixed size (a few coefficients wide) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, correlation, lcg_array, logit
from .balance import cumulative
from .resample import SEED, bootstrap_means, indexed, inner_folds


def held_out_folds(rows: DataFrame, k: int) -> DataFrame:
    """Each row once for every fold that it trains: test_fold is never its own fold."""
    return rows.withColumn("test_fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).where("test_fold <> fold")


def standardised(rows: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """z_<column>, centred and scaled (population SD) by the training rows of the row's fold."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    fitted = held_out_folds(rows, k).groupBy("test_fold").agg(*aggs)
    out = rows.join(F.broadcast(fitted), rows["fold"] == fitted["test_fold"]).drop("test_fold")
    for c in columns:
        out = out.withColumn(f"z_{c}", (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).drop(f"_m_{c}", f"_s_{c}")
    return out


def recency_weight(rows: DataFrame, entity: str, mean: str, last: str, k: int, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """weight per test_fold (and draw or other group): the entity-balanced least-squares blend mean + w (last - mean), within [0, 1]."""
    d, r = F.col(last) - F.col(mean), F.col(y) - F.col(mean)
    per = rows.groupBy(*by, "fold", entity).agg(F.avg(d * r).alias("num"), F.avg(d * d).alias("den"))
    fitted = held_out_folds(per, k).groupBy(*by, "test_fold").agg(F.avg("num").alias("num"), F.avg("den").alias("den"))
    return fitted.select(*by, "test_fold", clip(F.coalesce(F.try_divide("num", "den"), F.lit(0.0)), 0.0, 1.0).alias("weight"))


def recency_weight_grid(rows: DataFrame, entity: str, mean: str, last: str, k: int, steps: int = 40, y: str = "y") -> DataFrame:
    """weight per test_fold: of 0, 1/steps, .., 1 the one with least entity-balanced absolute error, the smallest on ties.

    The grid is folded into an entity's sums before anything is shuffled by fold.
    """
    grid = [i / steps for i in range(steps + 1)]
    loss = [F.avg(F.abs(F.col(y) - F.col(mean) - w * (F.col(last) - F.col(mean)))).alias(f"l{i}") for i, w in enumerate(grid)]
    per = rows.groupBy("fold", entity).agg(*loss)
    fitted = held_out_folds(per, k).groupBy("test_fold").agg(*[F.avg(f"l{i}").alias(f"l{i}") for i in range(steps + 1)])
    best = F.array_min(F.array(*[F.struct(F.round(F.col(f"l{i}"), 12).alias("loss"), F.lit(w).alias("weight")) for i, w in enumerate(grid)]))
    return fitted.select("test_fold", best["weight"].alias("weight"), best["loss"].alias("loss"))


def crossfit(rows: DataFrame, weights: DataFrame, mean: str, last: str, by: Sequence[str] = ()) -> DataFrame:
    """prediction of each row with the weight of its own fold, which its entity did not help to fit."""
    met = rows.join(F.broadcast(weights.select(*by, F.col("test_fold").alias("fold"), "weight")), [*by, "fold"])  # k rows a group
    return met.withColumn("prediction", F.col(mean) + F.col("weight") * (F.col(last) - F.col(mean)))


def budget_errors(rows: DataFrame, entity: str, mean: str, last: str, k: int, steps: int = 40, y: str = "y") -> DataFrame:
    """budget, entity, mae of blends whose weight is chosen from the grid for each budget and fold, without the fold's entities."""
    grid = [i / steps for i in range(steps + 1)]
    error = lambda w: F.abs(F.col(y) - F.col(mean) - w * (F.col(last) - F.col(mean)))
    per = rows.groupBy("budget", "fold", entity).agg(*[F.avg(error(w)).alias(f"l{i}") for i, w in enumerate(grid)])
    fitted = held_out_folds(per, k).groupBy("budget", "test_fold").agg(*[F.avg(f"l{i}").alias(f"l{i}") for i in range(steps + 1)])
    best = F.array_min(F.array(*[F.struct(F.round(F.col(f"l{i}"), 12).alias("loss"), F.lit(i).alias("i")) for i in range(steps + 1)]))
    chosen = fitted.select("budget", F.col("test_fold").alias("fold"), best["i"].alias("i"))
    # the entity's error under the chosen weight is one of those that it was tuned on
    losses = F.array(*[F.col(f"l{i}") for i in range(steps + 1)])
    return per.join(F.broadcast(chosen), ["budget", "fold"]).select("budget", entity, F.get(losses, F.col("i")).alias("mae"))


def fold_audit(rows: DataFrame, entity: str, k: int) -> DataFrame:
    """Per fold: entities and rows inside, entities outside, and entities on both sides."""
    own = rows.groupBy("fold", entity).agg(F.count("*").alias("c"))
    sides = own.withColumn("test_fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    inside = F.col("fold") == F.col("test_fold")
    each = sides.groupBy("test_fold", entity).agg(F.sum(F.when(inside, F.col("c")).otherwise(0)).alias("rows"), F.max(inside).alias("test"), F.max(~inside).alias("train"))
    g = each.groupBy(F.col("test_fold").alias("fold")).agg(F.count_if("test").alias("test_people"), F.sum("rows").alias("test_rows"), F.count_if("train").alias("train_people"), F.count_if(F.col("test") & F.col("train")).alias("shared_people"))
    return g.where("test_rows > 0")


def blocked_split(rows: DataFrame, entity: Sequence[str], time: str, share: float = 0.7, purge_days: float = 14.0) -> DataFrame:
    """part: train or test by order within the entity; training rows near the first test row are purged."""
    part = Window.partitionBy(*entity)
    # exact, since 90 * 0.7 in doubles is less than 63
    cut = F.floor(F.col("n") * F.lit(Decimal(str(share)))).cast("long")
    out = rows.withColumn("_cut", cut)
    out = out.withColumn("_first", F.min(F.when(F.col("rn") > F.col("_cut"), F.col(time))).over(part)).where(F.col("n") - F.col("_cut") >= 2)
    keep = (F.col("rn") > F.col("_cut")) | (F.col(time) <= F.col("_first") - F.make_dt_interval(days=F.lit(int(purge_days))))
    return out.where(keep).withColumn("part", F.when(F.col("rn") > F.col("_cut"), "test").otherwise("train")).drop("_cut", "_first")


def _gram_columns(features: Sequence[str], ys: Sequence[str], weight: Column | None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    x = [F.lit(1.0), *map(F.col, features)]
    p = len(x)
    return [F.sum(w * x[i] * x[j]) for i in range(p) for j in range(i, p)] + [F.sum(w * x[i] * F.col(y)) for y in ys for i in range(p)] + [F.sum(w * F.col(y) * F.col(y)) for y in ys]


def _unpacked(sums: Sequence, p: int, ys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, it = np.zeros((p, p)), iter(sums)
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = next(it) or 0.0
    rest = np.array([v or 0.0 for v in it], float)
    return a, rest[: p * ys].reshape(ys, p).T, rest[p * ys :]


def gram(rows: DataFrame, features: Sequence[str], y: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy with an intercept in front, as one aggregate row."""
    a, b, _ = _unpacked(rows.agg(*_gram_columns(features, [y], weight)).first(), len(features) + 1, 1)
    return a, b[:, 0]


def ridge(rows: DataFrame, features: Sequence[str], y: str, alpha: float, weight: Column | None = None) -> np.ndarray:
    """Intercept and coefficients; the intercept is not penalised."""
    a, b = gram(rows, features, y, weight)
    return np.linalg.solve(a + np.diag([0.0] + [alpha] * len(features)), b)


def linear(coefficients: Sequence[float], features: Sequence[str]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, f in zip(coefficients[1:], features, strict=True):
        out = out + float(c) * F.col(f)
    return out


def logistic(rows: DataFrame, features: Sequence[str], y: str, c: float = 1.0, weight: Column | None = None, steps: int = 25, tolerance: float = 1e-8) -> np.ndarray:
    """L2 logistic regression by Newton steps, each one aggregate; c is the inverse penalty."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.lit(1.0), *map(F.col, features)]
    p, b = len(x), np.zeros(len(x))
    penalty = np.diag([0.0] + [1 / c] * (p - 1))
    for _ in range(steps):
        q = 1 / (1 + F.exp(-linear(b, features)))
        at = rows.withColumn("_q", q)
        s = w * F.col("_q") * (1 - F.col("_q"))
        sums = at.agg(*[F.sum(s * x[i] * x[j]) for i in range(p) for j in range(i, p)], *[F.sum(w * x[i] * (F.col(y) - F.col("_q"))) for i in range(p)]).first()
        h, it = np.zeros((p, p)), iter(sums)
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = next(it) or 0.0
        step = np.linalg.solve(h + penalty, np.array([v or 0.0 for v in it], float) - penalty @ b)
        b = b + step
        if np.abs(step).max() < tolerance:
            break
    return b


def first_component(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Loadings of the first principal component of standardised columns, with a positive sum."""
    p = len(columns)
    return _component(p, rows.agg(*[F.corr(columns[i], columns[j]) for i in range(p) for j in range(i + 1, p)]).first())


def _component(p: int, correlations: Sequence) -> np.ndarray:
    r, it = np.eye(p), iter(correlations)
    for i in range(p):
        for j in range(i + 1, p):
            r[i, j] = r[j, i] = next(it) or 0.0
    v = np.linalg.eigh(r)[1][:, -1]
    return v if v.sum() >= 0 else -v


def _steps(rows: DataFrame, score: str, label: str, weight: str | None) -> DataFrame:
    """Sums of label 1 and 0 for each distinct score, and of both up to and with it."""
    w = F.col(weight) if weight else F.lit(1.0)
    steps = rows.groupBy(score).agg(F.sum(w * F.col(label)).alias("_p"), F.sum(w * (1 - F.col(label))).alias("_n"))
    first = cumulative(steps, score, "_n").withColumnsRenamed({"_upto": "_n_upto", "_all": "_n_all"})
    return cumulative(first, score, "_p").withColumnsRenamed({"_upto": "_p_upto", "_all": "_p_all"})


def auc(rows: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties at half, from sums per distinct score."""
    return _steps(rows, score, label, weight).agg(F.try_divide(F.sum(F.col("_p") * (F.col("_n_upto") - F.col("_n") / 2)), F.sum("_p") * F.sum("_n")).alias("auc"))


def pr_auc(rows: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall that it adds."""
    s = _steps(rows, score, label, weight)
    above_p, above_n = F.col("_p_all") - F.col("_p_upto") + F.col("_p"), F.col("_n_all") - F.col("_n_upto") + F.col("_n")
    return s.agg(F.try_divide(F.sum(F.col("_p") * above_p / (above_p + above_n)), F.sum("_p")).alias("pr_auc"))


def pooled_metrics(rows: DataFrame, prediction: str, actual: str) -> DataFrame:
    """rows, rmse, mae, r2 (one less the share of squared error, not the squared correlation) and r of predictions."""
    e = F.col(actual) - F.col(prediction)
    return rows.agg(
        F.count("*").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(actual))).alias("r2"), correlation(F.col(prediction), F.col(actual)).alias("r"),
    )


def brier(rows: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.agg(F.try_divide(F.sum(w * F.pow(F.col(score) - F.col(label), 2)), F.sum(w)).alias("brier"))


def calibration(rows: DataFrame, score: str, label: str, weight: str | None = None) -> np.ndarray:
    """Intercept and slope of the label on the score's logit."""
    return logistic(rows.withColumn("_z", logit(F.col(score))), ["_z"], label, c=1e6, weight=F.col(weight) if weight else None)


#: Rows that one step of a Newton pass holds beside all fits.
FIT_ROWS = 8192


def fold_sums(rows: DataFrame, features: Sequence[str], y: str, fits: Sequence[tuple[int, int]], coefficients: np.ndarray, weight: str | None = None) -> DataFrame:
    """fit, hessian (upper triangle by rows), gradient: sums of each fit's logistic loss over the rows of neither of its left-out folds.

    A row is read once for all fits: a batch meets the matrix of all coefficients, and which fits a row belongs to is a table of
    (fold, fit) bits.  A task sends on one row a fit.  Rows with a null take no part.
    """
    p, names = len(features) + 1, [*features, y, *([weight] if weight else [])]
    upper = np.triu_indices(p)
    left_out = np.array(fits, np.int64).reshape(-1, 2)

    def run(batches):
        h, gradient = np.zeros((len(fits), len(upper[0]))), np.zeros((len(fits), p))
        for batch in batches:
            for at in range(0, batch.num_rows, FIT_ROWS):
                part = batch.slice(at, FIT_ROWS)
                fold, *columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                x = np.column_stack([np.ones(len(fold)), *columns[: p - 1]])
                w = columns[p] if weight else np.ones(len(fold))
                folds, own = np.unique(fold, return_inverse=True)
                trains = (left_out[:, 0] != folds[:, None]) & (left_out[:, 1] != folds[:, None])
                share = w[:, None] * trains[own]
                q = 1 / (1 + np.exp(-np.clip(x @ coefficients.T, -700, 700)))
                h += (share * q * (1 - q)).T @ (x[:, upper[0]] * x[:, upper[1]])
                gradient += (share * (columns[p - 1][:, None] - q)).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits), dtype=np.int32)), pa.array(list(h), pa.list_(pa.float64())), pa.array(list(gradient), pa.list_(pa.float64()))], names=["fit", "h", "g"])

    whole = rows.select(F.col("fold").cast("long").alias("fold"), *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    sums = whole.mapInArrow(run, "fit int, h array<double>, g array<double>")
    total = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    return sums.groupBy("fit").agg(total("h", len(upper[0])).alias("hessian"), total("g", p).alias("gradient"))


def logistic_family(rows: DataFrame, features: Sequence[str], y: str, fits: Sequence[tuple[int, int, float]], weight: str | None = None, steps: int = 25, tolerance: float = 1e-8) -> dict:
    """Coefficients of L2 logistic regressions (left-out fold, another left-out fold or 0, C), all of them a Newton step a job."""
    p = len(features) + 1
    upper = np.triu_indices(p)
    b = {fit: np.zeros(p) for fit in fits}
    still = list(fits)
    for _ in range(steps):
        moved = []
        for fit, h, gradient in fold_sums(rows, features, y, [fit[:2] for fit in still], np.array([b[fit] for fit in still]), weight).collect():  # a row a fit
            fit, whole = still[fit], np.zeros((p, p))
            whole[upper] = h
            whole = whole + np.triu(whole, 1).T
            penalty = np.diag([0.0] + [1 / fit[2]] * (p - 1))
            step = np.linalg.solve(whole + penalty + 1e-12 * np.eye(p), np.array(gradient) - penalty @ b[fit])
            b[fit] = b[fit] + step
            if np.abs(step).max() >= tolerance:
                moved.append(fit)
        still = moved
        if not still:
            break
    return b


def crossfit_logistic(rows: DataFrame, features: Sequence[str], y: str, k: int, cs: Sequence[float], weight: str | None = None) -> DataFrame:
    """probability of each row by a model of the other folds, whose C has the least inner log-loss, the smaller on ties."""
    w = F.col(weight) if weight else F.lit(1.0)
    spark, folds = rows.sparkSession, range(1, k + 1)
    # the steps' input is computed once; a lost executor's part of it is computed again
    kept = rows.select("fold", *features, y, *([weight] if weight else [])).persist(StorageLevel.DISK_ONLY)
    inner = logistic_family(kept, features, y, [(f, g, c) for f in folds for g in folds if g != f for c in cs], weight)
    table = spark.createDataFrame([(f, g, float(c), v.tolist()) for (f, g, c), v in inner.items()], "f int, g int, c double, _coef array<double>")
    prob = lambda: 1 / (1 + F.exp(-sum((F.col("_coef")[i + 1] * F.col(n) for i, n in enumerate(features)), F.col("_coef")[0])))
    at = kept.join(F.broadcast(table), F.col("fold") == F.col("g")).withColumn("_q", clip(prob(), 1e-12, 1 - 1e-12))
    loss = -(F.col(y) * F.ln("_q") + (1 - F.col(y)) * F.ln(1 - F.col("_q")))
    found = at.groupBy("f", "c").agg((F.sum(w * loss) / F.sum(w)).alias("loss")).collect()  # k times the grid
    best = {f: min((round(r["loss"], 12), r["c"]) for r in found if r["f"] == f)[1] for f in {r["f"] for r in found}}
    outer = logistic_family(kept, features, y, [(f, 0, c) for f, c in best.items()], weight)
    kept.unpersist()
    table = spark.createDataFrame([(f, float(c), v.tolist()) for (f, _, c), v in outer.items()], "fold int, c double, _coef array<double>")
    return rows.join(F.broadcast(table), "fold").withColumn("probability", prob()).drop("_coef")


def _centres(rows: DataFrame, columns: Sequence[str]) -> list[float]:
    """Means of columns: sums of squares around them lose no digits to their size."""
    return [v or 0.0 for v in rows.agg(*[F.avg(c) for c in columns]).first()]


def _complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))


def standardised_ridge(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and raw coefficients of a ridge on columns centred and scaled (population SD) by the training rows, from their sums.

    a is X'X and b X'y with an intercept in front.  A column without spread is left as it is, so its coefficient is 0.
    """
    n = max(a[0, 0], 1.0)
    mean, y = a[0, 1:] / n, b[0] / n
    spread = a[1:, 1:] / n - np.outer(mean, mean)
    var = np.diag(spread)
    sd = np.sqrt(np.where(var > 1e-14 * (1 + mean * mean), var, np.inf))
    z = n * spread / np.outer(sd, sd)
    c = np.linalg.solve(z + alpha * np.eye(len(z)), (b[1:] - mean * b[0]) / sd) / sd
    return np.r_[y - mean @ c, c]


def nested_choice(parts: dict, alphas: Sequence[float]) -> float:
    """The penalty with least root mean squared error over the inner folds 1..k of one training set, the largest of those as good."""
    inner, losses = [i for i in parts if i > 0], []
    whole = [sum(parts[i][j] for i in inner) for j in range(2)]
    for alpha in alphas:
        loss = n = 0.0
        for i in inner:
            a, b, yy = parts[i]
            c = standardised_ridge(whole[0] - a, whole[1] - b, alpha)
            loss, n = loss + yy - 2 * c @ b + c @ a @ c, n + a[0, 0]
        losses.append(np.sqrt(max(loss, 0.0) / max(n, 1.0)))
    return float(max(a for a, x in zip(alphas, losses, strict=True) if np.isclose(x, min(losses), rtol=1e-9, atol=1e-12)))


def nested_fit(parts: dict, alphas: Sequence[float]) -> tuple[float, np.ndarray]:
    alpha, inner = nested_choice(parts, alphas), [i for i in parts if i > 0]
    return alpha, standardised_ridge(sum(parts[i][0] for i in inner), sum(parts[i][1] for i in inner), alpha)


def nested_statistics(cells: dict, alphas: Sequence[float]) -> tuple[float, float]:
    """Correlation of out-of-fold predictions, and percent by which their error differs from the mean's, from sums of (test fold, inner fold)."""
    n = sy = syy = sp = spp = spy = base = 0.0
    for test in {t for t, _ in cells}:
        parts = {i: v for (t, i), v in cells.items() if t == test}
        if 0 not in parts or len(parts) < 3:
            continue
        (a, b, yy), c = parts[0], nested_fit(parts, alphas)[1]
        mean = sum(parts[i][1][0] for i in parts if i) / max(sum(parts[i][0][0, 0] for i in parts if i), 1.0)
        n, sy, syy = n + a[0, 0], sy + b[0], syy + yy
        sp, spp, spy = sp + c @ a[0], spp + c @ a @ c, spy + c @ b
        base += yy - 2 * mean * b[0] + mean * mean * a[0, 0]
    spread = max(spp - sp * sp / n, 0.0) * max(syy - sy * sy / n, 0.0) if n else 0.0
    r = float((spy - sp * sy / n) / np.sqrt(spread)) if spread > 1e-18 * max(spp * syy, 1e-300) else float("nan")
    return r, float(100 * (np.sqrt(max(syy - 2 * spy + spp, 0.0) / base) - 1)) if base > 0 else float("nan")


def nested_cells(people: DataFrame, key: str, features: Sequence[str], y: str, k: int, seed: int = SEED) -> tuple[dict, list[float]]:
    """X'X, X'y, y'y of each (test fold, inner fold or 0 for the test fold), around the columns' means, which come along; k (k + 1) rows reach the driver."""
    people = _complete(people, [*features, y])
    centres = _centres(people, [*features, y])
    moved = inner_folds(people.select(key, "fold", *[(F.col(c) - m).alias(c) for c, m in zip([*features, y], centres, strict=True)]), key, k, seed)
    p, cells = len(features) + 1, {}
    for row in moved.groupBy("test_fold", "inner").agg(*_gram_columns(features, [y], None)).collect():
        a, b, yy = _unpacked(row[2:], p, 1)
        cells[row[0], row[1]] = a, b[:, 0], float(yy[0])
    return cells, centres


#: Persons that a range of the hash holds on average, and draws whose ranges are one group.
RANGE_PEOPLE = 1 << 16
PART_DRAWS = 16


def _permuted_sums(numbered: DataFrame, inner: DataFrame, features: Sequence[str], y: str, k: int, draws: int, n: int, seed: int) -> DataFrame:
    """draw, test_fold, inner, sums of the intercept and the features with the permuted labels, and of the labels' squares.

    A person gets the label at the rank of their hash in the draw.  Ranges of the hash share the persons out, in arrays of a draw and
    range each; a range's ranks follow on those of the ranges below it, so it meets a run of the labels.
    """
    ranges, width = max(1, -(-n // RANGE_PEOPLE)), len(features)
    names = [*(f"s{i}" for i in range(width + 1)), "yy"]

    def hashed(idx):  # by parts of the draws
        for first in range(0, draws, PART_DRAWS):
            some = np.arange(first, min(first + PART_DRAWS, draws))
            h = lcg_array(seed, some[:, None], idx)
            yield some, h, h * ranges // ((1 << 31) - 1)

    def sized(batches):
        for batch in batches:
            for some, _, at in hashed(batch.column(0).to_numpy()):
                counts = np.bincount((at + ranges * np.arange(len(some))[:, None]).ravel(), minlength=ranges * len(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, ranges).astype(np.int32)), pa.array(np.tile(np.arange(ranges, dtype=np.int32), len(some))), pa.array(counts)], names=["draw", "range", "c"])

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, *x = (c.to_numpy() for c in batch.columns[:-1])
            x, places = np.column_stack(x), np.array(batch.column(width + 1).flatten().to_numpy().reshape(len(idx), k), np.uint8)
            for some, h, at in hashed(idx):
                rows = [(d, r, (h[j, i] << 32 | idx[i]).tobytes(), x[i].tobytes(), places[i].tobytes()) for j, d in enumerate(some.tolist()) for r in range(ranges) if len(i := np.flatnonzero(at[j] == r))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["draw", "range", "keys", "x", "places"])

    def met(key, pieces, labels):
        out = []
        if pieces.num_rows and labels.num_rows:
            place, label = labels.column("idx").to_numpy(), labels.column("y").to_numpy()
            label, low = label[np.argsort(place)], place.min()
            draw, before = pieces.column("draw").to_numpy(), pieces.column("before").to_numpy()
            for d in np.unique(draw):
                of = np.flatnonzero(draw == d)
                keys, x, places = (np.frombuffer(b"".join(pieces.column(c).take(of).to_pylist()), t) for c, t in (("keys", np.int64), ("x", float), ("places", np.uint8)))
                got = np.empty(len(keys))
                first = before[of[0]] - low
                got[np.argsort(keys)] = label[first : first + len(keys)]
                together = [got, *(x.reshape(-1, width) * got[:, None]).T, got * got]
                for t, inside in enumerate(places.reshape(-1, k).T):
                    sums = [np.bincount(inside, w, k + 1) for w in together]
                    out += [(d, t + 1, i, *values) for i, values in enumerate(zip(*sums, strict=True))]
        columns = list(zip(*out, strict=True)) or [[]] * (3 + len(names))
        return pa.table({c: pa.array(v, pa.int32() if j < 3 else pa.float64()) for j, (c, v) in enumerate(zip(["draw", "test_fold", "inner", *names], columns, strict=True))})

    part = F.expr(f"draw div {PART_DRAWS}").alias("part")
    sizes = numbered.select("idx").mapInArrow(sized, "draw int, range int, c bigint").groupBy("draw", "range").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("draw").orderBy("range"))
    sizes = sizes.withColumn("before", upto - F.col("c"))  # a row a draw and range
    places = inner.groupBy("idx", *features).agg(F.transform(F.array_sort(F.collect_list(F.struct("test_fold", "inner"))), lambda c: c["inner"]).alias("places"))
    pieces = places.select("idx", *features, "places").mapInArrow(dealt, "draw int, range int, keys binary, x binary, places binary")
    pieces = pieces.join(F.broadcast(sizes.drop("c")), ["draw", "range"]).withColumn("part", part)
    cell = lambda c: F.expr(f"{c} div {RANGE_PEOPLE}")
    spans = sizes.groupBy("range", part).agg(F.min("before").alias("low"), F.max(F.col("before") + F.col("c")).alias("high")).where("high > low")
    spans = spans.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    labels = numbered.select("idx", F.col(y).alias("y"), cell("idx").alias("cell")).join(spans, "cell").where("idx >= low AND idx < high").select("range", "part", "idx", "y")
    sums = pieces.groupBy("range", "part").cogroup(labels.groupBy("range", "part")).applyInArrow(met, f"draw int, test_fold int, inner int, {', '.join(f'{c} double' for c in names)}")
    return sums.groupBy("draw", "test_fold", "inner").agg(*[F.sum(c).alias(c) for c in names])


def label_permutation(people: DataFrame, key: str, features: Sequence[str], y: str, alphas: Sequence[float], k: int, draws: int, seed: int = SEED) -> DataFrame:
    """draw, r, rmse_percent of out-of-fold predictions by the nested ridge, with y permuted over people; draw -1 has the real order.

    Permuted labels meet their persons by rank.  Folds and sums of the features are those of the real order; each draw adds its
    sums with the labels, and its models are solved from these alone.
    """
    # a row a person, read for centres, folds, ranks and labels
    whole = _complete(people, [*features, y]).select(key, "fold", *features, y).persist(StorageLevel.DISK_ONLY)
    cells, centres = nested_cells(whole, key, features, y, k, seed)
    numbered = indexed(whole.select(key, "fold", *[(F.col(c).cast("double") - m).alias(c) for c, m in zip([*features, y], centres, strict=True)]), key).persist(StorageLevel.DISK_ONLY)
    n = int(sum(a[0, 0] for (t, _), (a, _, _) in cells.items() if t == 1))
    inner = inner_folds(numbered.select(key, "fold", "idx", *features), key, k, seed)
    sums = _permuted_sums(numbered, inner, features, y, k, draws, n, seed)
    names = [f"s{i}" for i in range(len(features) + 1)]

    def solve(pdf):
        b, yy = pdf[names].to_numpy(float), pdf["yy"].to_numpy(float)
        at = [(int(t), int(i)) for t, i in zip(pdf["test_fold"], pdf["inner"], strict=True)]
        held = {c: (cells[c][0], b[j], yy[j]) for j, c in enumerate(at) if c in cells}
        r, rmse = nested_statistics(held, alphas)
        return pd.DataFrame({"draw": [pdf["draw"].iloc[0]], "r": [r], "rmse_percent": [rmse]})

    schema = "draw int, r double, rmse_percent double"
    known = [None if np.isnan(v) else v for v in nested_statistics(cells, alphas)]
    return sums.groupBy("draw").applyInPandas(solve, schema).unionByName(people.sparkSession.createDataFrame([(-1, *known)], schema))


def loading_table(rows: DataFrame, groups: Sequence[str], columns: Sequence[str], least: int = 200) -> DataFrame:
    """grouping, level, rows, loadings, congruence: the first component of standardised columns in each group of at least ``least`` rows.

    All groupings are grouping sets of one aggregate, the empty one being all rows, with which loadings are
    compared.  Components are found where the groups are, from their correlations.
    """
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    together = [F.count("*").alias("rows"), F.array(*[F.coalesce(F.corr(columns[i], columns[j]), F.lit(0.0)) for i, j in pairs]).alias("_r"), F.grouping_id().alias("_g")]
    whole_id = 2 ** len(groups) - 1

    @F.pandas_udf("array<double>")
    def component(r: pd.Series) -> pd.Series:
        return r.map(lambda x: _component(p, x).tolist())

    sets = [[F.col(g)] for g in groups] + [[]]
    sums = _complete(rows.select(*groups, *columns), columns).groupingSets(sets, *[F.col(g) for g in groups]).agg(*together).where(F.col("rows") >= F.when(F.col("_g") == whole_id, 1).otherwise(least))
    found = sums.withColumn("loadings", component("_r"))
    whole = found.where(F.col("_g") == whole_id).select(F.col("loadings").alias("_w"))  # one row
    named = [(whole_id - (1 << (len(groups) - 1 - i)), g) for i, g in enumerate(groups)]  # a grouping set lacks all columns but its own
    name = F.coalesce(*[F.when(F.col("_g") == i, F.lit(g)) for i, g in named])
    level = F.coalesce(*[F.when(F.col("_g") == i, F.col(g).cast("string")) for i, g in named])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    cosine = F.abs(dot("loadings", "_w")) / F.sqrt(dot("loadings", "loadings") * dot("_w", "_w"))
    return found.where(F.col("_g") != whole_id).crossJoin(F.broadcast(whole)).select(name.alias("grouping"), level.alias("level"), "rows", "loadings", cosine.alias("congruence"))


def loading_stability(rows: DataFrame, group: str, columns: Sequence[str], least: int) -> DataFrame:
    """loading_table of one grouping, its level under its own name."""
    found = loading_table(rows, [group], columns, least)
    return found.select(F.col("level").cast(dict(rows.dtypes)[group]).alias(group), "rows", "loadings", "congruence")


def component_scores(rows: DataFrame, columns: Sequence[str], by: str = "score") -> DataFrame:
    """rows with the first component's score, scaled to a sample SD of 1."""
    v = first_component(rows, columns)
    stats = rows.agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = sum((float(v[i]) * F.try_divide(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}")) for i, c in enumerate(columns)), F.lit(0.0))
    raw = rows.crossJoin(F.broadcast(stats)).withColumn(by, z).select(*rows.columns, by)
    sd = raw.agg(F.stddev_samp(by).alias("_sd"))
    return raw.crossJoin(F.broadcast(sd)).withColumn(by, F.try_divide(by, F.col("_sd"))).drop("_sd")


#: Levels that a text column of a model may have.
LEVELS_MOST = 256


def benchmark_predictions(rows: DataFrame, y: str, sets: dict[str, Sequence[str]], validations: dict[str, str], k: int, alpha: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """validation, model, kept columns, actual and prediction: out-of-fold predictions of ridge models on standardised columns.

    Missing numbers get the training folds' median and an indicator; text columns become an indicator for each
    level that the training folds have, so unknown levels are zeros.  One aggregate a validation gives the sums of
    all columns; every model is solved from its part of them.
    """
    spark, types = rows.sparkSession, dict(rows.dtypes)
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    texts = [c for c in columns if types[c] == "string"]
    numbers = [c for c in columns if c not in texts]
    # read for levels, medians, sums and predictions
    rows = rows.select(*dict.fromkeys([*keep, y, *columns, *validations.values()])).persist(StorageLevel.DISK_ONLY)
    levels = {c: sorted(r[0] for r in rows.where(F.col(c).isNotNull()).select(c).distinct().limit(LEVELS_MOST + 1).collect()) for c in texts}
    if over := [c for c, v in levels.items() if len(v) > LEVELS_MOST]:
        raise ValueError(f"more than {LEVELS_MOST} levels: {over}")
    design = {c: [f"{c}", f"{c}_missing"] for c in numbers} | {c: [f"{c}_{i}" for i in range(len(v))] for c, v in levels.items()}
    every = [x for c in columns for x in design[c]]
    p = len(every) + 1
    own = design_sums(rows, columns, levels, y, list(validations.values()))
    out = None
    for name, fold in validations.items():
        parts = {f: v for (v_, f), v in own.items() if v_ == fold}
        with_missing = [c for c in numbers if any(a[0, 1 + every.index(f"{c}_missing")] > 0 for a, _ in parts.values())]
        folded = rows.withColumn("fold", F.col(fold))
        medians = {f: dict.fromkeys(numbers, 0.0) for f in range(1, k + 1)}
        if with_missing:
            for r in held_out_folds(folded.select("fold", *with_missing), k).groupBy("test_fold").agg(*[F.percentile(c, 0.5).alias(c) for c in with_missing]).collect():  # k rows
                medians[r["test_fold"]] |= {c: r[c] or 0.0 for c in with_missing}
        fitted = []
        for f in medians:
            train = [v for g, v in parts.items() if g != f]
            if not train:
                continue
            # the sums have 0 for missing numbers; the median comes in by the column that says so
            change = np.eye(p)
            for c in numbers:
                change[1 + every.index(f"{c}_missing"), 1 + every.index(c)] = medians[f][c]
            a, b = change.T @ sum(v[0] for v in train) @ change, change.T @ sum(v[1] for v in train)
            for model, cs in sets.items():
                used = [0, *[every.index(x) + 1 for c in cs for x in design[c]]]
                sub = a[np.ix_(used, used)]
                # penalising standardised columns: the penalty of a raw one grows with its variance
                variance = np.diag(sub) / sub[0, 0] - (sub[0] / sub[0, 0]) ** 2
                c = np.zeros(p)
                c[used] = np.linalg.solve(sub + alpha * np.diag([0.0, *variance[1:]]) + 1e-9 * np.eye(len(used)), b[used])
                fitted.append((f, model, (change @ c).tolist()))
        table = spark.createDataFrame(fitted, "fold int, model string, _coef array<double>")
        values = [v for c in columns for v in _design_columns(c, levels.get(c))]
        test = folded.select(*keep, "fold", F.col(y).alias("_y"), F.array(*values).alias("_x")).join(F.broadcast(table), "fold")  # a row a fold and model
        prediction = sum((F.col("_coef")[i + 1] * F.col("_x")[i] for i in range(len(every))), F.col("_coef")[0])
        g = test.select(F.lit(name).alias("validation"), "model", *keep, F.col("_y").alias("actual"), prediction.alias("prediction"))
        out = g if out is None else out.unionByName(g)
    return out


def _design_columns(c: str, levels: Sequence[str] | None) -> list[Column]:
    """A number (0 where missing) and whether it is missing, or an indicator for each level."""
    if levels is None:
        return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col(c).isNull().cast("double")]
    return [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in levels]


def design_sums(rows: DataFrame, columns: Sequence[str], levels: dict[str, Sequence[str]], y: str, folds: Sequence[str]) -> dict:
    """X'X and X'y of each (fold column, fold), with an intercept in front and 0 for missing numbers: a row is read once for all, and a task sends on a row for each fold."""
    p = 1 + sum(2 if c not in levels else len(levels[c]) for c in columns)

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), batch.column(1).flatten().to_numpy().reshape(-1, p - 1), batch.column(0).to_numpy()])
            for i in range(len(folds)):
                fold = batch.column(2 + i).to_numpy()
                for f in np.unique(fold):
                    part = x[fold == f]
                    sums[i, int(f)] = sums.get((i, int(f)), 0) + part[:, :-1].T @ part
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].ravel().tolist() for k in keys], pa.list_(pa.float64()))], names=["v", "fold", "s"])

    made = rows.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), F.array(*[v for c in columns for v in _design_columns(c, levels.get(c))]).alias("_x"), *[F.col(f).cast("int").alias(f"_f{i}") for i, f in enumerate(folds)])
    total = made.where(" AND ".join(f"_f{i} IS NOT NULL" for i in range(len(folds)))).mapInArrow(run, "v int, fold int, s array<double>").groupBy("v", "fold").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(p * (p + 1))]).alias("s")).collect()  # a row a fold
    found = {}
    for r in total:
        s = np.array(r["s"]).reshape(p, p + 1)
        found[folds[r["v"]], r["fold"]] = s[:, :p], s[:, p]
    return found


def benchmark_metrics(predictions: DataFrame) -> DataFrame:
    """rows, rmse, mae, r2 and r of each validation and model, over all folds' predictions."""
    e = F.col("actual") - F.col("prediction")
    return predictions.groupBy("validation", "model").agg(
        F.count("*").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop("actual"))).alias("r2"), correlation(F.col("prediction"), F.col("actual")).alias("r"),
    )


def benchmark_differences(predictions: DataFrame, entity: str, reference: str, challengers: Sequence[str], draws: int) -> DataFrame:
    """validation, challenger, people, delta_rmse against the reference model, and its interval over bootstraps of persons.

    Each person's mean squared errors under all models are one row, so a draw compares all models on the same persons.
    """
    e = F.pow(F.col("actual") - F.col("prediction"), 2)
    # a row for each person, validation and model
    errors = predictions.groupBy(entity, "validation", "model").agg(F.avg(e).alias("_e")).persist(StorageLevel.DISK_ONLY)
    names = [r[0] for r in errors.select("validation").distinct().collect()]  # a row a validation
    mse = lambda v, m: F.max(F.when((F.col("validation") == v) & (F.col("model") == m), F.col("_e"))).alias(f"{v}:{m}")
    people = errors.groupBy(entity).agg(*[mse(v, m) for v in names for m in [reference, *challengers]])
    over = lambda mean, v, m: F.sqrt(mean(f"`{v}:{m}`")) - F.sqrt(mean(f"`{v}:{reference}`"))
    means = bootstrap_means(people, entity, draws, [c for c in people.columns if c != entity])
    found = means.select("draw", *[over(F.col, v, m).alias(f"{v}:{m}") for v in names for m in challengers])
    cells = F.array(*[F.struct(F.lit(v).alias("validation"), F.lit(m).alias("challenger"), F.col(f"`{v}:{m}`").alias("delta")) for v in names for m in challengers])
    ends = found.select(F.explode(cells).alias("c")).select("c.*").groupBy("validation", "challenger").agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"))
    whole = people.agg(F.count("*").alias("people"), *[over(F.avg, v, m).alias(f"{v}:{m}") for v in names for m in challengers])
    seen = whole.select("people", F.explode(cells).alias("c")).select("people", "c.*").withColumnRenamed("delta", "delta_rmse")
    return seen.join(F.broadcast(ends), ["validation", "challenger"])  # a row a model


def nested_ridge(people: DataFrame, key: str, features: Sequence[str], y: str, alphas: Sequence[float], k: int, seed: int = SEED) -> DataFrame:
    """test_fold, alpha, coefficients (intercept first, of the raw columns): ridges on columns standardised by the training rows.

    The penalty has the least error over k inner folds, dealt anew for each test fold, the largest on ties.  Centring and scaling are done on
    sums, so the rows are read once however many folds and penalties there are.
    """
    cells, centres = nested_cells(people, key, features, y, k, seed)
    out = []
    for test in sorted({t for t, _ in cells}):
        alpha, c = nested_fit({i: v for (t, i), v in cells.items() if t == test}, alphas)
        c = np.r_[c[0] + centres[-1] - c[1:] @ np.array(centres[:-1]), c[1:]]
        out.append((test, alpha, [float(v) for v in c]))
    return people.sparkSession.createDataFrame(out, "test_fold int, alpha double, coefficients array<double>")
