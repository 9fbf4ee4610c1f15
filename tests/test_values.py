"""Queries without SQL against plain Python on the test table."""

import numpy as np
import pandas as pd
import pytest

from longpanel.operators import redraw, resample
from longpanel.plans import studies
from longpanel.plans.queries import QUERIES


@pytest.fixture(scope="module")
def series(sf_dir):
    """user_id -> values in order of time."""
    events = pd.read_parquet(f"{sf_dir}/events.parquet").dropna(subset=["value"]).sort_values(["user_id", "ts", "event_id"])
    return {u: g["value"].to_numpy(float) for u, g in events.groupby("user_id")}


def _corr(a, b):
    return float(np.corrcoef(a, b)[0, 1]) if np.std(a) > 0 and np.std(b) > 0 else 0.0


def test_extension_null(spark, sf_dir, series):
    """Each person's phi and SD by hand, their generator's series, and means over persons of benefit and slope."""
    held = {u: y for u, y in series.items() if len(y) >= 9}
    pooled = _corr(np.concatenate([y[:-1] for y in held.values()]), np.concatenate([y[1:] for y in held.values()]))
    parts = []
    for u, y in held.items():
        if len(y) < 13:
            continue
        more = max(len(y) - 3, 0)
        phi = np.clip(more / (more + 10) * _corr(y[:-1], y[1:]) + 10 / (more + 10) * pooled, -0.95, 0.95)
        paths = resample.ar1_paths(y, phi, 5000, redraw._generator(resample.SEED, str(u), 0), None, np.sqrt(max(y.var(ddof=1), 1e-8)))
        recent = np.stack([paths[:, t - 8 : t].mean(axis=1) for t in range(8, len(y))], axis=1)
        gain = np.abs(paths[:, 8:] - paths[:, :8].mean(axis=1, keepdims=True)) - np.abs(paths[:, 8:] - recent)
        age = np.log1p(np.arange(1, gain.shape[1] + 1))
        parts.append((gain.mean(axis=1), [np.polyfit(age, g, 1)[0] for g in gain[:50]]))
    rows = sorted(QUERIES["extension_null"](spark, sf_dir).collect(), key=lambda r: r["draw"])
    assert [r["draw"] for r in rows] == list(range(5000))
    assert [r["benefit"] for r in rows] == pytest.approx(np.mean([p[0] for p in parts], axis=0).tolist(), rel=1e-6, abs=1e-9)
    assert [r["slope"] for r in rows[:50]] == pytest.approx(np.mean([p[1] for p in parts], axis=0).tolist(), rel=1e-6, abs=1e-9)


def test_ipw_confirmation(spark, sf_dir):
    """Weighted errors from the response probabilities, person by person."""
    people = []
    for _, g in studies._response_folds(spark, sf_dir).select("user_id", "counter", "done", "value", "probability").toPandas().groupby("user_id"):
        chance = dict(zip(g["counter"], g["probability"], strict=True))
        done = pd.DataFrame(studies._prompts(spark, sf_dir).where(f"done AND user_id = {g['user_id'].iloc[0]}").select("counter", "value").collect(), columns=["counter", "value"]).dropna().sort_values("counter")
        y, at = done["value"].to_numpy(float), done["counter"].tolist()
        errors = [(1 / np.clip(chance[at[t]], 0.1, 0.99), abs(y[t] - y[:8].mean()), abs(y[t] - y[t - 8 : t].mean())) for t in range(8, len(y)) if at[t] in chance]
        if errors:
            w, b, recent = np.array(errors).T
            people.append(((w * b).sum() / w.sum(), (w * recent).sum() / w.sum()))
    b, recent = np.mean(people, axis=0)
    r = QUERIES["ipw_confirmation"](spark, sf_dir).first()
    assert (r["people"], r["ipw_b8"], r["ipw_l8"], r["percent"]) == pytest.approx((len(people), b, recent, 100 * (recent / b - 1)))
    assert r["low"] < r["percent"] < r["high"]
    assert r["verdict"] == ("supported" if r["percent"] < 0 and r["high"] < 0 else "direction only" if r["percent"] < 0 else "not supported")


def test_future_gain_verdict(spark, sf_dir):
    """Predictions row by row give the correlation and error that the permutation null finds from sums."""
    o = studies._nested_oof(spark, sf_dir).toPandas()
    error = np.sqrt(((o["gain"] - o["prediction"]) ** 2).sum() / ((o["gain"] - o["dummy"]) ** 2).sum())
    for f in range(1, 6):
        assert o.loc[o["fold"] == f, "dummy"].to_numpy() == pytest.approx(o.loc[o["fold"] != f, "gain"].mean())
    null = {r["draw"]: r for r in QUERIES["label_permutation_null"](spark, sf_dir).collect()}
    seen = null.pop(-1)
    assert seen["r"] == pytest.approx(np.corrcoef(o["prediction"], o["gain"])[0, 1]) and seen["rmse_percent"] == pytest.approx(100 * (error - 1))
    r = QUERIES["future_gain_verdict"](spark, sf_dir).first()
    p = (1 + sum(x["r"] >= seen["r"] for x in null.values())) / (1 + len(null))
    assert len(null) == 500 and (r["r"], r["rmse_percent"], r["p"]) == pytest.approx((seen["r"], seen["rmse_percent"], p))
    assert r["verdict"] == ("predictable" if -r["rmse_percent"] > 10 and r["high"] < 0 and r["r"] > 0 and r["p"] <= 0.0125 else "not predictable")
