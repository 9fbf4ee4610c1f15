"""Draws made inside entities against the same draws made by joins and windows, and bootstrap weights of many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longpanel.functions.stats import lcg, lcg_array
from longpanel.operators import redraw, resample


@pytest.fixture(scope="module")
def panel(spark):
    """Series of 5 to 40 reports of persons with names, one of them with 120."""
    rng = np.random.default_rng(3)
    rows = []
    for p in range(25):
        n = 120 if p == 7 else int(rng.integers(5, 41))
        rows += [(f"p{p}", i + 1, n, float(v)) for i, v in enumerate(rng.normal(50, 9, n).cumsum())]
    return spark.createDataFrame(rows, "who string, rn int, n int, y double").repartition(6)


def test_lcg_is_the_same_in_numpy(spark):
    rows = spark.range(50).withColumn("h", lcg(F.lit(7), F.col("id") * 99991 - 5, F.col("id"))).orderBy("id").collect()
    ids = np.arange(50)
    assert lcg_array(7, ids * 99991 - 5, ids).tolist() == [r["h"] for r in rows]


@pytest.mark.parametrize("kind", redraw.KINDS)
def test_paths_are_the_rearranged_series(panel, kind):
    one = panel.where("who = 'p7'")
    y = np.array([r["y"] for r in one.orderBy("rn").collect()])
    key = one.select(resample.number(F.col("who"), "string")).first()[0]
    paths = redraw.rearranged(y, key, np.arange(4), kind)
    moved = getattr(resample, kind)(one, ["who"], "who", 4).orderBy("draw", "rn").collect()
    assert paths.ravel().tolist() == [r["y_new"] for r in moved]


def _sorted(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", redraw.KINDS)
@pytest.mark.parametrize("setting, value", [("SERIES_MOST", 30), ("SERIES_MOST", 0), ("PATH_VALUES", 300)])
def test_long_series_take_other_ways_to_the_same_null(panel, monkeypatch, kind, setting, value):
    """By windows, or with draws in blocks, or both ways for some entities each."""
    whole, refit = _sorted(redraw.null_benefit(panel, ["who"], "who", 20, kind)), _sorted(redraw.null_refit(panel, ["who"], "who", 10, kind))
    monkeypatch.setattr(redraw, setting, value)
    assert [r[0] for r in whole] == list(range(20)) and len(refit) == 10
    assert np.array(_sorted(redraw.null_benefit(panel, ["who"], "who", 20, kind))) == pytest.approx(np.array(whole))
    assert np.array(_sorted(redraw.null_refit(panel, ["who"], "who", 10, kind))) == pytest.approx(np.array(refit))


def test_a_series_is_shuffled_once(panel):
    """No row leaves an entity's task: behind the one exchange of the series there are sums for each draw."""
    plan = redraw.draw_sums(panel, ["who"], "who", 500, redraw._moved("shifted", 1), lambda p, k, d, e: (np.zeros(len(p), int), p[:, :1]), ["v"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert plan.count() <= 500 * plan.rdd.getNumPartitions()


def test_block_counts_are_multinomial_and_each_block_finds_the_same(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_PEOPLE", 100)
    n = 1030
    counts = np.stack([resample.block_counts(n, b, 4000) for b in range(11)])
    assert (counts.sum(axis=0) == n).all()
    assert counts[:10].mean(axis=1) == pytest.approx(100, abs=1) and counts[10].mean() == pytest.approx(30, abs=0.5)
    assert counts[:10].std(axis=1) == pytest.approx(np.sqrt(n * (100 / n) * (1 - 100 / n)), rel=0.06)


def test_bootstrap_of_many_blocks_draws_everyone_alike(spark):
    n = (1 << 16) * 2 + 5000
    people = spark.range(n).select(F.concat(F.lit("p"), "id").alias("who"), F.col("id").cast("double").alias("x"))
    stats = {"n": F.sum("weight"), "mean": F.sum(F.col("weight") * F.col("x")) / F.sum("weight"), "most": F.max("weight"), "different": F.count("*")}
    draws = resample.bootstrap(people, "who", 12, **stats).collect()
    assert len(draws) == 12 and {r["n"] for r in draws} == {n}
    assert np.mean([r["mean"] for r in draws]) == pytest.approx((n - 1) / 2, rel=0.003)
    assert np.mean([r["different"] for r in draws]) == pytest.approx(n * (1 - np.exp(-1)), rel=0.003)
    assert len({r["mean"] for r in draws}) == 12 and max(r["most"] for r in draws) < 20
    again = resample.bootstrap(people.repartition(9), "who", 12, **stats).collect()
    assert sorted((r["draw"], r["different"]) for r in draws) == sorted((r["draw"], r["different"]) for r in again)


def test_cells_have_nulls_of_their_own(panel, monkeypatch):
    """One pass over all groups gives what a pass over each gives, for held and for long series."""
    split = panel.withColumn("group", (F.xxhash64("who") % 2 == 0).cast("int"))
    for most in (redraw.SERIES_MOST, 30):
        monkeypatch.setattr(redraw, "SERIES_MOST", most)
        both = {(r["cell"], r["draw"]): r["benefit"] for r in redraw.null_benefit(split, ["who"], "who", 8, "shifted", cell="group").collect()}
        for g in (0, 1):
            alone = redraw.null_benefit(split.where(F.col("group") == g), ["who"], "who", 8, "shifted").collect()
            assert {r["draw"]: r["benefit"] for r in alone} == pytest.approx({d: v for (c, d), v in both.items() if c == g})


def test_simulated_series_do_not_depend_on_the_split(spark):
    """Blocks of draws follow from the length of a series; bounded series stay inside, with the extremes that clipping makes."""
    rng = np.random.default_rng(2)
    n, y = 400, np.clip(rng.normal(50, 30, 400), 0, 100)
    paths = redraw.simulated("ar1", (0.0, 100.0))(y, 1, "p", 0, np.arange(900), {"phi": 0.5})
    assert paths.min() == 0 and paths.max() == 100
    free = redraw.simulated("ar1")(y, 1, "p", 0, np.arange(900), {"phi": 0.5})
    assert (np.clip(free, 0, 100) == paths).all()
    assert free.mean() == pytest.approx(y.mean(), abs=0.7) and free.std() == pytest.approx(y.std(), rel=0.02)
    assert (paths == 0).mean() == pytest.approx((free <= 0).mean()) and (paths == 100).mean() > 0.02
    assert np.corrcoef(free[:, :-1].ravel(), free[:, 1:].ravel())[0, 1] == pytest.approx(0.5, abs=0.01)
    rows = spark.createDataFrame([(f"p{p}", i + 1, n, float(v), 0.5) for p in range(4) for i, v in enumerate(y)], "who string, rn int, n int, y double, phi double")
    one, two = (_sorted(redraw.simulated_null(df, "who", 30, bounds=(0.0, 100.0))) for df in (rows, rows.repartition(9)))
    assert np.array(one) == pytest.approx(np.array(two)) and len(one) == 30


def test_long_series_split_their_draws(spark, monkeypatch):
    """Ten draws of a series fit in an array; the 40 draws are four groups with generators of their own."""
    rows = spark.createDataFrame([("p", i + 1, 50, float(i % 7), 0.3) for i in range(50)], "who string, rn int, n int, y double, phi double")
    monkeypatch.setattr(redraw, "PATH_VALUES", 500)
    dealt = redraw._dealt(rows, ["who"], "who", 40, ["phi"])
    assert {r["_block"]: r["count"] for r in dealt.groupBy("_block").count().collect()} == {b: 50 for b in range(4)}


@pytest.mark.parametrize("block", [1 << 16, 30])
def test_bootstrap_means_have_the_weights_of_the_bootstrap(spark, monkeypatch, block):
    """Nulls are skipped, values without bound count in the draws that have them alone, and no row is made for a person drawn."""
    monkeypatch.setattr(resample, "BLOCK_PEOPLE", block)
    people = spark.range(100).select(F.concat(F.lit("p"), "id").alias("who"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 3 == 0, F.col("id") * 2.0).alias("y z"), F.when(F.col("id") == 7, F.lit(float("inf"))).otherwise(F.col("id") * 1.0).alias("far"))
    mean = lambda c: F.sum(F.col("weight") * F.col(f"`{c}`")) / F.sum(F.when(F.col(f"`{c}`").isNotNull(), F.col("weight")))
    rows = {r["draw"]: tuple(r)[1:] for r in resample.bootstrap(people, "who", 50, a=mean("x"), b=mean("y z"), c=mean("far")).collect()}
    found = resample.bootstrap_means(people, "who", 50, ["x", "y z", "far"])
    means = {r["draw"]: tuple(r)[1:] for r in found.collect()}
    assert sorted(means) == sorted(rows) == list(range(50))
    assert all(means[i] == pytest.approx(rows[i]) for i in rows)
    assert block < 100 or 0 < sum(np.isinf(v[2]) for v in means.values()) < 50


def test_series_are_dealt_out_by_work_and_not_by_bytes(panel):
    """Adaptive execution would leave a task or a few of a small panel whose simulation takes long."""
    tasks = redraw._dealt(panel, ["who"], "who", 40, []).rdd.getNumPartitions()
    assert tasks >= 4 * panel.sparkSession.sparkContext.defaultParallelism


def test_turns_are_found_once_a_series(monkeypatch):
    """As many gains as a series has turns, not as there are draws."""
    y = np.arange(9.0) ** 2
    assert redraw.turned(y).tolist() == [np.roll(y, s).tolist() for s in range(1, 9)]
    draws = np.arange(700)
    assert (redraw.rearranged(y, 5, draws, "shifted") == redraw.turned(y)[redraw._turns(9, 5, draws, resample.SEED)]).all()


def test_block_paths_are_wrapped_blocks():
    y = np.arange(7.0)
    paths = resample.block_paths(y, 4.0, 3000, np.random.default_rng(5))
    goes_on = paths[:, 1:] == (paths[:, :-1] + 1) % 7
    assert paths.shape == (3000, 7) and goes_on.mean() == pytest.approx(0.75 + 0.25 / 7, abs=0.01)
    gain, slope = resample.benefit_slope(np.tile(np.arange(20.0), (1100, 1)))
    assert gain == pytest.approx(np.full(1100, np.mean([t - 3.5 - 4.5 for t in range(8, 20)]))) and len(slope) == 1100
